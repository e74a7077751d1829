"""Two classifiers and their fusion: additive rules, a model backend that may be absent, weighted scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions.text import TITLE_WORDS



def settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a node that no filter is pushed through.

    A filter on a computed type would otherwise be rewritten in terms of all that the type is computed from, once
    per mention, and the plan would grow beyond what the optimizer can hold. The node counts rows and moves none.
    """
    return rows.observe(f"settled_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


#: The order in which ties are won.
TYPES = ("Task", "Concept", "Reference")


def rules() -> list[tuple[str, str, float, Column]]:
    """(name, type, weight, condition) over feature columns, in the order in which weights are added."""
    c = F.col
    title = F.lower(F.coalesce("title", F.lit("")))

    def says(kind: str) -> Column:
        found = F.lit(False)
        for word in TITLE_WORDS[kind]:
            found = found | title.contains(word)
        return found

    numbered, bullet, table, defined = c("has_numbered_list"), c("has_bullet_list"), c("has_table"), c("has_definition")
    # Names, types and weights of the rules.
    return [
        ("strong_task_numbered_imperatives", "Task", 0.50, numbered & (c("imperative_verbs") >= 5)),
        ("numbered_list_with_actions", "Task", 0.40, numbered & (c("action_verbs") >= 5)),
        ("bullet_list_with_actions", "Task", 0.30, bullet & (c("action_verbs") >= 4)),
        ("high_imperative_verbs", "Task", 0.25, c("imperative_verbs") >= 3),
        ("task_title_keyword", "Task", 0.20, says("Task")),
        ("high_action_verb_density", "Task", 0.15, c("action_verbs") >= 7),
        ("strong_reference_multiple_tables", "Reference", 0.50, c("table_count") >= 2),
        ("table_low_text", "Reference", 0.40, table & (c("word_count") < 200)),
        ("reference_title_keyword", "Reference", 0.35, says("Reference")),
        ("code_heavy_low_text", "Reference", 0.30, (c("code_blocks") >= 3) & (c("word_count") < 300)),
        ("has_table", "Reference", 0.20, table),
        ("high_named_entities", "Reference", 0.15, c("named_entities") >= 5),
        ("strong_concept_definition_statements", "Concept", 0.50, defined & (c("is_statements") >= 4)),
        ("has_definition_pattern", "Concept", 0.35, defined),
        ("high_is_statements", "Concept", 0.30, c("is_statements") >= 3),
        ("concept_title_keyword", "Concept", 0.30, says("Concept")),
        ("descriptive_language", "Concept", 0.25, (c("action_verbs") < 2) & (c("noun_count") > c("verb_count"))),
        ("moderate_named_entities", "Concept", 0.15, (c("named_entities") >= 3) & (c("named_entities") <= 5)),
        ("pure_text_no_structure", "Concept", 0.10, ~numbered & ~bullet & ~table),
    ]


def best(scores: dict[str, Column]) -> tuple[Column, Column]:
    """The first type of the highest score, and that score."""
    top = F.greatest(*[scores[t] for t in TYPES])
    return F.when(scores["Task"] == top, F.lit("Task")).when(scores["Concept"] == top, F.lit("Concept")).otherwise(F.lit("Reference")), top


def by_rules(features: DataFrame) -> DataFrame:
    """Adds t1_type, t1_confidence, t1_task, t1_concept, t1_reference and t1_rules."""
    listed = rules()
    raw = {t: F.lit(0.0) for t in TYPES}
    for _, kind, weight, cond in listed:
        raw[kind] = raw[kind] + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    scored = features.withColumns({f"_r_{t}": raw[t] for t in TYPES}).withColumn("_total", F.col("_r_Task") + F.col("_r_Concept") + F.col("_r_Reference"))
    named = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, _, _, cond in listed]))
    some = F.col("_total") > 0
    scored = scored.withColumn("t1_rules", F.when(some, named).otherwise(F.array(F.lit("default_concept"))))
    for t in TYPES:
        scored = scored.withColumn(f"t1_{t.lower()}", F.when(some, F.col(f"_r_{t}") / F.col("_total")).otherwise(F.lit(1.0 if t == "Concept" else 0.0)))
    kind, top = best({t: F.col(f"t1_{t.lower()}") for t in TYPES})
    return settled(scored.withColumns({"t1_type": kind, "t1_confidence": top}).drop("_total", *[f"_r_{t}" for t in TYPES]))


def without_model(chunks: DataFrame) -> DataFrame:
    """Adds what the second classifier says without a model: t2_type, t2_confidence, scores and reasoning."""
    # The answer of an absent model.
    said = {"t2_type": F.lit("Concept"), "t2_confidence": F.lit(0.3), "t2_task": F.lit(0.33), "t2_concept": F.lit(0.34), "t2_reference": F.lit(0.33), "t2_reasoning": F.lit("LLM disabled, returning low confidence default")}
    return chunks.withColumns(said)


#: Takes rows and returns them with the columns that `without_model` adds.
Backend = Callable[[DataFrame], DataFrame]


def parse_answer(answer: Column) -> Column:
    """(type, confidence, task, concept, reference, reasoning) from a model's text, or null if a field is missing.

    The widest {...} is read as JSON; the type is capitalised and an unknown one becomes Concept; the confidence is clamped to 0..1.
    """
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    shape = "type string, confidence double, reasoning string, scores struct<Task:double,Concept:double,Reference:double>"
    j = F.from_json(body, shape)
    kind = F.concat(F.upper(F.substring(j["type"], 1, 1)), F.lower(F.substring(j["type"], 2, 1000)))
    whole = j["type"].isNotNull() & j["confidence"].isNotNull() & j["scores"].isNotNull() & j["reasoning"].isNotNull()
    out = F.struct(
        F.when(kind.isin(*TYPES), kind).otherwise(F.lit("Concept")).alias("type"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), j["confidence"])).alias("confidence"),
        j["scores"]["Task"].alias("task"),
        j["scores"]["Concept"].alias("concept"),
        j["scores"]["Reference"].alias("reference"),
        j["reasoning"].alias("reasoning"),
    )
    return F.when(whole, out)


def loose_json(text: Column) -> Column:
    """A model's JSON text without its fence and, if it only parses without them, without // comments; '{}' if neither parses."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    clean = F.regexp_replace(bare, r"(?m)//.*$", "")
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(ok(bare), bare).when(ok(clean), clean).otherwise(F.lit("{}"))


def reasoning(kind: Column, confidence: Column) -> Column:
    """One sentence on how the two classifiers met; the first of five cases that applies."""
    one, two, c1, c2 = F.col("t1_type"), F.col("t2_type"), F.col("t1_confidence"), F.col("t2_confidence")
    # The wordings.
    return (
        F.when((one == two) & (two == kind), F.format_string("Strong agreement: Both classifiers predict %s (Rules: %.2f, LLM: %.2f)", kind, c1, c2))
        .when((one == kind) & (c1 > 0.8), F.format_string("Rule-based classifier dominates: %s with high confidence (%.2f), LLM suggested %s (%.2f)", kind, c1, two, c2))
        .when((two == kind) & (c2 > 0.8), F.format_string("LLM classifier dominates: %s with high confidence (%.2f), Rules suggested %s (%.2f)", kind, c2, one, c1))
        .when(one != two, F.format_string("Fusion resolved conflict: Rules=%s(%.2f), LLM=%s(%.2f), Final=%s(%.2f)", one, c1, two, c2, kind, confidence))
        .otherwise(F.format_string("Weighted fusion result: %s (confidence: %.2f)", kind, confidence))
    )


def fuse(both: DataFrame, weight: float = 0.3, model_weight: float = 0.7, threshold: float = 0.6) -> DataFrame:
    """Adds type, confidence, task, concept, reference, needs_review and reasoning from t1_ and t2_ columns."""
    if abs(weight + model_weight - 1) > 0.01:
        raise ValueError("the weights must sum to 1")
    raw = both.withColumns({f"_f_{t}": F.lit(weight) * F.col(f"t1_{t.lower()}") + F.lit(model_weight) * F.col(f"t2_{t.lower()}") for t in TYPES})
    raw = raw.withColumn("_total", F.col("_f_Task") + F.col("_f_Concept") + F.col("_f_Reference"))
    scores = {t.lower(): F.when(F.col("_total") > 0, F.col(f"_f_{t}") / F.col("_total")).otherwise(F.col(f"_f_{t}")) for t in TYPES}
    out = raw.withColumns(scores).drop("_total", *[f"_f_{t}" for t in TYPES])
    kind, top = best({t: F.col(t.lower()) for t in TYPES})
    out = out.withColumns({"type": kind, "confidence": top})
    return settled(out.withColumn("needs_review", F.col("confidence") < threshold).withColumn("reasoning", reasoning(F.col("type"), F.col("confidence"))))


def hybrid(features: DataFrame, backend: Backend | None = None, sure: float = 0.9, weight: float = 0.3, review_below: float = 0.6) -> DataFrame:
    """Rules first; rows that they are sure of skip the model, the others are fused with its answer.

    With a backend the rows are split before it, so that it sees only those that need it; without one all is a
    single projection. In rows that the rules decide, t2_ columns and reasoning are null and needs_review is false.
    """
    ruled = by_rules(features)
    decided = {"type": F.col("t1_type"), "confidence": F.col("t1_confidence"), **{t.lower(): F.col(f"t1_{t.lower()}") for t in TYPES}, "needs_review": F.lit(False)}
    is_sure = F.col("t1_confidence") >= sure
    if backend is not None:
        return fuse(backend(ruled.where(~is_sure)), weight, 1 - weight, review_below).unionByName(ruled.where(is_sure).withColumns(decided), allowMissingColumns=True)
    fused = fuse(without_model(ruled), weight, 1 - weight, review_below)
    unsaid = {c: F.lit(None) for c in ("t2_type", "t2_confidence", "t2_task", "t2_concept", "t2_reference", "t2_reasoning", "reasoning")}
    return settled(fused.withColumns({c: F.when(is_sure, v.cast(fused.schema[c].dataType)).otherwise(F.col(c)) for c, v in (decided | unsaid).items()}))
