"""Style rules over node arrays, in a registry that users extend."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.functions.text import let
from doculith.operators import glossary
from doculith.operators.xmlnodes import child_of_root, children, depth, root, tagged, texts

FOUND = "array<struct<rule:string,severity:string,element:string,detail:string,suggestion:string>>"


def found(rule: str, severity: str | Column, element: str | None = None, detail: Column | None = None, suggestion: Column | None = None) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), text(F.lit(element)).alias("element"), text(detail).alias("detail"), text(suggestion).alias("suggestion"))


def when(cond: Column, one: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(one)).otherwise(F.array().cast(FOUND))


@dataclass(frozen=True)
class Rule:
    """A named check: an array of issues from the column of nodes."""

    name: str
    severity: str
    check: Callable[[Column], Column]


@dataclass
class Style:
    """The defaults of the style guide, and the terms to replace."""

    title_min: int = 5
    title_max: int = 100
    shortdesc_max: int = 150
    max_steps: int = 15
    min_steps: int = 1
    max_depth: int = 5
    replacements: dict[str, str] = field(default_factory=lambda: {"click on": "click", "in order to": "to", "utilize": "use"})


def style(config: dict[str, Any]) -> Style:
    """The style guide of a configuration; what it does not name keeps its default, but terms are only those it names."""
    guide, terms = config.get("style_guide") or {}, config.get("terminology") or {}
    # The names of the settings.
    names = {"title_max_length": "title_max", "shortdesc_max_length": "shortdesc_max", "max_steps": "max_steps", "max_nesting_depth": "max_depth"}
    return Style(**{own: int(guide[name]) for name, own in names.items() if name in guide}, replacements=dict(terms.get("replacements") or {}))


def load_style(spark: SparkSession, path: str | None = None) -> Style:
    """The style guide of a JSON file, of one document by its nature; the default without a path."""
    if path is None:
        return Style()
    return style(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def title_length(s: Style) -> Rule:
    def check(n: Column) -> Column:
        size = F.length(child_of_root(n, "title")["text"])
        return F.concat(when(size > s.title_max, found("title_length", "warning", "title", F.lit("long"))), when((size > 0) & (size < s.title_min), found("title_length", "warning", "title", F.lit("short"))))

    return Rule("title_length", "warning", check)


def nesting_depth(s: Style) -> Rule:
    return Rule("nesting_depth", "warning", lambda n: when(depth(n) > s.max_depth, found("nesting_depth", "warning", None, depth(n))))


def shortdesc_length(s: Style) -> Rule:
    size = lambda n: F.length(child_of_root(n, "shortdesc")["text"])
    return Rule("shortdesc_length", "warning", lambda n: when(size(n) > s.shortdesc_max, found("shortdesc_length", "warning", "shortdesc", size(n))))


def step_count(s: Style) -> Rule:
    def check(n: Column) -> Column:
        steps = F.get(F.filter(tagged(n, "steps"), lambda x: x["node_id"] > 0), F.lit(0))
        count = F.when((root(n)["tag"] == "task") & steps.isNotNull(), F.size(children(n, steps, "step")))
        return F.concat(when(count > s.max_steps, found("step_count", "warning", "steps", count)), when(count < s.min_steps, found("step_count", "error", "steps", count)))

    return Rule("step_count", "warning", check)


def terminology(s: Style) -> Rule:
    """One issue for each term to replace that the text holds, in any case, with the term to use instead.

    For a style guide's few terms; `glossary_issues` takes tables of terms.
    """

    def check(n: Column) -> Column:
        one = lambda held, term, use: when(held.contains(term.lower()), found("terminology_consistency", "info", None, F.lit(term), F.lit(use)))
        return let(F.lower(texts(n)), lambda held: F.concat(*[one(held, term, use) for term, use in s.replacements.items()]) if s.replacements else F.array().cast(FOUND))

    return Rule("terminology_consistency", "info", check)


def glossary_issues(parsed: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds glossary_issues, like the issues of a rule: one for each term of a table (term, use) that a document's text holds, by term."""
    held = glossary.uses(texts(F.col("nodes")), parsed, terms)
    out = parsed.withColumn("_uses", F.coalesce(held, F.array().cast(f"array<{glossary.HIT}>")))
    issue = lambda u: found("terminology_consistency", "info", None, u["term"], u["use"])
    return out.withColumn("glossary_issues", F.transform("_uses", issue)).drop("_uses")


# Beginnings that look like code.
CODE = [r"^\s*(def|class|import|from)\s+", r"^\s*(function|const|let|var)\s+", r"^\s*(public|private|class)\s+", r"^\s*\$\s+"]


def code_block_format() -> Rule:
    def like_code(text: Column) -> Column:
        out = F.lit(False)
        for p in CODE:
            out = out | text.rlike(p)
        return out

    hits = lambda n: F.filter(n, lambda m: (m["tag"] == "p") & (m["node_id"] > 0) & like_code(F.coalesce(m["text"], F.lit(""))))
    return Rule("code_block_format", "warning", lambda n: F.transform(hits(n), lambda m: found("code_block_format", "warning", "p")))


def image_references(known: list[str] | None = None) -> Rule:
    """An empty href is an error. With a list of known files, a href that is no URL and not among them is a warning."""

    def check(n: Column) -> Column:
        images = F.filter(n, lambda m: (m["tag"] == "image") & m["href"].isNotNull() & (m["node_id"] > 0))
        empty = F.transform(F.filter(images, lambda m: m["href"] == ""), lambda m: found("image_references", "error", "image"))
        if known is None:
            return empty
        lost = F.filter(images, lambda m: (m["href"] != "") & ~m["href"].rlike("^(https?|ftp)://") & ~m["href"].isin(*known))
        return F.concat(empty, F.transform(lost, lambda m: found("image_references", "warning", "image", m["href"])))

    return Rule("image_references", "warning", check)


def missing_images(parsed: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """The same for many files: references (keys, href) of documents that a table of files (href) lacks, by an anti join."""
    refs = parsed.select(*keys, F.explode("nodes").alias("n")).where((F.col("n.tag") == "image") & (F.col("n.node_id") > 0)).select(*keys, F.col("n.href").alias("href"))
    local = refs.where((F.col("href") != "") & ~F.col("href").rlike("^(https?|ftp)://"))
    return local.join(files.select("href").distinct(), "href", "left_anti").select(*keys, "href")


class Registry:
    """The rules in order; `add`, `remove`, `get` and `names` change and show them."""

    def __init__(self, style: Style | None = None, known_images: list[str] | None = None):
        s = style or Style()
        self.rules = [title_length(s), nesting_depth(s), shortdesc_length(s), step_count(s), *([terminology(s)] if s.replacements else []), code_block_format()]
        if known_images is not None:
            self.rules.append(image_references(known_images))

    def add(self, rule: Rule) -> None:
        self.rules.append(rule)

    def remove(self, name: str) -> bool:
        kept = [r for r in self.rules if r.name != name]
        gone = len(kept) < len(self.rules)
        self.rules = kept
        return gone

    def get(self, name: str) -> Rule | None:
        return next((r for r in self.rules if r.name == name), None)

    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def run(self, parsed: DataFrame) -> DataFrame:
        """Adds rule_issues. A document that does not parse has one failed rule, xml_parse, that no counter sees."""
        n = F.col("nodes")
        issues = F.concat(*[r.check(n) for r in self.rules]) if self.rules else F.array().cast(FOUND)
        return parsed.withColumn("rule_issues", F.when(n.isNotNull(), issues).otherwise(F.array(found("xml_parse", "error"))))

    def summary(self, ruled: DataFrame) -> DataFrame:
        """Adds passed_rules, failed_rules, total_issues, and issues by severity."""
        whole = F.col("nodes").isNotNull()
        failed = F.size(F.array_distinct(F.transform("rule_issues", lambda i: i["rule"])))
        of = lambda s: F.when(whole, F.size(F.filter("rule_issues", lambda i: i["severity"] == s))).otherwise(F.lit(0))
        return ruled.withColumns(
            {
                "passed_rules": F.when(whole, F.lit(len(self.rules)) - failed).otherwise(F.lit(0)),
                "failed_rules": failed,
                "total_issues": F.when(whole, F.size("rule_issues")).otherwise(F.lit(0)),
                "rule_errors": of("error"),
                "rule_warnings": of("warning"),
                "rule_infos": of("info"),
            }
        )


def severity_pivot(ruled: DataFrame, *keys: str) -> DataFrame:
    """Issues of each rule by severity, over all documents or by keys."""
    rows = ruled.select(*keys, F.explode("rule_issues").alias("i")).select(*keys, "i.rule", "i.severity")
    return rows.groupBy(*keys, "rule").pivot("severity", ["error", "warning", "info"]).count().na.fill(0, ["error", "warning", "info"])
