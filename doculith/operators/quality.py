"""Scores, status, advice and reports of checked topics; batches and the merged document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions import messages
from doculith.operators import xmlnodes
from doculith.operators.ranking import placed
from doculith.operators.render import DECLARATION

# Weights of the scores and of severities.
WEIGHTS = {"dita_compliance": 0.4, "structure_quality": 0.3, "content_completeness": 0.3}
SEVERITY = {"rule_errors": 0.2, "rule_warnings": 0.1, "rule_infos": 0.05}
#: What stands around the sections of a merged document.
MERGED_HEAD = f'{DECLARATION}<!DOCTYPE concept PUBLIC "-//OASIS//DTD DITA Concept//EN" "concept.dtd">\n<concept id="merged_complete_document">\n  <title>{messages.MERGED_TITLE}</title>\n  <conbody>\n    '
MERGED_END = "\n  </conbody>\n</concept>"
#: The files that a checked topic can be written as.
FORMATS = ("json", "html", "dita")


def scores(checked: DataFrame) -> DataFrame:
    """Adds the three scores and overall_quality from l4_valid, l4_errors, loop_success, iterations and the rule counts."""
    off = F.lit(0.0)
    for column, weight in SEVERITY.items():
        off = off + F.col(column) * F.lit(weight)
    out = checked.withColumns(
        {
            "dita_compliance": F.when(F.col("l4_valid"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.size("l4_errors") * F.lit(0.1))),
            "structure_quality": F.when(F.col("loop_success"), F.lit(1.0) - (F.col("iterations") - 1) * F.lit(0.1)).otherwise(F.lit(0.5)),
            "content_completeness": F.when(F.col("total_issues") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - off)),
        }
    )
    total = F.lit(0.0)
    for column, weight in WEIGHTS.items():
        total = total + F.col(column) * F.lit(weight)
    return out.withColumn("overall_quality", total)


def status(scored: DataFrame) -> DataFrame:
    """Adds overall_status and qa_success: valid, no rule of severity error, and an overall score of 0.7."""
    errors = F.exists("rule_issues", lambda i: i["severity"] == "error")
    failed = ~F.col("l4_valid") | errors
    warned = (F.size("l4_warnings") > 0) | (F.col("rule_warnings") > 0)
    return scored.withColumns({"overall_status": F.when(failed, "failed").when(warned, "passed_with_warnings").otherwise("passed"), "qa_success": ~failed & (F.col("overall_quality") >= 0.7)})


def recommendations(scored: DataFrame) -> DataFrame:
    """Adds recommendations: advice by kind of error, by failed rule and on the loop, in this order, or praise."""
    kind = lambda k: F.exists("l4_errors", lambda e: e["type"] == k)
    title = F.get(F.filter("rule_issues", lambda i: i["rule"] == "title_length"), F.lit(0))["detail"]
    rule = lambda r: F.exists("rule_issues", lambda i: i["rule"] == r)
    advice = F.array_compact(
        F.array(
            F.when(kind("MissingRequiredElement"), messages.ADVICE_MISSING),
            F.when(kind("ElementOrderError"), messages.ADVICE_ORDER),
            F.when(kind("InvalidIDFormat"), messages.ADVICE_ID),
            F.when(title == "long", messages.ADVICE_TITLE + messages.TITLE_LONG).when(title == "short", messages.ADVICE_TITLE + messages.TITLE_SHORT),
            F.when(rule("nesting_depth"), messages.ADVICE_DEPTH),
            F.when(rule("step_count"), messages.ADVICE_STEPS),
            F.when(F.col("iterations") > 1, messages.ADVICE_LOOP),
        )
    )
    return scored.withColumn("recommendations", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(messages.ADVICE_NONE))))


def report(scored: DataFrame, *keys: str, xml: str = "final_xml", metadata: Column | None = None) -> DataFrame:
    """One nested row per document: status, scores, summaries of both checks with the first five errors, advice, statistics.

    `metadata` is what the caller knows of the processing, a struct or a map; null without it. A document that does
    not parse has the size and lines of its text alone.
    """
    n = F.col("nodes")
    measured = [c.alias(name) for name, c in xmlnodes.sizes(n, F.col(xml)).items()]
    statistics = F.struct(*measured, F.when(n.isNotNull(), F.struct(*[c.alias(name) for name, c in xmlnodes.counts(n).items()])).alias("elements"))
    return scored.select(
        *keys,
        "overall_status",
        "qa_success",
        F.struct(*WEIGHTS, "overall_quality").alias("quality_scores"),
        F.struct(
            F.col("l4_valid").alias("is_valid"),
            F.size("l4_errors").alias("errors"),
            F.size("l4_warnings").alias("warnings"),
            F.col("iterations").alias("iterations_required"),
            "repairs_applied",
            F.transform(F.slice("l4_errors", 1, 5), lambda e: e.dropFields("node")).alias("error_details"),
        ).alias("validation_summary"),
        F.struct((F.col("passed_rules") + F.col("failed_rules")).alias("total_rules"), "passed_rules", "failed_rules", "total_issues", "rule_errors", "rule_warnings", "rule_infos").alias("custom_checks_summary"),
        (F.lit(None).cast("map<string,string>") if metadata is None else metadata).alias("processing_metadata"),
        "recommendations",
        statistics.alias("statistics"),
    )


def batch_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Counts, totals and means over all documents; a missing score counts as 0 in a mean."""
    mean = lambda c: (F.sum(F.coalesce(F.col(c), F.lit(0.0))) / F.count("*")).alias(f"avg_{c}")
    ok = F.count(F.when(F.col("qa_success"), 1))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("total"),
        ok.alias("success"),
        (F.count("*") - ok).alias("failed"),
        *[mean(c) for c in (*WEIGHTS, "overall_quality", "iterations")],
        F.sum(F.size("l4_errors")).alias("total_errors"),
        F.sum(F.size("l4_warnings")).alias("total_warnings"),
        F.sum("total_issues").alias("total_issues"),
        (F.sum("total_issues") / F.count("*")).alias("avg_issues_per_doc"),
    )


def body_of(xml: Column) -> Column:
    """The inside of the first body element that the text has, in the order concept, reference, task; else of the root."""
    undeclared = F.when(xml.startswith("<?xml"), F.regexp_replace(F.regexp_replace(xml, r"(?s)^<\?xml.*?\?>", ""), r"^\s+|\s+$", "")).otherwise(xml)
    out = F.when(undeclared.rlike(r"(?s)>.*</"), F.regexp_replace(F.regexp_extract(undeclared, r"(?s)^[^>]*>(.*)</", 1), r"^\s+|\s+$", "")).otherwise(undeclared)
    for tag in ("taskbody", "refbody", "conbody"):
        out = F.when(undeclared.contains(f"<{tag}>"), F.regexp_extract(undeclared, f"(?s)<{tag}>(.*?)</{tag}>", 1)).otherwise(out)
    return out


def merge(docs: DataFrame, key: str, order: str, xml: str = "final_xml", ok: str = "qa_success") -> DataFrame:
    """(key, merged_xml, merged_docs): the bodies of a key's successful documents as sections of one concept, in order.

    A merged document is one value, so a key's documents meet in one task; `merged_rows` has no such bound.
    """
    parts = docs.where(ok).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), body_of(F.col(xml)).alias("body")))).alias("parts"))
    name = lambda i: F.concat(F.lit("Section_"), (i + 1).cast("string"))
    section = lambda p, i: F.concat(F.lit('<section id="'), name(i), F.lit('"><title>'), name(i), F.lit("</title>"), p["body"], F.lit("</section>"))
    return parts.select(key, F.concat(F.lit(MERGED_HEAD), F.array_join(F.transform("parts", section), "\n    "), F.lit(MERGED_END)).alias("merged_xml"), F.size("parts").alias("merged_docs"))


def merged_rows(docs: DataFrame, key: str, order: str, xml: str = "final_xml", ok: str = "qa_success") -> DataFrame:
    """(key, line_no, line): the merged document of each key, of any size, in lines: a head, a section for each successful document, an end.

    Joined by line feeds in their order, the lines of a key are what `merge` makes of it. The sections are numbered
    without bringing a key's documents together.
    """
    sections = placed(docs.where(ok).select(key, F.col(order).alias("_k"), body_of(F.col(xml)).alias("_body")), key, F.col("_k"))
    name = F.concat(F.lit("Section_"), F.col("place").cast("string"))
    line = F.concat(F.lit('    <section id="'), name, F.lit('"><title>'), name, F.lit("</title>"), F.col("_body"), F.lit("</section>"))
    lines = sections.select(key, (F.col("place") + 1).alias("line_no"), line.alias("line"))
    count = lines.groupBy(key).agg(F.max("line_no").alias("last"))
    around = F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.lit(MERGED_HEAD.rstrip()).alias("line")), F.struct((F.col("last") + 1).alias("line_no"), F.lit(MERGED_END.lstrip("\n")).alias("line")))
    return lines.unionByName(count.select(key, F.explode(around).alias("a")).select(key, "a.*"))


def failed_rules(issues: Column) -> Column:
    """(rule, severity, issue_count) of each rule that found something, in order of its first issue; severity is that of its first."""
    one = lambda r: F.filter(issues, lambda i: i["rule"] == r)
    return F.transform(F.array_distinct(F.transform(issues, lambda i: i["rule"])), lambda r: F.struct(r.alias("rule"), F.get(one(r), F.lit(0))["severity"].alias("severity"), F.size(one(r)).alias("issue_count")))


def html(scored: DataFrame, *keys: str, xml: str = "final_xml") -> DataFrame:
    """(keys, html): a page of status, scores, the first five errors, failed rules, sizes of the topic and advice; every value is escaped.

    A topic without XML has sizes of 0; a topic without failed rules has no table of them.
    """
    from doculith.functions.text import escape_xml

    pct = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    cards = F.concat(*[F.concat(F.lit(f'<div class="card"><b>{c}</b> '), pct(c), F.lit("</div>")) for c in (*WEIGHTS, "overall_quality")])
    item = lambda x: F.concat(F.lit("<li>"), escape_xml(x), F.lit("</li>"))
    number = lambda name, c: F.concat(F.lit(f'<div class="stat"><b>{name}</b> '), F.coalesce(c, F.lit(0)).cast("string"), F.lit("</div>"))
    errors = F.array_join(F.transform(F.slice("l4_errors", 1, 5), lambda e: item(F.concat_ws(" ", e["type"], e["element"], e["id"]))), "")
    checks = F.concat(number("errors", F.size("l4_errors")), number("warnings", F.size("l4_warnings")), number("repairs", F.col("repairs_applied")))
    counts = [number(n, F.col(c)) for n, c in (("passed rules", "passed_rules"), ("failed rules", "failed_rules"), ("issues", "total_issues"))]
    row = lambda r: F.concat(F.lit("<tr><td>"), escape_xml(r["rule"]), F.lit("</td><td>"), escape_xml(r["severity"]), F.lit("</td><td>"), r["issue_count"].cast("string"), F.lit("</td></tr>"))
    failed = F.array_join(F.transform(failed_rules(F.col("rule_issues")), row), "")
    table = F.when(failed != "", F.concat(F.lit("<table><tr><th>rule</th><th>severity</th><th>issues</th></tr>"), failed, F.lit("</table>"))).otherwise(F.lit(""))
    measured = xmlnodes.sizes(F.col("nodes"), F.col(xml))
    sizes = F.concat(*[number(name, measured[name]) for name in ("xml_size", "element_count", "word_count", "line_count")])
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><h1>'), F.col("overall_status"), F.lit("</h1>"), cards)
    page = F.concat(head, F.lit("<h2>Validation</h2>"), checks, F.lit("<ul>"), errors, F.lit("</ul><h2>Rules</h2>"), *counts, table, F.lit("<h2>Sizes</h2>"), sizes, F.lit("<h2>Advice</h2><ol>"), F.array_join(F.transform("recommendations", item), ""), F.lit("</ol></body></html>"))
    return scored.select(*keys, page.alias("html"))


def outputs(scored: DataFrame, key: str, formats: tuple[str, ...] = FORMATS, embed: bool = True, xml: str = "final_xml") -> DataFrame:
    """(name, content): the files of each topic in the formats asked for; `embed` puts the topic into its JSON report.

    A topic without XML has an empty .dita file. For a batch, pass its successful topics alone.
    """
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    doc = F.col(key).cast("string")
    files = []
    if "json" in formats:
        body = report(scored, F.col(key).alias("document_id"), *([F.col(xml).alias("final_dita_xml")] if embed else []), xml=xml)
        whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in body.columns]))
        files.append(body.select(F.concat(F.col("document_id").cast("string"), F.lit("_report.json")).alias("name"), whole.alias("content")))
    if "html" in formats:
        files.append(html(scored, F.concat(doc, F.lit("_report.html")).alias("name"), xml=xml).withColumnRenamed("html", "content"))
    if "dita" in formats:
        files.append(scored.select(F.concat(doc, F.lit(".dita")).alias("name"), F.coalesce(F.col(xml), F.lit("")).alias("content")))
    out = files[0] if files else scored.select(doc.alias("name"), F.lit("").alias("content")).limit(0)
    for more in files[1:]:
        out = out.unionByName(more)
    return out
