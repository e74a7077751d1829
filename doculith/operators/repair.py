"""Repairs of ill-formed topics, and the bounded loop of checks and repairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions.text import fixed_id, repaired_id
from doculith.operators.render import DECLARATION
from doculith.operators.validate import converter_issues, quality_columns
from doculith.operators.xmlnodes import PARSED, parse, parsed_array, pieces

# Kinds of errors that rules can repair.
SIMPLE = ["InvalidIDFormat", "MissingDeclaration", "EmptyElement", "DuplicateID"]


def classified(errors: Column) -> tuple[Column, Column]:
    """(simple, complex): the errors that rules repair, and the others."""
    return F.filter(errors, lambda e: e["type"].isin(*SIMPLE)), F.filter(errors, lambda e: ~e["type"].isin(*SIMPLE))


def ids_replaced(xml: str, new: dict[str, str]) -> str:
    """The text with each id="..." of a listed identifier changed, in one pass."""
    return re.sub(r'id="([^"]*)"', lambda m: f'id="{new[m[1]]}"' if m[1] in new else m[0], xml) if new else xml


def without_empty(root: ElementTree.Element, names: set[str]) -> None:
    """Removes the named elements that have neither text nor children; what stood behind them stays."""
    for parent in root.iter():
        gone = {id(c) for c in parent if c.tag in names and not c.text and len(c) == 0}
        if not gone:
            continue
        kept: list[ElementTree.Element] = []
        for c in list(parent):
            if id(c) not in gone:
                kept.append(c)
            elif c.tail and kept:
                kept[-1].tail = (kept[-1].tail or "") + c.tail
            elif c.tail:
                parent.text = (parent.text or "") + c.tail
        parent[:] = kept


def numbered_ids(root: ElementTree.Element, repeated: list[str]) -> None:
    """Puts suffixes _2, _3, ... at repeated identifiers, one identifier after another; each looks at what it holds by then."""
    places: dict[str, list[tuple[int, ElementTree.Element]]] = {}
    for i, node in enumerate(root.iter()):
        if (ident := node.get("id")) is not None:
            places.setdefault(ident, []).append((i, node))
    for ident in repeated:
        own = sorted(places.get(ident, []), key=lambda x: x[0])
        for i, (at, node) in enumerate(own[1:], 2):
            node.set("id", f"{ident}_{i}")
            places.setdefault(f"{ident}_{i}", []).append((at, node))
        if own:
            places[ident] = own[:1]


def tree_repairs(xml: str, empty: list[str], repeated: list[str]) -> tuple[str, int]:
    """The text without the named elements that have neither text nor children, and with suffixes at repeated identifiers; how many errors that settles."""
    if not empty and not repeated:
        return xml, 0
    try:
        root = ElementTree.fromstring(xml[xml.index("?>") + 2 :] if xml.lstrip().startswith("<?xml") else xml)
    except (ElementTree.ParseError, ValueError):
        return xml, 0
    if empty:
        without_empty(root, set(empty))
    numbered_ids(root, repeated)
    return DECLARATION + ElementTree.tostring(root, encoding="unicode"), len(empty) + len(repeated)


def _edits(xml: Column, errors: Column) -> Column:
    """What rules change in a topic with such errors."""
    simple, _ = classified(errors)
    named = lambda kind: F.transform(F.filter(simple, lambda e: (e["type"] == kind) & e["id"].isNotNull() & (e["id"] != "")), lambda e: e["id"])
    empty = F.transform(F.filter(simple, lambda e: (e["type"] == "EmptyElement") & e["element"].isNotNull()), lambda e: e["element"])
    undeclared = F.exists(simple, lambda e: e["type"] == "MissingDeclaration") & ~xml.rlike(r"^\s*<\?xml")
    bad = named("InvalidIDFormat")
    return F.struct(empty.alias("empty"), named("DuplicateID").alias("repeated"), bad.alias("bad"), F.transform(bad, repaired_id).alias("good"), F.coalesce(undeclared, F.lit(False)).alias("undeclared"))


def _edited(xml: str, edits: dict) -> tuple[str, int]:
    text, fixes = tree_repairs(xml, edits["empty"], edits["repeated"])
    text = ids_replaced(text, dict(zip(edits["bad"], edits["good"], strict=True)))
    declared = edits["undeclared"] and not re.match(r"\s*<\?xml", text)
    return (DECLARATION + text if declared else text), fixes + len(edits["bad"]) + edits["undeclared"]


def repaired(xml: Column, errors: Column, reparse: bool = False, whole: bool = True) -> Column:
    """(xml, fixes, parsed): the text after the repairs, how many errors they settle and, if asked for, its nodes when anything was settled.

    A null text stays null and costs nothing; only the text and the edits go through Python, some texts at a time.
    """

    def made_of(texts: pa.Array, edits: pa.Array) -> pa.Array:
        made = [(None, None) if x is None else _edited(x, e) for x, e in zip(texts.to_pylist(), edits.to_pylist(), strict=True)]
        new = parsed_array([x if reparse and n else None for x, n in made], whole)
        return pa.StructArray.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32()), new], names=["xml", "fixes", "parsed"])

    @F.arrow_udf(f"struct<xml:string,fixes:int,parsed:{PARSED}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, edits in batches:
            for start, n in pieces(texts):
                yield made_of(texts.slice(start, n), edits.slice(start, n))

    return run.asNondeterministic()(xml, F.when(xml.isNotNull(), _edits(xml, errors)))


def repair(checked: DataFrame, xml: str = "xml", errors: str = "l4_errors") -> DataFrame:
    """Adds repaired_xml, fixes_applied and errors_remaining. Once anything was applied, every simple error counts as repaired."""
    out = checked.withColumn("_made", repaired(F.col(xml), F.col(errors)))
    fixes, hard = F.coalesce("_made.fixes", F.lit(0)), F.size(classified(F.col(errors))[1])
    out = out.withColumns({"repaired_xml": F.col("_made.xml"), "fixes_applied": fixes, "errors_remaining": F.when(fixes > 0, hard).otherwise(F.size(errors))})
    return out.drop("_made")


def converter_fix(docs: DataFrame, xml: str = "xml", passes: int = 3) -> DataFrame:
    """The converter's loop: at most `passes` checks, between which ill-formed identifiers are fixed while that changes the text.

    Adds fixed_xml and passes_used, and nodes and the l3_ columns of the last check. A text is parsed again only if it was changed.
    """

    def made_of(*columns: pa.Array) -> pa.Array:
        texts, bad, good = (c.to_pylist() for c in columns)
        made = [None if x is None else ids_replaced(x, dict(zip(b, g, strict=True))) for x, b, g in zip(texts, bad, good, strict=True)]
        made = [y if y != x else None for x, y in zip(texts, made, strict=True)]
        return pa.StructArray.from_arrays([pa.array(made, pa.string()), parsed_array(made)], names=["xml", "parsed"])

    @F.arrow_udf(f"struct<xml:string,parsed:{PARSED}>")
    def fixed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for start, n in pieces(columns[0]):
                yield made_of(*(c.slice(start, n) for c in columns))

    out = converter_issues(parse(docs.withColumn("fixed_xml", F.col(xml)), "fixed_xml"), "fixed_xml")
    out = out.withColumns({"passes_used": F.lit(1), "_again": F.lit(True)})
    for i in range(1, passes):
        wrong = F.transform(F.filter("l3_errors", lambda e: e["type"] == "InvalidIDFormat"), lambda e: e["id"])
        go = F.col("_again") & ~F.col("l3_valid") & (F.size(wrong) > 0)
        out = out.withColumns({"_wrong": F.when(go, wrong), "_open": F.when(go, F.col("fixed_xml"))})
        out = out.withColumn("_made", fixed.asNondeterministic()(F.col("_open"), F.col("_wrong"), F.transform("_wrong", fixed_id)))
        again = F.col("_made.xml").isNotNull()
        out = out.withColumns({"_again": again, "passes_used": F.when(again, i + 1).otherwise(F.col("passes_used")), "fixed_xml": F.coalesce("_made.xml", "fixed_xml"), "nodes": F.when(again, F.col("_made.parsed.nodes")).otherwise(F.col("nodes")), "parse_error": F.when(again, F.col("_made.parsed.error")).otherwise(F.col("parse_error"))})
        out = converter_issues(out, "fixed_xml", F.col("_again"))
    return out.drop("_again", "_wrong", "_open", "_made")


def answer_xml(text: Column) -> Column:
    """A model's XML without the fence around it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^```(?:xml)?\s*", ""), r"\s*```$", "")


def with_model(checked: DataFrame, ask: Callable[[DataFrame], DataFrame], xml: str = "xml", errors: str = "l4_errors") -> DataFrame:
    """Adds model_xml: what a model made of a topic with errors that rules cannot repair, if it is well-formed and new, else null.

    `ask` gets only such rows and returns them with a column answer.
    """
    hard = F.size(classified(F.col(errors))[1]) > 0
    asked = ask(checked.where(hard)).withColumn("_answer", answer_xml(F.col("answer"))).drop("answer")
    kept = parse(asked.drop("nodes", "parse_error"), "_answer")
    good = kept.withColumn("model_xml", F.when(F.col("nodes").isNotNull() & (F.col("_answer") != F.col(xml)), F.col("_answer"))).drop("_answer", "nodes", "parse_error")
    return good.unionByName(checked.where(~hard).drop("nodes", "parse_error"), allowMissingColumns=True)


def summary(looped: DataFrame, most: int = 3) -> DataFrame:
    """Adds loop_summary: one line on how the loop ended."""
    end = F.when(F.col("loop_success"), F.lit("valid")).otherwise(F.concat(F.size("l4_errors").cast("string"), F.lit(" errors left")))
    return looped.withColumn("loop_summary", F.concat(end, F.lit(" after "), F.col("iterations").cast("string"), F.lit(f" of {most} passes, "), F.col("repairs_applied").cast("string"), F.lit(" repairs")))


def loop(docs: DataFrame, xml: str = "xml", kind: str | None = "content_type", most: int = 3, whole: bool = True) -> DataFrame:
    """At most `most` checks with a repair between two of them; stops at a valid document or when nothing could be repaired.

    Adds final_xml, iterations, loop_success, repairs_applied, and nodes and l4_ columns of the last check. A topic is
    parsed once and again after each repair that changed it; one that has left the loop sends nothing to Python.
    Without `whole` the nodes are only those that the checks look at.
    """
    out = parse(docs.withColumn("final_xml", F.col(xml)), "final_xml", whole)
    errors, warnings = quality_columns(out, kind)
    out = out.withColumns({"l4_errors": errors, "l4_warnings": warnings, "iterations": F.lit(1), "repairs_applied": F.lit(0), "_open": F.lit(True)})
    for i in range(1, most):
        out = out.withColumn("_text", F.when(F.col("_open") & (F.size("l4_errors") > 0), F.col("final_xml")))
        out = out.withColumn("_made", repaired(F.col("_text"), F.col("l4_errors"), True, whole))
        out = out.withColumn("_open", F.coalesce(F.col("_made.fixes") > 0, F.lit(False)))
        goes_on = F.col("_open")
        out = out.withColumns(
            {
                "final_xml": F.when(goes_on, F.col("_made.xml")).otherwise(F.col("final_xml")),
                "nodes": F.when(goes_on, F.col("_made.parsed.nodes")).otherwise(F.col("nodes")),
                "parse_error": F.when(goes_on, F.col("_made.parsed.error")).otherwise(F.col("parse_error")),
                "iterations": F.when(goes_on, i + 1).otherwise(F.col("iterations")),
                "repairs_applied": F.col("repairs_applied") + F.when(goes_on, F.col("_made.fixes")).otherwise(F.lit(0)),
            }
        )
        errors, warnings = quality_columns(out, kind)
        out = out.withColumns({"l4_errors": F.when(goes_on, errors).otherwise(F.col("l4_errors")), "l4_warnings": F.when(goes_on, warnings).otherwise(F.col("l4_warnings"))})
    valid = F.size("l4_errors") == 0
    return out.withColumns({"l4_valid": valid, "loop_success": valid}).drop("_open", "_text", "_made")
