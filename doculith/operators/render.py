"""XML topics from records, as concatenations of escaped columns; names of files; reports of a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions.text import escape_xml, safe_name
from doculith.operators.classify import settled

# Root and body elements of a type, and the name of its template.
ROOTS = {"Task": ("task", "taskbody", "DITA Task"), "Concept": ("concept", "conbody", "DITA Concept"), "Reference": ("reference", "refbody", "DITA Reference")}
TEMPLATES = {"Task": "task.xml.j2", "Concept": "concept.xml.j2", "Reference": "reference.xml.j2"}
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>\n'


def tidy(xml: Column) -> Column:
    """Runs of blank lines as one, and no white space at line ends."""
    # Each pattern begins with a character that few places have.
    few = F.regexp_replace(xml, r"\n[ \t\x0B\f\r]*+\n[ \t\x0B\f\r]*+\n(?:\s*\n)?", "\n\n")
    return F.regexp_replace(few, r"[ \t\x0B\f\r](?<![ \t\x0B\f\r]{2})[ \t\x0B\f\r]*+(\n|\z)", "$1")


def _each(items: Column, one) -> Column:
    return F.array_join(F.transform(items, one), "")


def frame(kind: str, ident: Column, title: Column, body: Column, head_of: Column | None = None) -> Column:
    """The topic around the lines of its body; `head_of` has lines between title and body."""
    root, inner, name = ROOTS[kind]
    head = f'{DECLARATION}<!DOCTYPE {root} PUBLIC "-//OASIS//DTD {name}//EN" "{root}.dtd">\n<{root} id="'
    return F.concat(F.lit(head), escape_xml(ident), F.lit('">\n  <title>'), escape_xml(title), F.lit("</title>\n\n"), F.lit("") if head_of is None else head_of, F.lit(f"  <{inner}>\n"), body, F.lit(f"  </{inner}>\n</{root}>"))


def task(ident: Column, title: Column, steps: Column) -> Column:
    one = lambda s: F.concat(F.lit("      <step>\n"), F.when(s != "", F.concat(F.lit("        <cmd>"), escape_xml(s), F.lit("</cmd>\n"))).otherwise(F.lit("")), F.lit("      </step>\n"))
    return tidy(frame("Task", ident, title, F.concat(F.lit("\n    <steps>\n"), _each(steps, one), F.lit("    </steps>\n\n"))))


def _section(s: Column, gap: str) -> Column:
    ident = F.when(s["id"].isNotNull(), F.concat(F.lit(' id="'), escape_xml(s["id"]), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit("    <section"), ident, F.lit(">\n      <p>"), escape_xml(s["content"]), F.lit(f"</p>\n{gap}    </section>\n"))


def concept(ident: Column, title: Column, introduction: Column, sections: Column) -> Column:
    intro = F.when(introduction != "", F.concat(F.lit("    <p>"), escape_xml(introduction), F.lit("</p>\n"))).otherwise(F.lit(""))
    return tidy(frame("Concept", ident, title, F.concat(intro, F.lit("\n\n\n"), _each(sections, lambda s: _section(s, "\n")), F.lit("\n"))))


def reference(ident: Column, title: Column, columns: Column, rows: Column, sections: Column) -> Column:
    entries = lambda r: _each(r, lambda c: F.concat(F.lit("              <entry>"), escape_xml(c), F.lit("</entry>\n")))
    row = lambda r: F.concat(F.lit("            <row>\n"), entries(r), F.lit("            </row>\n"))
    table = F.concat(F.lit('    <section>\n      <table>\n        <tgroup cols="'), F.size(columns).cast("string"), F.lit('">\n          <thead>\n'), row(columns), F.lit("          </thead>\n          <tbody>\n"), _each(rows, row), F.lit("          </tbody>\n        </tgroup>\n      </table>\n    </section>\n"))
    body = F.concat(F.lit("\n\n\n"), F.coalesce(table, F.lit("")), F.when(columns.isNotNull(), F.lit("\n")).otherwise(F.lit("")), F.coalesce(_each(sections, lambda s: _section(s, "")), F.lit("")))
    return tidy(frame("Reference", ident, title, body))


def render(records: DataFrame, kind: str = "type", renderers: dict[str, Column] | None = None) -> DataFrame:
    """Adds xml; null for an unknown type. `renderers` has columns that replace the standard ones of a type, or add a type."""
    t, title = F.col(kind), F.coalesce("title", F.lit(""))
    none = F.array().cast("array<struct<id:string,content:string>>")
    made = (
        F.when(t == "Task", task(F.col("record_id"), title, F.col("steps")))
        .when(t == "Concept", concept(F.col("record_id"), title, F.col("introduction"), F.coalesce("sections", none)))
        .when(t == "Reference", reference(F.col("record_id"), title, F.col("columns"), F.col("rows"), F.col("sections")))
    )
    for name, own in (renderers or {}).items():
        made = F.when(t == name, own).otherwise(made)
    return settled(records.withColumn("xml", made))


def template(kind: Column) -> Column:
    """The name of a type's template; null for an unknown type."""
    out = F.lit(None).cast("string")
    for name, file in TEMPLATES.items():
        out = F.when(kind == name, F.lit(file)).otherwise(out)
    return out


def file_name(index: Column, kind: Column, title: Column) -> Column:
    """The topic's file: its number among all inputs, its type and its title."""
    return F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("_"), kind, F.lit("_"), safe_name(title), F.lit(".dita"))


def conversion_report(converted: DataFrame) -> DataFrame:
    """Rows with the length and the first 500 characters of the XML in place of the XML."""
    shown = F.when(F.length("xml") > 500, F.concat(F.substring("xml", 1, 500), F.lit("..."))).otherwise(F.col("xml"))
    return converted.withColumn("xml_length", F.coalesce(F.length("xml"), F.lit(0))).withColumn("xml_preview", shown).drop("xml")


def batch(converted: DataFrame, *keys: str) -> DataFrame:
    """Counts of conversions and successes, and their share; 0 where there are none."""
    ok = F.count(F.when(F.col("xml").isNotNull(), 1))
    rate = F.when(F.count("*") > 0, ok / F.count("*")).otherwise(F.lit(0.0))
    return converted.groupBy(*keys).agg(F.count("*").alias("total"), ok.alias("success"), (F.count("*") - ok).alias("failed"), rate.alias("success_rate"))
