"""Records that a model answers as JSON: their constraints by type, the fixes that fill what is missing, and their topics.

A record is one JSON object in a string column. A text that is null or no object counts as an object without keys.
A key whose value is null is present, but its value counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions import messages
from doculith.functions.text import escape_xml, let, slug
from doculith.operators.render import frame, tidy

STEP = "struct<cmd:string,info:string,example:string>"
SECTION = "struct<id:string,title:string,content:string,example:string>"
PROPERTY = "struct<name:string,value:string,description:string>"
TABLE = "struct<columns:array<string>,rows:array<array<string>>>"
BODIES = {"Task": "taskbody", "Concept": "conbody", "Reference": "refbody"}


def _keys(raw: Column) -> Column:
    return F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))


def _value(raw: Column, key: str) -> Column:
    """The JSON text of a key's value; null where the key is absent or its value counts as empty."""
    text = F.get_json_object(raw, f"$.{key}")
    return F.when(~F.trim(text).isin("", "[]", "{}", "null", "false", "0"), text)


def _items(raw: Column, key: str) -> Column:
    """The JSON texts of a list's items; no items where the value is no list."""
    return F.coalesce(F.from_json(_value(raw, key), "array<string>"), F.array().cast("array<string>"))


def _object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def _task(raw: Column) -> Column:
    def one(step: Column, i: Column) -> Column:
        lacks = ~F.array_contains(_keys(step), "cmd")
        text = F.when(~_object(step), messages.STEP_FORMAT).when(lacks, messages.STEP_CMD)
        return F.when(text.isNotNull(), F.format_string("%s", F.replace(text, F.lit("%d"), (i + 1).cast("string"))))

    def found(steps: Column) -> Column:
        few = F.when(F.size(steps) < 1, F.array(F.format_string(messages.FEW_STEPS, F.lit(1), F.size(steps)))).otherwise(F.array().cast("array<string>"))
        return F.concat(few, F.array_compact(F.transform(steps, one)))

    return let(_items(raw, "steps"), found)


def _concept(raw: Column) -> Column:
    def found(sections: Column) -> Column:
        ids = F.transform(sections, lambda s: F.get_json_object(s, "$.id"))
        again = lambda x, i: F.when(x.isNotNull() & F.array_contains(F.slice(ids, 1, i), x), F.concat(F.lit(messages.SECTION_ID), x))
        return F.array_compact(F.transform(ids, again))

    empty = _value(raw, "introduction").isNull() & _value(raw, "sections").isNull()
    bare = F.when(empty, F.array(F.lit(messages.EMPTY_CONCEPT))).otherwise(F.array().cast("array<string>"))
    return F.concat(bare, let(_items(raw, "sections"), found))


def _reference(raw: Column) -> Column:
    content = F.coalesce(*[_value(raw, k) for k in ("properties", "table", "sections")]).isNotNull()
    named = F.array(F.lit("reference_id"), F.lit("title"), F.lit("shortdesc"))
    others = F.size(F.array_except(_keys(raw), named)) > 0
    described = F.coalesce(_value(raw, "title"), _value(raw, "shortdesc")).isNotNull() | others
    bare = ~content & (~described | (_keys(raw) == named))
    table = _value(raw, "table")
    whole = F.size(F.array_intersect(_keys(table), F.array(F.lit("columns"), F.lit("rows")))) == 2
    wrong = F.when(table.isNotNull() & ~_object(table), messages.TABLE_FORMAT).when(table.isNotNull() & ~whole, messages.TABLE_FIELDS)
    return F.array_compact(F.array(F.when(bare, messages.EMPTY_REFERENCE), wrong))


def constraint_errors(raw: Column, kind: Column) -> Column:
    """What a record lacks, as messages in order: its type's body element, then what its type asks for. An unknown type gives one message."""
    out = F.array(F.concat(F.lit(messages.UNKNOWN_TYPE), F.coalesce(kind, F.lit(""))))
    for name, found in (("Task", _task(raw)), ("Concept", _concept(raw)), ("Reference", _reference(raw))):
        body = BODIES[name]
        lacks = ~F.arrays_overlap(_keys(raw), F.array(F.lit(body), F.lit(f"{body}_id")))
        missing = F.when(lacks, F.array(F.lit(messages.MISSING_ELEMENT + body))).otherwise(F.array().cast("array<string>"))
        out = F.when(kind == name, F.concat(missing, found)).otherwise(out)
    return out


def parse(rows: DataFrame, raw: str = "answer", kind: str = "type") -> DataFrame:
    """Adds model_errors and the record's model_steps, model_introduction, model_sections and model_table.

    What a type does not have is null. Items that are no objects become ones without values.
    """
    t, j = F.col(kind), F.col(raw)
    objects = lambda key, shape: F.transform(_items(j, key), lambda x: F.from_json(x, shape))
    return rows.withColumns(
        {
            "model_errors": constraint_errors(j, t),
            "model_steps": F.when(t == "Task", objects("steps", STEP)),
            "model_introduction": F.when(t == "Concept", F.coalesce(_value(j, "introduction"), F.lit(""))),
            "model_sections": F.when(t.isin("Concept", "Reference"), objects("sections", SECTION)),
            "model_table": F.when(t == "Reference", F.from_json(_value(j, "table"), TABLE)),
        }
    )


def fix(parsed: DataFrame, raw: str = "answer", kind: str = "type") -> DataFrame:
    """Fills gaps of records that lack an element or a field: a step, the command of a step, an introduction, a section.

    A task that lacks nothing but steps gets one step without a command.
    """
    lacks = F.exists("model_errors", lambda e: e.contains(messages.MISSING_ELEMENT.rstrip(": ")) | e.contains(messages.MISSING_FIELD))
    t = F.when(lacks, F.col(kind))
    none = F.size("model_sections") == 0
    # The texts that fill gaps.
    step = F.when(lacks, "Complete the task").alias("cmd"), F.lit(None).cast("string").alias("info"), F.lit(None).cast("string").alias("example")
    none_of = lambda name: F.lit(None).cast("string").alias(name)
    section = none_of("id"), none_of("title"), F.lit("Reference information").alias("content"), none_of("example")
    filled = F.transform("model_steps", lambda s: F.struct(F.coalesce(s["cmd"], F.lit("Perform action")).alias("cmd"), s["info"].alias("info"), s["example"].alias("example")))
    bare = none & _value(F.col(raw), "properties").isNull() & _value(F.col(raw), "table").isNull()
    return parsed.withColumns(
        {
            "model_steps": F.when((F.col(kind) == "Task") & (F.size("model_steps") == 0), F.array(F.struct(*step))).when(t == "Task", filled).otherwise(F.col("model_steps")),
            "model_introduction": F.when((t == "Concept") & none & (F.col("model_introduction") == ""), "This is a concept description.").otherwise(F.col("model_introduction")),
            "model_sections": F.when((t == "Reference") & bare, F.array(F.struct(*section))).otherwise(F.col("model_sections")),
        }
    )


def root_id(raw: Column, title: Column, key: str) -> Column:
    """The record's own identifier; one that is absent, or is the slug of the chunk's title, is named anew after that slug."""
    own, base = F.get_json_object(raw, f"$.{key}"), slug(title)
    return F.when(own.isNull() | (own == base), F.concat(F.coalesce(slug(own), base), F.lit("_1"))).otherwise(own)


def unique_ids(ids: Column, taken: Column) -> Column:
    """The identifiers in order, each that is taken by then replaced by the first free form of its slug; null stays null."""

    def free(used: Column, base: Column) -> Column:
        form = lambda k: F.when(k == 0, base).otherwise(F.concat(base, F.lit("_"), k.cast("string")))
        forms = F.transform(F.sequence(F.lit(0), F.size(used)), form)
        return F.get(F.filter(forms, lambda x: ~F.coalesce(F.array_contains(used, x), F.lit(False))), F.lit(0))

    def add(used: Column, x: Column) -> Column:
        again = x.isNotNull() & F.coalesce(F.array_contains(used, x), F.lit(False))
        return F.concat(used, F.array(F.when(again, free(used, slug(x))).otherwise(x)))

    return F.slice(F.aggregate(ids, taken.cast("array<string>"), add), F.size(taken) + 1, F.size(ids))


def _line(value: Column, before: str, after: str) -> Column:
    """The escaped value between two texts; nothing where it is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), escape_xml(value), F.lit(after))).otherwise(F.lit(""))


def _whole(value: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), escape_xml(F.coalesce(value, F.lit(""))), F.lit(after))


def _each(items: Column, one) -> Column:
    return F.coalesce(F.array_join(F.transform(items, one), ""), F.lit(""))


def _task_body(j: Column) -> Column:
    many = F.concat(F.lit("      <ul>\n"), _each(_items(j, "prerequisites"), lambda x: _whole(x, "        <li>", "</li>\n")), F.lit("      </ul>\n"))
    asked = _value(j, "prerequisites")
    either = F.when(asked.startswith("["), many).otherwise(_line(asked, "      <p>", "</p>\n"))
    before = F.when(asked.isNotNull(), F.concat(F.lit("    <prereq>\n"), either, F.lit("    </prereq>\n"))).otherwise(F.lit(""))
    parts = lambda s: (_line(s["cmd"], "        <cmd>", "</cmd>\n"), _line(s["info"], "        <info>", "</info>\n"), _line(s["example"], "        <stepxmp>", "</stepxmp>\n"))
    steps = _each(F.col("model_steps"), lambda s: F.concat(F.lit("      <step>\n"), *parts(s), F.lit("      </step>\n")))
    context = _line(_value(j, "context"), "    <context>\n      <p>", "</p>\n    </context>\n")
    result = _line(_value(j, "result"), "    <result>\n      <p>", "</p>\n    </result>\n")
    example = _line(_value(j, "example"), "    <example>\n      <title>Example</title>\n      <p>", "</p>\n    </example>\n")
    return F.concat(before, F.lit("\n"), context, F.lit("\n    <steps>\n"), steps, F.lit("    </steps>\n\n"), result, F.lit("\n"), example)


def _sections(gap: bool) -> Column:
    def one(s: Column) -> Column:
        ident = _line(s["id"], ' id="', '"')
        example = _line(s["example"], "      <example>\n        <p>", "</p>\n      </example>\n") if gap else F.lit("")
        return F.concat(F.lit("    <section"), ident, F.lit(">\n"), _line(s["title"], "      <title>", "</title>\n"), _whole(s["content"], "      <p>", "</p>\n"), F.lit("\n" if gap else ""), example, F.lit("    </section>\n"))

    return _each(F.col("model_sections"), one)


def _concept_body(j: Column) -> Column:
    definition = _line(_value(j, "definition"), "    <section>\n      <title>Definition</title>\n      <p>", "</p>\n    </section>\n")
    note = _line(_value(j, "note"), '    <note type="note">', "</note>\n")
    return F.concat(_line(F.col("model_introduction"), "    <p>", "</p>\n"), F.lit("\n"), definition, F.lit("\n"), _sections(True), F.lit("\n"), note)


def _reference_body(j: Column) -> Column:
    opening = _line(_value(j, "introduction"), "    <section>\n      <p>", "</p>\n    </section>\n")
    # The heads of a table of properties.
    heads = "".join(f"        <{tag}>{text}</{tag}>\n" for tag, text in (("proptypehd", "Property"), ("propvaluehd", "Value"), ("propdeschd", "Description")))
    fields = (("name", "proptype"), ("value", "propvalue"), ("description", "propdesc"))
    row = lambda p: F.concat(F.lit("      <property>\n"), *[_whole(p[f], f"        <{tag}>", f"</{tag}>\n") for f, tag in fields], F.lit("      </property>\n"))
    listed = F.transform(_items(j, "properties"), lambda x: F.from_json(x, PROPERTY))
    properties = F.when(F.size(listed) > 0, F.concat(F.lit(f"    <properties>\n      <prophead>\n{heads}      </prophead>\n"), _each(listed, row), F.lit("    </properties>\n"))).otherwise(F.lit(""))
    cells = lambda r: F.concat(F.lit("            <row>\n"), _each(r, lambda c: _whole(c, "              <entry>", "</entry>\n")), F.lit("            </row>\n"))
    t = F.col("model_table")
    size = F.coalesce(F.size(t["columns"]), F.lit(0)).cast("string")
    inside = F.concat(cells(t["columns"]), F.lit("          </thead>\n          <tbody>\n"), _each(t["rows"], cells))
    shown = F.concat(F.lit('    <section>\n      <table>\n        <tgroup cols="'), size, F.lit('">\n          <thead>\n'), inside, F.lit("          </tbody>\n        </tgroup>\n      </table>\n    </section>\n"))
    return F.concat(opening, F.lit("\n"), properties, F.lit("\n"), F.when(t.isNotNull(), shown).otherwise(F.lit("")), F.lit("\n"), _sections(False))


def render(fixed: DataFrame, raw: str = "answer", kind: str = "type", title: str = "title") -> DataFrame:
    """Adds model_id and model_xml, the topic with all that its type has a place for, and makes the ids of sections unique.

    The record's own title goes before the chunk's; a null value counts as empty. An unknown type has a null topic.
    """
    j, t, name = F.col(raw), F.col(kind), F.coalesce(F.col(title), F.lit(""))
    ident = F.lit(None).cast("string")
    for one in BODIES:
        ident = F.when(t == one, root_id(j, name, f"{one.lower()}_id")).otherwise(ident)
    rows = fixed.withColumn("model_id", ident)
    ids = unique_ids(F.transform("model_sections", lambda s: s["id"]), F.array(slug(name), F.col("model_id")))
    named = F.zip_with("model_sections", ids, lambda s, i: s.withField("id", i))
    rows = rows.withColumn("model_sections", F.when(F.col("model_sections").isNotNull(), named))
    shown = F.coalesce(F.get_json_object(j, "$.title"), name)
    short = F.concat(_line(_value(j, "short_description"), "  <shortdesc>", "</shortdesc>\n\n"))
    xml = F.lit(None).cast("string")
    for one, body in (("Task", _task_body(j)), ("Concept", _concept_body(j)), ("Reference", _reference_body(j))):
        xml = F.when(t == one, tidy(frame(one, F.col("model_id"), shown, body, short))).otherwise(xml)
    return rows.withColumn("model_xml", xml)
