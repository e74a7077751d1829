"""Typed records of chunks: steps of a task, paragraphs of a concept, the table of a reference; constraints and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions import messages
from doculith.functions.text import blank, let, slug, strip
from doculith.operators.classify import settled

SECTION = "array<struct<id:string,content:string>>"
NUMBERED, BULLET = r"^\s*\d+\.\s*(.+)$", r"^\s*[-*]\s*(.+)$"
SEPARATOR = r"^\s*\|[\s\-:]+\|"


def steps(content: Column) -> Column:
    """The commands of numbered lines; only if there are none, those of lines with - or *. All other text is left out."""
    # A line that matches has a text of at least one character, blank or not; each is matched once.
    found = lambda lines, p: F.filter(F.transform(lines, lambda x: F.regexp_extract(x, p, 1)), lambda x: x != "")
    taken = lambda lines, p: F.transform(found(lines, p), strip)
    either = lambda lines: let(taken(lines, NUMBERED), lambda n: F.when(F.size(n) > 0, n).otherwise(taken(lines, BULLET)))
    return let(F.split(content, "\n"), either)


def paragraphs(content: Column) -> Column:
    """The trimmed pieces between blank lines that are not blank."""
    return F.filter(F.transform(F.split(content, "\n\n"), strip), lambda p: p != "")


def cells(line: Column) -> Column:
    """The trimmed texts between the first and the last bar."""
    none = F.array().cast("array<string>")
    inner = lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), strip)
    return let(F.split(line, r"\|"), lambda parts: F.when(F.size(parts) > 2, inner(parts)).otherwise(none))


def table(content: Column) -> Column:
    """(columns, rows) of the first table: the line before its separator, and the lines up to one that is blank or has no bar. Null without a table."""

    def found(lines: Column, at: Column) -> Column:
        rows = let(F.slice(lines, at + 2, F.size(lines)), body)
        return F.when(at.isNotNull(), F.struct(cells(F.get(lines, at - 1)).alias("columns"), rows.alias("rows")))

    def body(after: Column) -> Column:
        ends = lambda i: (i == F.size(after)) | blank(F.coalesce(F.get(after, i), F.lit(""))) | ~F.coalesce(F.get(after, i), F.lit("")).contains("|")
        stop = F.get(F.filter(F.sequence(F.lit(0), F.size(after)), ends), F.lit(0))
        return F.filter(F.transform(F.slice(after, 1, stop), cells), lambda r: F.size(r) > 0)

    separator = lambda lines: F.get(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i > 0) & F.get(lines, i).rlike(SEPARATOR)), F.lit(0))
    return let(F.split(content, "\n"), lambda lines: let(separator(lines), lambda at: found(lines, at)))


def root_id(title: Column) -> Column:
    """The record's identifier: a title is named three times on its way, so the third form of the slug stays."""
    return F.concat(slug(title), F.lit("_2"))


def section_ids(title: Column, texts: Column) -> Column:
    """Sections named section_2, section_3, ...; a name that the title's three forms took gets the next free suffix."""

    def named(base: Column, text: Column, i: Column) -> Column:
        name = F.concat(F.lit("section_"), (i + 2).cast("string"))
        free = F.when(base == name, F.concat(name, F.lit("_3"))).when(F.concat(base, F.lit("_2")) == name, F.concat(name, F.lit("_1"))).when(F.concat(base, F.lit("_1")) == name, F.concat(name, F.lit("_1"))).otherwise(name)
        return F.struct(free.alias("id"), text.alias("content"))

    return let(slug(title), lambda base: F.transform(texts, lambda text, i: named(base, text, i)))


def records(chunks: DataFrame, kind: str = "type") -> DataFrame:
    """Adds record_id, steps, introduction, sections, columns and rows; what a type has not is null. An unknown type has only nulls and an error."""
    c, t = F.coalesce(F.col("content"), F.lit("")), F.col(kind)
    known = t.isin("Task", "Concept", "Reference")
    title = F.coalesce(F.col("title"), F.lit(""))
    rows = chunks.withColumns({"_p": F.when(t == "Concept", paragraphs(c)), "_t": F.when(t == "Reference", table(c))})
    out = rows.withColumns(
        {
            "record_id": F.when(known, root_id(title)),
            "steps": F.when(t == "Task", steps(c)),
            "introduction": F.when(t == "Concept", F.coalesce(F.get("_p", F.lit(0)), F.lit(""))),
            "sections": F.when(t == "Concept", section_ids(title, F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))))),
            "columns": F.col("_t.columns"),
            "rows": F.col("_t.rows"),
            "record_error": F.when(~known, F.concat(F.lit(messages.UNKNOWN_TYPE), t)),
        }
    )
    return settled(out.drop("_p", "_t"))


def constraint_errors(kind: Column) -> Column:
    """What a record lacks, as messages: the body element, which no record has, and what its type asks for."""
    n = F.coalesce(F.size("steps"), F.lit(0))
    body = F.when(kind == "Task", F.lit("taskbody")).when(kind == "Concept", F.lit("conbody")).when(kind == "Reference", F.lit("refbody"))
    found = [
        F.concat(F.lit(messages.MISSING_ELEMENT), body),
        F.when((kind == "Task") & (n < 1), F.format_string(messages.FEW_STEPS, F.lit(1), n)),
        F.when((kind == "Concept") & (F.coalesce("introduction", F.lit("")) == "") & (F.coalesce(F.size("sections"), F.lit(0)) == 0), F.lit(messages.EMPTY_CONCEPT)),
    ]
    return F.array_compact(F.array(*found))


def suggestions(errors: Column) -> Column:
    """Advice for each constraint message."""
    one = lambda e: F.when(e.startswith(messages.MISSING_ELEMENT), messages.SUGGEST_ELEMENT).when(e.startswith("steps"), messages.SUGGEST_STEP).when(e == messages.EMPTY_CONCEPT, messages.SUGGEST_CONCEPT).otherwise(F.concat(F.lit(messages.SUGGEST_OTHER), e))
    return F.transform(errors, one)


def fix(records_: DataFrame, kind: str = "type") -> DataFrame:
    """Fills what a type needs: a step, an introduction, a section."""
    t = F.col(kind)
    no_steps = (t == "Task") & (F.size("steps") == 0)
    bare = (t == "Concept") & (F.col("introduction") == "") & (F.size("sections") == 0)
    no_table = (t == "Reference") & F.col("columns").isNull()
    # The texts that fill gaps.
    info = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("Reference information").alias("content")))
    return records_.withColumns(
        {
            "steps": F.when(no_steps, F.array(F.lit("Complete the task"))).otherwise(F.col("steps")),
            "introduction": F.when(bare, F.lit("This is a concept description.")).otherwise(F.col("introduction")),
            "sections": F.when(no_table, info).otherwise(F.col("sections")),
        }
    )
