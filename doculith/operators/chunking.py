"""Splitting documents into chunks inside of each row: no shuffle, whatever the number of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions.text import blank, let, strip
from doculith.operators.classify import settled

HEADING = r"^#{2,3}\s+.+$"
CHUNK = "array<struct<title:string,level:int,content:string>>"
SIZE = 500


def by_headings(md: Column) -> Column:
    """The sections under headings of level 2 and 3 whose body is not blank: (title, level, content) in order.

    What stands before the first such heading is left out; other headings belong to the body. Fences are not seen.
    """

    def sections(lines: Column, heads: Column) -> Column:
        def section(head: Column, k: Column) -> Column:
            line = F.get(lines, head)
            stop = F.coalesce(F.get(heads, k + 1), F.size(lines))
            body = F.array_join(F.slice(lines, head + 2, stop - head - 1), "\n")
            return F.struct(
                strip(F.regexp_extract(line, r"^#{2,3}\s+(.+)$", 1)).alias("title"),
                F.length(F.regexp_extract(line, r"^(#{2,3})\s", 1)).alias("level"),
                F.when(stop - head > 1, F.concat(body, F.lit("\n"))).otherwise(F.lit("")).alias("content"),
            )

        return F.filter(F.transform(heads, section), lambda c: ~blank(c["content"]))

    # Lines are split once and headings found once: the work grows with the length of a document.
    heads = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).startswith("##") & F.get(lines, i).rlike(HEADING))
    return let(F.split(md, "\n"), lambda lines: let(heads(lines), lambda found: sections(lines, found)))


def by_size(text: Column, size: int = SIZE) -> Column:
    """Lines gathered greedily while they fit into `size` characters: ("Section n", 2, content) in order.

    A longer line is a chunk of its own; blank gatherings are left out.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        over = F.length(acc["cur"]) + F.length(line) > size
        emit = over & ~blank(acc["cur"])
        done = F.when(emit, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(over, F.concat(line, F.lit("\n"))).otherwise(F.concat(acc["cur"], line, F.lit("\n"))).alias("cur"))

    def finish(acc: Column) -> Column:
        return F.when(blank(acc["cur"]), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))

    parts = F.aggregate(F.split(text, "\n"), start, step, finish)
    return F.transform(parts, lambda c, i: F.struct(F.concat(F.lit("Section "), (i + 1).cast("string")).alias("title"), F.lit(2).alias("level"), c.alias("content")))


def _chunked(docs: DataFrame, text: str, size: int, how: str) -> DataFrame:
    """The rows with all their chunks as one array."""
    md = F.coalesce(F.col(text), F.lit(""))
    # The fold over lines runs only for rows that need it: headings are settled first, in a column of their own.
    found = docs.withColumn("_chunks", by_headings(md) if how != "size" else F.array().cast(CHUNK))
    if how != "headings":
        found = found.withColumn("_chunks", F.when((F.size("_chunks") > 0) | blank(md), F.col("_chunks")).otherwise(by_size(md, size)))
    # Spark filters for rows with chunks before it explodes them; above this node it looks at the array and does not make it again.
    return settled(found)


def chunk(docs: DataFrame, text: str = "markdown", size: int = SIZE, how: str = "auto") -> DataFrame:
    """One row per chunk: the other columns, chunk_no from 1, id, title, level, content.

    `auto` splits by headings, and by size where that leaves nothing of a text that is not blank.
    """
    others = [c for c in docs.columns if c != text]
    rows = _chunked(docs, text, size, how).select(*others, F.posexplode("_chunks").alias("_pos", "_chunk"))
    return rows.select(*others, (F.col("_pos") + 1).alias("chunk_no"), F.concat(F.lit("chunk_"), (F.col("_pos") + 1).cast("string")).alias("id"), "_chunk.title", "_chunk.level", "_chunk.content")


def preview(docs: DataFrame, text: str = "markdown", limit: int = 10, size: int = SIZE) -> DataFrame:
    """The first chunks of each document, and whether it has more; nothing is shuffled."""
    others = [c for c in docs.columns if c != text]
    rows = _chunked(docs, text, size, "auto").select(*others, (F.size("_chunks") > limit).alias("has_more"), F.posexplode(F.slice("_chunks", 1, limit)).alias("_pos", "_chunk"))
    return rows.select(*others, (F.col("_pos") + 1).alias("chunk_no"), "_chunk.title", "_chunk.level", "_chunk.content", "has_more")


def with_fallback(docs: DataFrame, chunks: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """The chunks, and for each document without any its whole text as one: id single_chunk, type Concept, confidence 0.8."""
    # Title, type and confidence of such a chunk.
    bare = docs.join(chunks.select(key).distinct(), key, "left_anti")
    whole = bare.select(key, F.lit(1).alias("chunk_no"), F.lit("single_chunk").alias("id"), F.lit("Untitled Document").alias("title"), F.lit(2).alias("level"), F.coalesce(F.col(text), F.lit("")).alias("content"), F.lit("Concept").alias("type"), F.lit(0.8).alias("confidence"))
    return chunks.unionByName(whole.select(*[c for c in whole.columns if c in chunks.columns]), allowMissingColumns=True)
