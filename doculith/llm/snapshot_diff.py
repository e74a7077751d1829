"""The difference of two snapshots whose rows may have got new keys: a Grace hash join, by key and then by content.

Both snapshots are spilled into Parquet that is hash-partitioned alike (bucketed tables in the shared folder). A task
reads one bucket of each, builds a dictionary of the smaller snapshot's rows and probes it with the other's. What finds
no partner goes on: it is spilled again, hash-partitioned by content, and joined in the same way. Long columns are
spilled as SHA-256 digests.

Rows of one content queue up, the earlier ones by ascending and the later ones by descending key, and the heads of both
queues pair until one is empty. A queue is not held: a row's place in it comes from a sort by ranges of (content, key),
and the dictionary's keys are (content, place). So a content, or a repeated key, of any number of rows is dealt over
all tasks, and nothing that grows with the input goes to the driver, into a broadcast or through one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doculith.llm.common import Scratch, cut, fold, fresh

#: Rows of the smaller snapshot in one bucket, about: the dictionary that a task holds.
BUCKET_ROWS = 100_000


def _digest(df: DataFrame, column: str) -> Column:
    """SHA-256 of a value as binary; null for null."""
    kind = df.schema[column].dataType.simpleString()
    text = F.col(column) if kind in ("string", "binary") else F.to_json(F.struct(F.col(column).alias("v")))
    return F.when(F.col(column).isNotNull(), F.unhex(F.sha2(text, 256)))


def _digests(rows: DataFrame, key: str, columns: Sequence[str], carry: Mapping[str, Column]) -> DataFrame:
    """(name, key, d0, d1, ..., content, carried): the key as a name without null, digests by column and of them all."""
    parts = [_digest(rows, c).alias(f"d{i}") for i, c in enumerate(columns)]
    name = F.when(F.col(key).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    carried = F.struct(*(v.alias(c) for c, v in carry.items())) if carry else F.lit(None).cast("string")
    flat = rows.select(name.alias("name"), F.col(key).alias("key"), *parts, carried.alias("carried"))
    marks = [F.when(F.col(f"d{i}").isNull(), F.lit(b"0")).otherwise(F.concat(F.lit(b"1"), F.col(f"d{i}"))) for i in range(len(columns))]
    return flat.withColumn("content", F.unhex(F.sha2(F.concat(*marks), 256)))


def queued(rows: DataFrame, queue: str, *order: Column) -> DataFrame:
    """`rows` with `place`: 0, 1, ... by `order` within each value of `queue`, which is never null.

    Rows are sorted by ranges; a queue may span many of them. Each range counts its rows by queue, and a place is the
    place inside of the range plus the counts of the queue in the ranges before. Nothing but these counts, at most one a
    range, comes together for one queue.
    """
    dealt = rows.repartitionByRange(F.col(queue), *order).sortWithinPartitions(F.col(queue), *order)
    ranged = cut(dealt.withColumns({"piece": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy(queue, "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(queue).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(queue, "piece", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(starts, [queue, "piece"]).withColumn("place", F.col("at") + F.col("shift")).drop("piece", "at", "shift")


class Spill(Scratch):
    """Tables in the shared folder, of which some are hash-partitioned Parquet, and their removal."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "snapshots")
        self.names: list[str] = []

    def bucketed(self, rows: DataFrame, on: Sequence[str], buckets: int) -> DataFrame:
        name = f"doculith_{uuid.uuid4().hex}"
        writer = rows.repartition(buckets, *on).write.bucketBy(buckets, *on).option("path", f"{self.folder}/{name}")
        writer.format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        super().drop()


def grace_join(spill: Spill, earlier: DataFrame, later: DataFrame, on: list[str], sizes: tuple[int, int]) -> DataFrame:
    """The full outer join of two spilled sides, whose other columns differ in name; the smaller one becomes the dictionary."""
    buckets = max(int(spill.spark.conf.get("spark.sql.shuffle.partitions")), -(-min(sizes) // BUCKET_ROWS))
    left, right = (spill.bucketed(side, on, buckets) for side in (earlier, later))
    if sizes[0] <= sizes[1]:
        left = left.hint("shuffle_hash")
    else:
        right = right.hint("shuffle_hash")
    return left.join(right, on, "full")


def difference(earlier: DataFrame, later: DataFrame, key: str, columns: Sequence[str], carry: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, old_key, op, changed, ...): one row per pair, insertion and deletion between two snapshots.

    Rows of equal keys pair: `same`, or `update` with the differing `columns` in `changed`. Of the others, rows of
    equal content in `columns` pair as `rekey`: the i-th smallest earlier key with the i-th largest later key. What
    remains is `insert` or `delete`. `key` is the later key, for a deletion the earlier one; `old_key` is null for an
    insertion. `carry` names expressions over later rows that go along; they are null for a deletion.

    Null keys equal null keys, null values null values. Where a key repeats, its rows pair one by one in the order of
    their contents' digests, and the surplus is unpaired; null is the smallest key. Other columns are not read. An
    empty snapshot makes all rows of the other insertions or deletions. Texts of any length go as digests.
    """
    names = list((carry or {}).keys())
    taken = ["key", "old_key", "op", "changed"]
    if clash := {n.lower() for n in names} & set(taken):
        raise ValueError(f"carried columns cannot be named {sorted(clash)}")
    spill = Spill(earlier.sparkSession)
    own = [f"d{i}" for i in range(len(columns))]

    def named(rows: DataFrame, side: str, on: Sequence[str]) -> DataFrame:
        return rows.select(*on, *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in on))

    first = [spill.keep(_digests(s, key, columns, c)) for s, c in ((earlier, {}), (later, carry or {}))]
    sizes = tuple(s.count() for s in first)
    sides = [queued(s, "name", F.col("content")) for s in first]
    by_key = ["name", "place"]
    met = spill.keep(grace_join(spill, named(sides[0], "a", by_key), named(sides[1], "b", by_key), by_key, sizes))
    paired = F.col("a_content").isNotNull() & F.col("b_content").isNotNull()
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{d}").eqNullSafe(F.col(f"b_{d}")), F.lit(c)) for d, c in zip(own, columns, strict=True))))
    none = F.array().cast("array<string>")

    def result(rows: DataFrame, op: Column, changed: Column) -> DataFrame:
        extra = [F.col(f"b_carried.{n}").alias(n) for n in names]
        late = F.col("b_content").isNotNull()
        return rows.select(F.when(late, F.col("b_key")).otherwise(F.col("a_key")).alias("key"), F.col("a_key").alias("old_key"), op.alias("op"), changed.alias("changed"), *extra)

    kept = result(met.where(paired), F.when(F.size(differ) == 0, "same").otherwise("update"), differ)
    left = [met.where(F.col("b_content").isNull()).select("a_key", F.col("a_content").alias("content")), met.where(F.col("a_content").isNull()).select("b_key", "b_carried", F.col("b_content").alias("content"))]
    sizes = tuple(s.count() for s in left)
    orders = [F.col("a_key").asc_nulls_first(), F.col("b_key").desc_nulls_last()]
    by_content = ["content", "place"]
    queues = [queued(s, "content", o).withColumn(f"{x}_content", F.col("content")) for s, o, x in zip(left, orders, "ab", strict=True)]
    moved = spill.keep(grace_join(spill, *queues, by_content, sizes))
    op = F.when(F.col("a_content").isNull(), "insert").when(F.col("b_content").isNull(), "delete").otherwise("rekey")
    out = cut(kept.unionByName(result(moved, op, none)))
    spill.drop()
    return out


def later_snapshot(docs: DataFrame) -> DataFrame:
    """A later state of documents (doc_id, text, lang, source), changed by crc32 of the decimal id modulo 10.

    0 drops the row, 1 appends `+` to the text (null becomes `+`), 2 swaps lang and source, 3 changes the key to
    -1 - key, 4 does so and makes source null, 5 adds a copy under -1 - key. A row without an id stays as it is.
    """
    kind = fresh("fold", docs.columns)
    rows = docs.select("doc_id", "text", "lang", "source").withColumn(kind, F.coalesce(fold("doc_id", 10), F.lit(-1)))
    k, key = F.col(kind), F.col("doc_id")
    keys = F.when(k.isin(3, 4), F.array(-1 - key)).when(k == 5, F.array(key, -1 - key)).otherwise(F.array(key))
    text = F.when(k == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    lang = F.when(k == 2, F.col("source")).otherwise(F.col("lang"))
    source = F.when(k == 2, F.col("lang")).when(k != 4, F.col("source"))
    return rows.where(k != 0).select(F.explode(keys).alias("doc_id"), text.alias("text"), lang.alias("lang"), source.alias("source"))


def row_sha256(*columns: str) -> Column:
    """SHA-256 of the values, joined by line feeds, null as `~`."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("~")) for c in columns)), 256)
