"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doculith.llm.common import cut, fresh

#: A table of source rates is broadcast up to this many sources and entries; with more, Spark joins it by key and splits a hot source.
BROADCAST_SOURCES, BROADCAST_ENTRIES = 10_000, 2_000_000
#: Tables of probabilities start at 0, or from this number on where Stirling's series has a double's precision.
STIRLING = 100
#: Copies of a document that one row lists at once.
PART = 4096


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone: the first 48 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def poisson_cdfs(rated: DataFrame, key: str, rate: str, first: str, cdf: str) -> DataFrame:
    """(key, rate, first, cdf) for each row with a positive rate: P(X <= k) for k = first, first + 1, ...

    k covers the rate by 12 standard deviations and 30 on both sides, so a table grows with the root of its rate; what
    lies outside has a probability under 1e-30. Terms are summed from logarithms, and no rate underflows.
    """
    r = F.col(rate)
    low = F.floor(r - 12 * F.sqrt(r) - 30)
    low = F.when(low >= STIRLING, low).otherwise(F.lit(0)).cast("long")
    last = F.ceil(r + 12 * F.sqrt(r) + 30).cast("long")
    # log P(X = low): 0! is 1, and the factorial of a larger number is Stirling's series, exact to a double's precision.
    x = F.col("low").cast("double")
    factorial = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    begun = F.when(F.col("low") == 0, -r).otherwise(x * F.log(r) - r - factorial)
    rows = rated.where(r > 0).select(key, rate, low.alias("low"), last.alias("last")).withColumn("log", begun)
    rows = rows.select(key, rate, "low", "log", F.explode(F.sequence("low", "last")).alias("k"))
    up_to = Window.partitionBy(key, rate).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    term = F.exp(F.col("log") + F.sum(F.when(F.col("k") == F.col("low"), F.lit(0.0)).otherwise(F.log(F.col(rate) / F.col("k")))).over(up_to))
    rows = rows.withColumn("p", term).withColumn("c", F.sum("p").over(up_to))
    pairs = F.sort_array(F.collect_list(F.struct("k", "c")))
    return rows.groupBy(key, rate).agg(F.min("low").alias(first), F.transform(pairs, lambda e: e["c"]).alias(cdf))


def rates(docs: DataFrame, weights: dict[str, float], default: float, source_col: str, text_col: str) -> DataFrame:
    """(source, rate, first, cdf) for each source that has any copies: the mean repetitions that bring it to its share of all characters.

    A source that `weights` lacks, null included, weighs `default`. A source of weight 0 or without a character has no row.
    """
    size = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("chars"))
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
    weight = F.coalesce(given[F.coalesce("source", F.lit(""))] if given is not None else F.lit(None).cast("double"), F.lit(float(default)))
    size = cut(size.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0))))
    all_weight, all_chars = size.agg(F.sum("weight"), F.sum("chars")).first()
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(all_weight) * F.lit(all_chars).cast("double") / F.col("chars")).otherwise(F.lit(0.0))
    return cut(poisson_cdfs(size.select("source", rate.alias("rate")), "source", "rate", "first", "cdf"))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each document as often as a hash-seeded Poisson variable says, dealt and sorted by a hash of document and copy.

    The mean is the repetition rate that brings the document's source to its target weight, the whole keeping
    about its characters. Adds mix_copies, mix_copy (1 to mix_copies) and mix_key, the place in the global order; a
    column of docs that has such a name stays, and the added one gets an underscore behind it.
    Empty and null texts are documents as any other; rows with one id, or without one, get one count; an empty table
    stays empty.
    """
    copies, copy, key = (fresh(name, docs.columns) for name in ("mix_copies", "mix_copy", "mix_key"))
    by = rates(docs, weights, default, source_col, text_col)
    size = by.agg(F.count("*"), F.sum(F.size("cdf"))).first()
    work = {name: fresh(f"llm_{name}", docs.columns) for name in ("source", "first", "cdf", "u", "part")}
    by = by.select(*[F.col(name).alias(work[name]) for name in ("source", "first", "cdf")])
    by = F.broadcast(by) if size[0] <= BROADCAST_SOURCES and (size[1] or 0) <= BROADCAST_ENTRIES else by
    joined = docs.join(by, docs[source_col].eqNullSafe(by[work["source"]]), "inner").withColumn(work["u"], uniform(seed, F.col(id_col)))
    below = F.size(F.filter(work["cdf"], lambda c: c < F.col(work["u"]))).cast("long")
    # No entry below the drawn number means `first` itself, which is 0 unless P(X < first) is negligible.
    counted = joined.withColumn(copies, F.col(work["first"]) + below).where(F.col(copies) > 0)
    # Copies are listed in parts, so that no row holds a long list of them.
    parts = counted.withColumn(work["part"], F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / PART))))
    start = F.col(work["part"]) * PART
    listed = parts.withColumn(copy, F.explode(F.sequence(start + 1, F.least(start + PART, F.col(copies)))))
    named = F.concat_ws("|", F.lit(f"{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy).cast("string"))
    return listed.withColumn(key, F.md5(named.cast("binary"))).select(*docs.columns, copies, copy, key).repartition(key).sortWithinPartitions(key)
