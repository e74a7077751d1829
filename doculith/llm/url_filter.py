"""Exact URL rules from a cascade of Bloom filters: neither the filters' making nor a url's verdict joins anything.

Odd levels hold listed keys, even levels the keys of the corpus that the level before let through wrongly.
The keys that can be asked are all known beforehand, so the cascade ends in no error at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.llm.common import cut, lean

#: The first level is made so fine that about this many keys of the corpus pass it wrongly at most, however large the corpus.
FALSE_POSITIVES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


@dataclass(frozen=True)
class Filter:
    bits: int
    hashes: int
    words: np.ndarray

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for i in range(self.hashes):
            at = (h1 + i * h2) % self.bits
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def shape_of(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at a false positive rate."""
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2))) if n else 1


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every text that a listed rule for this url can have, the longest first: only shapes that rules have are made."""
    labels = F.split(host, r"\.")
    made = [F.when((F.size(labels) >= n) & (F.length(path) >= m) & (host != ""), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]
    # Of equally long keys the one with the longer path comes last, so the longer host wins.
    found = F.array_distinct(F.array_compact(F.array(*made))) if made else F.array().cast("array<string>")
    return F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)))


def hashed(key: Column) -> tuple[Column, Column]:
    """Two hashes of 40 bits, so that their multiples for all levels stay far from overflow."""
    return F.xxhash64(key).bitwiseAND(F.lit(2**40 - 1)), F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(2**40 - 1))


def filter_of(keys: DataFrame, n: int, rate: float, level: int) -> Filter:
    """A filter over the column key: bits are merged by word in the cluster, and only words reach the driver.

    Each level has a modulus of its own, so keys that collide on one level part on another.
    """
    bits, hashes = shape_of(n, rate)
    bits = (bits | 1) + 2 * level
    h1, h2 = hashed(F.col("key"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h1 + i.cast("long") * h2) % bits)
    rows = keys.select(F.explode(spots).alias("at")).groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).collect()
    words = np.zeros(bits // 64 + 1, np.uint64)
    for r in rows:
        words[r["word"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
    return Filter(bits, hashes, words)


def passing(keys: DataFrame, level: Filter) -> DataFrame:
    """The rows of keys whose key the filter holds."""

    def run(batches):
        for b in batches:
            h1, h2 = (np.asarray(b.column(i)) for i in (1, 2))
            yield b.select(["key"]).filter(pa.array(level.holds(h1, h2)))

    h1, h2 = hashed(F.col("key"))
    return keys.select("key", h1.alias("h1"), h2.alias("h2")).mapInArrow(lean(run), "key string")


def cascade(listed: DataFrame, universe: DataFrame) -> list[Filter]:
    """Levels that decide for every key of the universe whether it is listed.

    What passes the first level is few: the listed keys and some others. These are told apart by an aggregation.
    """
    n, size = listed.count(), universe.count()
    if n == 0:
        return []
    rate = min(0.5, FALSE_POSITIVES / max(1, size), 0.01)
    levels = [filter_of(listed, n, rate, 0)]
    marked = passing(universe, levels[0]).withColumn("own", F.lit(0)).union(listed.select("key", F.lit(1).alias("own")))
    outside = cut(marked.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key"))
    inside, outside = outside, listed
    while n := inside.count():
        levels.append(filter_of(inside, n, 0.5 if len(levels) > 1 else 0.25, len(levels)))
        inside, outside = cut(passing(outside, levels[-1])), inside
    return levels


def listed_in(levels: list[Filter], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A key is listed if the first level that lacks it is an even one, or none lacks it and the levels are odd in number."""
    answer = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for i, level in enumerate(levels):
        held = level.holds(h1[open_], h2[open_])
        answer[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    answer[open_] = len(levels) % 2 == 1
    return answer


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row.

    Host and path of a null url or one without :// are empty, and no rule fits an empty host. The longest rule
    wins, of equally long ones the first in code point order, and block if one key has both actions. Without a
    rule the verdict is `default`. Only the url is read; repeated rows each give a row, an empty table none.
    """
    shapes = sorted({r.shape for r in rules})
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), shapes))
    universe = cut(rows.select(F.explode("keys").alias("key")).distinct())
    spark = pages.sparkSession
    actions = sorted({r.action for r in rules}, key=lambda a: a != "block")
    built = [cascade(spark.createDataFrame(sorted({(r.key,) for r in rules if r.action == a}), "key string"), universe) for a in actions]
    held = spark.sparkContext.broadcast(built)  # the filters' bits

    def run(batches):
        names = pa.array([*actions, default], pa.string())
        for b in batches:
            keys, h1, h2 = (b.column(i) for i in (3, 4, 5))
            flat = keys.flatten()
            a, c = (np.asarray(x.flatten()) for x in (h1, h2))
            row = np.repeat(np.arange(len(b)), np.diff(np.asarray(keys.offsets)))
            action = np.full(len(a), len(actions))
            for i in reversed(range(len(actions))):
                action[listed_in(held.value[i], a, c)] = i
            hit = np.flatnonzero(action < len(actions))
            _, first = np.unique(row[hit], return_index=True)  # keys stand in order, the longest first
            chosen, taken = np.full(len(b), -1), hit[first]
            chosen[row[taken]] = taken
            rule = flat.take(pa.array(chosen, mask=chosen < 0))
            verdict = names.take(pa.array(np.where(chosen < 0, len(actions), action[chosen] if len(action) else 0)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rule.cast(pa.string()), verdict], names=["id", "host", "path", "rule", "verdict"])

    asked = rows.withColumns({"h1": F.transform("keys", lambda k: hashed(k)[0]), "h2": F.transform("keys", lambda k: hashed(k)[1])})
    return asked.mapInArrow(lean(run), f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
