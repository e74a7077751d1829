"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from doculith.llm.common import SYMBOL_BITS, cut, fresh, give_back, grams, lean, sliced, small_batches, symbols, unique

#: Sizes of the n-grams, of letters and word boundaries.
ORDERS = (4, 5)
#: About so many labelled rows of each class are fitted, chosen by a hash of the id; a documented bound. Every n-gram of them is a feature.
SAMPLE = 2_000
#: SMOOTH and PENALTY are those of the highest area under the curve in a three-fold cross-validation within the training
#: rows of a small table, out of thirteen settings; rows that are held out had no part in it.
#: Rows added to those that have a feature, dealt to the classes as all rows are, so that no evidence is a ratio of 1.
SMOOTH = 4.0
#: Passes over the sample, rows of a step, the size of a step, and the weight of the squared coefficients.
EPOCHS, STEP_ROWS, RATE, PENALTY = 16, 64, 0.5, 1.6e-3


@dataclass(frozen=True)
class Model:
    key: np.ndarray  # sorted n-grams
    weight: np.ndarray  # float32 by key; ratio times coefficient
    bias: float


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The (row, n-gram) of each place of the texts; an n-gram of a shorter order is marked above the bits of the longest."""
    stream, row, _ = symbols(texts, 1)
    found = [grams(stream, row, order) for order in ORDERS]
    mark = [np.int64(order < max(ORDERS)) << np.int64(SYMBOL_BITS * max(ORDERS)) for order in ORDERS]
    return np.concatenate([own for _, own in found]).astype(np.int64), np.concatenate([key | m for (key, _), m in zip(found, mark, strict=True)])


def distinct(row: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a row and a number under `size`, sorted."""
    bits = max(1, size - 1).bit_length()
    pair = unique((row << bits) | at)
    return pair >> bits, pair & ((1 << bits) - 1)


class Places:
    """Where a key stands among sorted keys: an open hash table, which few cache lines answer."""

    def __init__(self, key: np.ndarray):
        self.key, size = key, 64
        while size < 3 * len(key):
            size *= 2
        self.mask, self.slot = size - 1, np.full(size, -1, np.int32)
        left = np.arange(len(key), dtype=np.int32)
        at = self._first(key)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of keys with one slot the last stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _first(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(self.mask)).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is not there."""
        out = np.full(len(key), -1, np.int64)
        at, left = self._first(key), np.arange(len(key) if len(self.key) else 0)
        while len(left):
            place = self.slot[at]
            hit = (place >= 0) & (self.key[place] == key[left])
            out[left[hit]] = place[hit]
            more = (place >= 0) & ~hit
            left, at = left[more], (at[more] + 1) & self.mask
        return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, training) -> tuple[DataFrame, dict[int, int]]:
    """About SAMPLE labelled rows of each class as (text, y), and how many labelled ids each class has."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & training)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20))
    share = [F.when((F.col("y") == y) & (part < int(min(1.0, SAMPLE / n) * (1 << 20))), True) for y, n in sizes.items()]
    chosen = known.where(F.coalesce(*share, F.lit(False)))
    ids = spark.createDataFrame([tuple(r) for r in chosen.collect()], chosen.schema)  # about 2 * SAMPLE ids
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), F.col("own") == F.col("id")).select("text", "y"), sizes


def fit(docs: DataFrame, labels: DataFrame, training=None, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> Model:
    """The model from the labelled rows for which `training` holds.

    An id with both labels has label 1; labels that are null or neither 0 nor 1, and null ids, are left out. Without
    rows of both classes the model scores all texts by the share of label 1. Other columns are not read.
    """
    sample, sizes = _sample(docs, labels, id_col, label_col, text_col, F.lit(True) if training is None else training)
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    empty = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    if len(sizes) < 2:
        return empty
    sample = cut(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return [(key, *(np.bincount(at, np.concatenate([h[k] for h in held]), len(key)).astype(np.int64) for k in (1, 2)))]

        for b in sliced(batches, "text"):
            y = np.asarray(b.column(1))
            row, key = ngrams(b.column(0).to_pylist())
            names, at = np.unique(key, return_inverse=True)
            row, at = distinct(row, at, len(names))
            held.append((names, *(np.bincount(at[y[row] == k], minlength=len(names)) for k in (0, 1))))
            size += len(names)
            if size > 1_000_000:
                held = merged()
                size = len(held[0][0]) // 4
        for key, c0, c1 in merged() if held else ():
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(c0[part]), pa.array(c1[part])], names=["f", "c0", "c1"])

    counts = sample.mapInArrow(lean(count), "f bigint, c0 bigint, c1 bigint").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    got = counts.toArrow()  # the n-grams of 2 * SAMPLE texts
    n0, n1 = (sample.where(F.col("y") == k).count() for k in (0, 1))
    if not n0 or not n1 or not got.num_rows:
        return empty
    key, c0, c1 = (got.column(i).to_numpy() for i in range(3))
    order = np.argsort(key)
    key, ratio = key[order], log_count_ratio(c0[order], c1[order], n0, n1)
    held = docs.sparkSession.sparkContext.broadcast(key)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(held.value)
        for b in sliced(batches, "text"):
            row, feature = ngrams(b.column(0).to_pylist())
            row, feature = distinct(row, places.of(feature), len(held.value))
            cuts = np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.ListArray.from_arrays(cuts, feature.astype(np.int32))], names=["y", "f"])

    with small_batches(docs.sparkSession):
        rows = sample.mapInArrow(lean(gather), "y int, f array<int>").withColumn("o", F.xxhash64("f", "y")).toArrow()
    rows = rows.take(np.argsort(rows.column("o").to_numpy(), kind="stable"))  # the same order in every run
    lists = rows.column("f").combine_chunks()
    y = rows.column("y").to_numpy().astype(np.float32)
    coefficient, bias = logistic(np.asarray(lists.flatten()), np.asarray(lists.offsets), ratio, y)
    # The classes were sampled at their own rates; the bias returns to the share that they have.
    bias += np.log(sizes[1] / sizes[0]) - np.log(n1 / n0)
    del rows, lists
    give_back()
    return Model(key, coefficient * ratio, float(bias))


def log_count_ratio(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """log of the share of rows of label 1 that have the feature over that of label 0, smoothed."""
    add0, add1 = SMOOTH * n0 / (n0 + n1), SMOOTH * n1 / (n0 + n1)
    return (np.log((c1 + add1) / n1) - np.log((c0 + add0) / n0)).astype(np.float32)


def logistic(feature: np.ndarray, offsets: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression over rows of features, by steps of STEP_ROWS rows whose size adapts to each coefficient.

    The coefficients are the mean over the later half of the passes.
    """
    size, rng = len(value), np.random.default_rng(1)
    w, b = np.ones(size, np.float32), 0.0  # the start is naive Bayes itself, at a scale that the first steps find
    w *= np.float32(0.02)
    seen, seen_b = np.full(size, 1e-6, np.float32), 1e-6
    total, total_b, times = np.zeros(size, np.float32), 0.0, 0
    for epoch in range(EPOCHS):
        by = rng.permutation(len(y))
        for i in range(0, len(y), STEP_ROWS):
            own = by[i : i + STEP_ROWS]
            spans = [feature[offsets[r] : offsets[r + 1]] for r in own]
            at = np.concatenate(spans)
            row = np.repeat(np.arange(len(own)), [len(s) for s in spans])
            x = value[at]
            z = np.bincount(row, w[at] * x, len(own)) + b
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]
            grad = np.bincount(at, error[row] * x, size).astype(np.float32) / len(own) + np.float32(PENALTY) * w
            seen += grad * grad
            w -= np.float32(RATE) * grad / np.sqrt(seen)
            seen_b += float(error.mean()) ** 2
            b -= RATE * float(error.mean()) / seen_b**0.5
        if 2 * epoch >= EPOCHS:
            total, total_b, times = total + w, total_b + b, times + 1
    return total / np.float32(times), total_b / times


def scorer(model: Model):
    """texts -> scores between 0 and 1, for a worker."""
    places, size = Places(model.key), len(model.key)

    def score(texts: list[str | None]) -> np.ndarray:
        row, key = ngrams(texts)
        at = places.of(key) if size else np.full(len(key), -1)
        row, at = distinct(row[at >= 0], at[at >= 0], size)
        z = np.bincount(row, model.weight[at], len(texts)) + model.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return score


def _scored(docs: DataFrame, model: Model, columns: list[str], text_col: str, name: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # 12 bytes for each n-gram of 2 * SAMPLE texts
    df = docs.select(*columns)
    at = df.columns.index(text_col)
    schema = df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(held.value)
        for b in sliced(batches, text_col):
            found = score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, name])

    return df.mapInArrow(lean(run), StructType([*schema, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) for each row. An empty or null text has the score of the bias; repeated rows score alike; no other column is read."""
    out = _scored(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("llm_text")), model, [id_col, "llm_text"], "llm_text", "score").drop("llm_text")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, all columns, whose score is below the threshold; null and empty texts have the score of the bias, repeated rows stay or go together."""
    name = fresh("llm_toxicity_score", docs.columns)
    return _scored(docs, model, docs.columns, text_col, name).where(F.col(name) < threshold).drop(name)
