"""Language identification with one interpolated Kneser-Ney character model per language.

The models live in sorted arrays of packed n-grams with one column of log probabilities per language. A text
gets the language of the lowest cross-entropy per symbol; a threshold calibrated on training texts rejects
texts that no model explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.llm.common import SYMBOL_BITS, cut, fold, give_back, grams, lean, sliced, symbols

ORDER = 5
#: One training text of so many is kept out of the counts, by a hash of its content; all of these calibrate score and limits.
CALIBRATION = 16
#: The share of a language's calibration texts that may lie above its rejection limit, and the limit's margin.
REJECTED, MARGIN = 0.001, 1.05
#: Slopes of the score to choose from.
SLOPES = (1, 2, 3, 5, 8, 12, 20, 30)
UNKNOWN = "und"
MASK = (1 << SYMBOL_BITS) - 1


@dataclass
class Model:
    langs: list[str]
    #: For order 1..ORDER: sorted n-grams, and log p(last | rest) by language, back-off included.
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    #: For context length 1..ORDER-1: sorted contexts, and the log of the back-off weight by language (0 if unseen).
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None  # log p of a symbol that a language never showed
    slope: float = 10.0
    limits: np.ndarray | None = None


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def log_probs(model: Model, key: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log p of the last symbol given the ones before, by language (float32), for packed n-grams of `order`."""
    if order == 0:
        return np.repeat(model.unseen[None, :], len(key), 0)
    at, hit = _find(model.keys[order - 1], key)
    out = model.logs[order - 1][at] if len(model.keys[order - 1]) else np.zeros((len(key), len(model.langs)), np.float32)
    miss = np.flatnonzero(~hit)
    if len(miss):
        rest = log_probs(model, key[miss] & ((1 << (SYMBOL_BITS * (order - 1))) - 1), order - 1)
        if order > 1 and len(model.contexts[order - 2]):
            c, known = _find(model.contexts[order - 2], key[miss] >> SYMBOL_BITS)
            rest = rest + np.where(known[:, None], model.backoffs[order - 2][c], np.float32(0))
        out[miss] = rest
    return out


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count) of a partition's texts; merged in the worker whenever much has gathered."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)

    for b in sliced(batches, "text"):
        langs = np.asarray(b.column(1).to_pylist(), object)
        stream, row, _ = symbols(b.column(0).to_pylist(), ORDER - 1)
        key, own = grams(stream, row, ORDER)
        code, names = np.zeros(len(b), np.int32), sorted(set(langs))
        for i, name in enumerate(names):
            code[langs == name] = i
        of = code[own]
        for i, name in enumerate(names):
            k, n = np.unique(key[of == i], return_counts=True)
            held.setdefault(name, []).append((k, n))
            size += len(k)
        if size > 2_000_000:
            held = {name: [merged(parts)] for name, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values()) // 4
    for name, parts in held.items():
        key, n = merged(parts)
        for i in range(0, len(key), 1 << 16):
            k = key[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k), pa.array(n[i : i + (1 << 16)])], names=["lang", "g", "n"])


def _estimate(langs: list[str], grams_of: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of left neighbours below, one discount an order."""
    model, size = Model(langs), len(langs)
    per: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
    unseen = np.zeros(size, np.float32)
    # One alphabet for all languages, and a share for symbols that none of them showed.
    base = 1.0 / (len(np.unique(np.concatenate([k & MASK for k, _ in grams_of.values()]))) + 1)
    for i, lang in enumerate(langs):
        key, n = grams_of[lang]
        levels = [(key, n)]
        for order in range(ORDER - 1, 0, -1):
            levels.append(np.unique(levels[-1][0] & ((1 << (SYMBOL_BITS * order)) - 1), return_counts=True))
        levels.reverse()
        made, below_key, below_p = [], np.zeros(0, np.int64), np.zeros(0)
        for order, (k, c) in enumerate(levels, 1):
            once, twice = int((c == 1).sum()), int((c == 2).sum())
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            ctx, at, kinds = np.unique(k >> SYMBOL_BITS, return_inverse=True, return_counts=True)
            total = np.bincount(at, c, len(ctx))
            weight = d * kinds / total
            if order == 1:
                lower = np.full(len(k), base)
            else:
                lower = below_p[np.searchsorted(below_key, k & ((1 << (SYMBOL_BITS * (order - 1))) - 1))]
            p = np.maximum(c - d, 0) / total[at] + weight[at] * lower
            if order == 1:
                unseen[i] = np.log(weight[0] * base)
            made.append((k, p, ctx, weight))
            below_key, below_p = k, p
        per.append(made)
    model.unseen = unseen
    for order in range(1, ORDER + 1):
        if order > 1:
            ctx = np.unique(np.concatenate([m[order - 1][2] for m in per]))
            back = np.zeros((len(ctx), size), np.float32)
            for i, m in enumerate(per):
                back[np.searchsorted(ctx, m[order - 1][2]), i] = np.log(m[order - 1][3])
            model.contexts.append(ctx)
            model.backoffs.append(back)
        keys = np.unique(np.concatenate([m[order - 1][0] for m in per]))
        rest = log_probs(model, keys & ((1 << (SYMBOL_BITS * (order - 1))) - 1), order - 1)
        if order > 1:
            rest = rest + model.backoffs[-1][np.searchsorted(model.contexts[-1], keys >> SYMBOL_BITS)]
        for i, m in enumerate(per):
            rest[np.searchsorted(keys, m[order - 1][0]), i] = np.log(m[order - 1][1])
        model.keys.append(keys)
        model.logs.append(rest.astype(np.float32))
    return model


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol of each text under each language, and the texts' numbers of letters."""
    stream, row, letters = symbols(texts, ORDER - 1)
    key, own = grams(stream, row, ORDER)
    # Lookups of sorted queries stay in cache; each distinct n-gram of the slice is looked up once.
    order = np.argsort(key)
    ranked = key[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    log = log_probs(model, ranked[first])
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - 1
    length = np.maximum(1, np.bincount(own, minlength=len(texts)))
    total = np.stack([np.bincount(own, log[at, i], len(texts)) for i in range(len(model.langs))], 1)
    return -total / length[:, None], letters


def fit(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models from every text with a language for which `training` holds; each either counts or calibrates.

    A language all of whose texts calibrate is learned from them as well. Only text and language are read, besides
    what `training` reads.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if training is None else training))
    rows = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    apart = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(CALIBRATION)) == 0
    found = rows.groupBy("lang").agg(F.max(~apart).alias("counted")).collect()  # a row for each language
    if not found:  # nothing to learn from: every text is of an unknown language
        return Model([])
    few = [r["lang"] for r in found if not r["counted"]]
    counted = rows.where(~apart | F.col("lang").isin(few)) if few else rows.where(~apart)
    counts = counted.mapInArrow(lean(count), "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    grams_of, counts = {}, cut(counts)
    for name in sorted(r["lang"] for r in found):  # one language after another: every distinct n-gram, whose number grows with the texts
        got = counts.where(F.col("lang") == name).select("g", "n").toArrow()
        key, n = (got.column(i).to_numpy() for i in range(2))
        by = np.argsort(key)
        if len(key):
            grams_of[name] = (key[by], n[by])
    if not grams_of:
        return Model([])
    model = _estimate(sorted(grams_of), grams_of)
    del grams_of
    give_back()
    return _calibrated(model, rows.where(apart))


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """Fits the slope of the score and each language's rejection limit on texts that did not count, by aggregation in Spark."""
    model.limits = np.full(len(model.langs), np.inf)
    held = rows.sparkSession.sparkContext.broadcast(model)
    slopes = np.array(SLOPES, np.float64)

    def run(batches):
        for b in sliced(batches, "text"):
            h, letters = entropies(held.value, b.column(0).to_pylist())
            place = {name: i for i, name in enumerate(held.value.langs)}
            truth = np.array([place.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            ok = np.flatnonzero((letters > 0) & (truth >= 0))
            gap = h[ok] - h[ok].min(1, keepdims=True)
            own = gap[np.arange(len(ok)), truth[ok]]
            # log of the share that the right language has, by slope
            said = [-s * own - np.log(np.exp(-s * gap).sum(1)) for s in slopes]
            best = h[ok].argmin(1) == truth[ok]
            right = pa.array(np.where(best, h[ok, truth[ok]], np.nan), mask=~best)
            yield pa.RecordBatch.from_arrays([pa.array(truth[ok]), right, *map(pa.array, said)], names=["lang", "h", *(f"s{i}" for i in range(len(slopes)))])

    kinds = "lang bigint, h double, " + ", ".join(f"s{i} double" for i in range(len(slopes)))
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(len(slopes))]
    found = rows.mapInArrow(lean(run), kinds).groupBy("lang").agg(F.count("h").alias("n"), F.percentile_approx("h", 1 - REJECTED, 10_000).alias("limit"), *sums).collect()
    if found:
        model.slope = float(slopes[np.argmax([sum(r[f"s{i}"] for r in found) for i in range(len(slopes))])])
    limits = {r["lang"]: r["limit"] * MARGIN for r in found if r["n"]}
    if limits:  # a language without any such text has the highest limit of the others
        model.limits[:] = max(limits.values())
        model.limits[list(limits)] = list(limits.values())
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, cross_entropy) for each row.

    lang_pred is the language of the lowest cross-entropy per symbol, of equal ones the first by name; `und` with
    score 0 if the text is null or has no letter, or if the model learned no language. score is the calibrated share of that language, and accepted
    says that the cross-entropy is within its limit. Only id and text are read; repeated rows each give a row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # all n-grams that the texts hold

    def run(batches):
        m = held.value
        names = np.array([*m.langs, UNKNOWN], object)
        for b in sliced(batches, text_col):
            if not m.langs:
                n = len(b)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.float64())], names=["id", "lang_pred", "score", "accepted", "cross_entropy"])
                continue
            h, letters = entropies(m, b.column(1).to_pylist())
            best = h.argmin(1)
            low = h[np.arange(len(h)), best]
            p = 1 / np.exp(-m.slope * (h - low[:, None])).sum(1)
            none = letters == 0
            accepted = ~none & (low <= m.limits[best])
            best[none] = len(m.langs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(np.where(none, 0.0, p)), pa.array(accepted), pa.array(low, mask=none)], names=["id", "lang_pred", "score", "accepted", "cross_entropy"])

    out = docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, lang_pred string, score double, accepted boolean, cross_entropy double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept from training; false for a null id."""
    return F.coalesce(fold(id_col, modulus) == remainder, F.lit(False))
