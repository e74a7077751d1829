"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment.

Items are cut into overlapping segments, so a passage of an item is found as well as the whole. A segment of
m symbols that occurs in a text with at most k edits shares m - q + 1 - k q of its q-grams with the text, on
diagonals that differ by k at most. Regions that reach this count are aligned; those within k edits stay.
Counts and alignments stay inside of one text. Symbols are lower-cased letters and digits, every run of other
characters being one symbol. A verbatim passage of SEGMENT + STRIDE - 1 symbols holds a whole segment wherever it
begins, and so does a shorter item that occurs whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doculith.llm.common import grams, lean, sliced, symbols

Q = 12
SEGMENT, STRIDE = 64, 16
#: Edits allowed in a segment, as a share of its symbols; fewer where the lemma's count would fall under LEAST_SHARED.
EDIT_RATE = 0.05
LEAST_SHARED = 5
#: Items are searched in blocks of about this many characters, each with one pass over the documents; an index takes 18 bytes a character.
BLOCK_CHARS = 4_000_000
_BITMAP = 20


@dataclass
class Index:
    stream: np.ndarray  # the symbols of all items, one after another
    item: np.ndarray  # by segment; segments are in the order of their starts
    start: np.ndarray  # of the segment in the stream
    size: np.ndarray
    budget: np.ndarray
    gram: np.ndarray  # sorted
    at: np.ndarray  # where the gram starts in the stream
    bitmap: np.ndarray

    def pattern(self, segment: np.ndarray) -> np.ndarray:
        """segments x SEGMENT symbols, -1 beyond the end."""
        step = np.arange(SEGMENT)
        at = np.minimum(self.start[segment][:, None] + step, max(0, len(self.stream) - 1))
        return np.where(step < self.size[segment][:, None], self.stream[at].astype(np.int32), -1)


def qgrams(stream: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the q-gram that starts at each position, and those positions, within one text."""
    n = max(0, len(stream) - Q + 1)
    four = np.zeros(max(0, len(stream) - 3), np.uint64)
    for i in range(4):
        four = (four << np.uint64(12)) | stream[i : i + len(four)].astype(np.uint64)
    h = four[:n] * np.uint64(0x9E3779B97F4A7C15) + four[4 : 4 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h = (h + four[8 : 8 + n]) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    at = np.flatnonzero(row[:n] == row[Q - 1 : Q - 1 + n])
    return h, at


def build(items: list[tuple[int, str | None]]) -> Index:
    streams, owner, item, start, size, total = [], [], [], [], [], 0
    for key, text in items:
        stream, _, _ = symbols([text], 0, digits=True)
        stream = stream[:-1] if len(stream) and stream[-1] == 0 else stream
        stream = stream[1:] if len(stream) and stream[0] == 0 else stream
        n = len(stream)
        if n < Q:
            continue
        begins = [0] if n <= SEGMENT else [*range(0, n - SEGMENT, STRIDE), n - SEGMENT]
        streams.append(stream)
        owner.append(np.full(n, len(owner), np.int32))
        item += [key] * len(begins)
        start += [total + s for s in begins]
        size += [min(n, SEGMENT)] * len(begins)
        total += n
    none = np.zeros(0, np.uint16)
    stream, own = np.concatenate([none, *streams]), np.concatenate([none.astype(np.int32), *owner])
    size = np.array(size, np.int64)
    budget = np.clip(np.minimum((size * EDIT_RATE).astype(np.int64), (size - Q + 1 - LEAST_SHARED) // Q), 0, None)
    h, at = qgrams(stream, own)
    order = np.argsort(h[at], kind="stable")
    bitmap = np.zeros(1 << _BITMAP, bool)
    bitmap[(h[at] >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
    at = at[order]
    return Index(stream, np.array(item, np.int64), np.array(start, np.int64), size, budget, h[at], at.astype(np.int32), bitmap)


def align(doc: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, pattern: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate the fewest edits that turn its pattern into a substring of doc[begin : begin + SEGMENT + width],
    with diagonals 0 to `width`, and where that substring ends. What lies outside of doc[low:high] matches nothing."""
    n, far = len(begin), 1 << 20
    diag = np.arange(width + 1)
    cost = np.zeros((n, width + 1), np.int32)  # before the pattern: free start on each diagonal
    best, end = np.full(n, far, np.int32), begin.copy()
    for i in range(SEGMENT):
        at = begin[:, None] + i + diag
        c = np.where((at >= low[:, None]) & (at < high[:, None]), doc[np.clip(at, 0, max(0, len(doc) - 1))], -9)
        step = cost + (c != pattern[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a pattern symbol is missing in the text
        step = np.minimum.accumulate(step - diag, 1) + diag  # symbols of the text are extra
        cost = step.astype(np.int32)
        done = size == i + 1
        if done.any():
            best[done] = cost[done].min(1)
            end[done] = begin[done] + i + cost[done].argmin(1) + 1
    return best, np.clip(end, low, high)


def search(index: Index, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(row, segment, start, end, edits): start and end are symbol positions in the row."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    stream, row, _ = symbols(texts, 1, digits=True)
    if len(stream) < Q or not len(index.gram):
        return none
    h, at = qgrams(stream, row)
    at = at[index.bitmap[(h[at] >> np.uint64(64 - _BITMAP)).astype(np.int64)]]
    lo = np.searchsorted(index.gram, h[at], "left")
    n = np.searchsorted(index.gram, h[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return none
    hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pos, place = np.repeat(at, n), index.at[hit].astype(np.int64)
    # The segments that hold the whole gram: their starts are in order, and a segment of another item ends before it.
    lo = np.searchsorted(index.start, place + Q - SEGMENT, "left")
    n = np.searchsorted(index.start, place, "right") - lo
    segment = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pos, place = np.repeat(pos, n), np.repeat(place, n)
    whole = index.start[segment] + index.size[segment] >= place + Q
    segment, pos, place = segment[whole], pos[whole], place[whole]
    diagonal = pos - (place - index.start[segment])
    # Bands of twice the stride overlap by half, so diagonals that differ by k at most share a band. Rows count apart.
    stride = int(index.budget.max()) + 1
    band = np.concatenate([diagonal // stride, diagonal // stride - 1])
    low = band.min()
    wide = int(band.max() - low) + 1
    own = np.concatenate([row[pos], row[pos]]).astype(np.int64)
    place = own * wide + (band - low)  # bands of one row; a slice's symbols bound their number
    segment, place, shared = _counted(np.concatenate([segment, segment]), place)
    own, band = place // wide, place % wide + low
    need = index.size[segment] - Q + 1 - index.budget[segment] * Q
    segment, own, band = (x[shared >= need] for x in (segment, own, band))
    budget = int(index.budget.max())
    begin = band * stride - budget
    first = np.searchsorted(row, own).astype(np.int64)
    last = np.searchsorted(row, own, "right").astype(np.int64)
    out = [[] for _ in range(2)]
    doc = stream.astype(np.int32)
    for i in range(0, len(begin), 4096):
        part = slice(i, i + 4096)
        found = align(doc, begin[part], first[part], last[part], 2 * stride + 2 * budget, index.pattern(segment[part]), index.size[segment[part]])
        for o, x in zip(out, found, strict=True):
            o.append(x)
    if not out[0]:
        return none
    edits, end = (np.concatenate(o) for o in out)
    ok = edits <= index.budget[segment]
    edits, end, segment, own, first = edits[ok].astype(np.int64), end[ok], segment[ok], own[ok], first[ok]
    return own, segment, np.maximum(0, end - index.size[segment] - first), end - first, edits


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two columns, and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new], np.diff(np.append(new, len(a)))


MATCH = "item_id bigint, n_segments bigint, start bigint, end bigint, edits bigint"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for i in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i)
        yield build([tuple(r) for r in own.orderBy("k", "t").collect()])  # about BLOCK_CHARS characters


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_segments, start, end, edits) for each document row and item of which it holds a segment.

    start and end are the first and last symbol of the matches; edits are the fewest of one segment. Items
    and texts that are null or have under Q symbols match nothing; repeated rows each give their rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for index in _blocks(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for b in sliced(batches, text_col):
                row, segment, start, end, edits = search(held.value, b.column(1).to_pylist())
                if not len(row):
                    continue
                item = held.value.item[segment]
                order = np.lexsort((item, row))
                row, segment, item, start, end, edits = (x[order] for x in (row, segment, item, start, end, edits))
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
                kinds = [len(set(s.tolist())) for s in np.split(segment, first[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[first])), pa.array(item[first]), pa.array(kinds, pa.int64()), pa.array(np.minimum.reduceat(start, first)), pa.array(np.maximum.reduceat(end, first)), pa.array(np.minimum.reduceat(edits, first))], names=["id", "item_id", "n_segments", "start", "end", "edits"])

        part = docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, {MATCH}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"id {kind}, {MATCH}")
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, all columns, that hold no segment of an item; whether a row stays depends on its own text alone.

    Null, empty and blank texts stay, repeated rows stay or go together, and no column but the text is looked at.
    Items that are null or have under Q symbols match nothing; without items, or without rows, all rows stay.
    """
    at = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for b in sliced(batches, text_col):
                keep = np.ones(len(b), bool)
                keep[search(held.value, b.column(at).to_pylist())[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
