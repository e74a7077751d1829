"""Exact removal of repeated 200-byte strings with a sparse suffix array over content-defined anchors.

Of all suffixes only those at anchors are sorted. An anchor is a start that the content of a window chooses, so
equal windows choose equal suffixes. Sampled splitters range-partition the suffixes by their leading token, the
token of the whole core and the token of the whole segment (all bytes of the windows that choose the anchor),
into buckets of a bounded size; each bucket is sorted by multikey quicksort. A core that occurs once in the corpus leaves its windows unique, a
segment that occurs again makes them all repeated. Segments whose core alone occurs again are compared window
by window; so are the suffixes at a bucket's ends, which may go on in the next bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doculith.llm.common import cut, lean, runs, slices, small_batches, utf8

#: Bytes of an anchor's core; every window of the wanted length holds a core that its content alone chooses.
CORE = 50
#: Entries of suffixes or spans that are broadcast to the documents at most; beyond, documents are joined by a shuffle.
BROADCAST_ENTRIES = 1_500_000
#: A core with more segments to compare sends its windows one by one, so that no task gets them all.
HOT_CORE = 20_000
#: Least and most suffixes of a bucket, about, and how many of them are sampled for its splitter. Buckets grow with the
#: root of the suffixes, so that neither they nor the splitters outgrow a machine.
BUCKET, MOST_BUCKET, SAMPLED = 25_000, 1_000_000, 8
#: Ranges up to this size are sorted at once.
SMALL_SORT = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse; kept in the worker."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 21)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse))]
    return _POWERS[0]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hashes of all substrings of a buffer, from sums of bytes times powers."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def every(self, size: int) -> np.ndarray:
        """Of the substrings of one size at each start."""
        n = max(0, len(self.sums) - size)
        return _mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def lowest(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, by doubling."""
    span, low = 1, value
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(offsets: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, hashes): each anchor with the first and last start of the windows that choose it.

    A window chooses the start, among those of its cores, of the least core hash, the leftmost of equal ones.
    All are positions in `data`.
    """
    hashes = Hashes(data)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, hashes
    width = window - CORE + 1
    value = (hashes.every(CORE) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(data) - CORE + 1, dtype=np.uint64)
    low = (lowest(value, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    # Starts of windows inside of one row.
    begin, count = offsets[:-1] - offsets[0], np.maximum(0, size - window + 1)
    rows = np.flatnonzero(count)
    start = np.repeat(begin[rows] - (np.cumsum(count[rows]) - count[rows]), count[rows]) + np.arange(count.sum())
    row = np.repeat(rows, count[rows])
    chosen = low[start]
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]))) if len(start) else none
    last = np.append(first[1:], len(start)) - 1 if len(start) else none
    return row[first], chosen[first], start[first], start[last], hashes


#: A text is named by its id and a hash of its content, so that texts that share an id, or have none, are judged apart.
KEY = ["doc", "tag"]
SUFFIX = "bucket int, lead bigint, core bigint, segment bigint, doc bigint, tag bigint, anchor int, first int, last int"
_NAMES = ["bucket", "lead", "core", "segment", "doc", "tag", "anchor", "first", "last"]
#: The tokens by which suffixes are ordered; a suffix of very many copies is told apart by its text and place.
ORDER = ["lead", "core", "segment", "doc", "anchor"]


def suffixes(docs: DataFrame, window: int, splitters: list[np.ndarray] | None = None) -> DataFrame:
    """The suffixes at anchors of rows (doc, tag, text): their tokens, positions in the text's bytes, and the bucket between `splitters`."""
    held = docs.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(2))
            doc, tag = (np.asarray(b.column(i)) for i in (0, 1))
            for start, stop in slices(offsets):
                own = offsets[start : stop + 1] - offsets[start]
                part = data[offsets[start] : offsets[stop]]
                row, anchor, first, last, hashes = anchors(own, part, window)
                if not len(row):
                    continue
                lead = np.zeros(len(row), np.uint64)
                for i in range(8):
                    lead = (lead << np.uint64(8)) | part[anchor + i].astype(np.uint64)
                signed = lambda x: (x ^ np.uint64(1 << 63)).view(np.int64)  # noqa: E731  keeps the order of unsigned numbers
                lead, core = signed(lead), signed(hashes.of(anchor, anchor + CORE))
                segment = signed(hashes.of(first, last + window) ^ _mix((anchor - first).astype(np.uint64)))
                begin = own[row]
                anchor, first, last = ((x - begin).astype(np.int32) for x in (anchor, first, last))
                tokens = [lead, core, segment, doc[start:stop][row], anchor]
                bucket = located(held.value, tokens) if held.value is not None else np.zeros(len(row), np.int32)
                arrays = [bucket, *tokens[:4], tag[start:stop][row], anchor, first, last]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=_NAMES)

    return docs.select(*KEY, "text").mapInArrow(lean(run), SUFFIX)


def located(splitters: list[np.ndarray], tokens: list[np.ndarray]) -> np.ndarray:
    """The number of splitters that are at most each suffix, by its tokens in order; splitters are sorted."""
    low = np.searchsorted(splitters[0], tokens[0], "left")
    high = np.searchsorted(splitters[0], tokens[0], "right")
    open_ = np.flatnonzero(high > low)  # suffixes whose first token is that of a splitter: the other tokens decide
    low[open_] = _within(splitters, tokens, open_, low[open_], high[open_])
    return low.astype(np.int32)


def _within(splitters: list[np.ndarray], tokens: list[np.ndarray], rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Binary search among splitters[low:high], for all rows at once."""
    while (going := low < high).any():
        middle = np.minimum((low + high) // 2, len(splitters[0]) - 1)
        less, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
        for splitter, token in zip(splitters, tokens, strict=True):
            s, t = splitter[middle], token[rows]
            less |= same & (t < s)
            same &= t == s
        high = np.where(going & less, middle, high)
        low = np.where(going & ~less, middle + 1, low)
    return low


def sampled_splitters(docs: DataFrame, window: int) -> list[np.ndarray]:
    """Splitters for buckets of about BUCKET suffixes, from the suffixes of texts that a hash chooses; they only deal out work.

    The sample is as large as the number of buckets asks, whatever the number of texts.
    """
    size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    expected = 2 * (size[1] or 0) / (window - CORE + 2)  # a window of w starts chooses two anchors in w + 1 starts
    buckets = max(1, round(expected / min(MOST_BUCKET, max(BUCKET, 4 * expected**0.5))))
    if buckets == 1:
        return [np.zeros(0, np.int64)] * len(ORDER)
    share = min(1.0, SAMPLED * buckets / expected)
    # The root of the share of the texts, and of their suffixes, so that a long text does not speak for all.
    root = F.lit(round(share**0.5 * (1 << 30)))
    texts = docs.where(F.pmod(F.xxhash64(*KEY, F.lit(3)), F.lit(1 << 30)) < root)
    few = suffixes(texts, window).where(F.pmod(F.xxhash64(*ORDER, F.lit(4)), F.lit(1 << 30)) < root).select(*ORDER).toArrow()
    columns = [few.column(i).to_numpy() for i in range(len(ORDER))]
    order = multikey_order(columns)
    at = order[np.linspace(0, len(order), buckets + 1)[1:-1].astype(np.int64)] if len(order) else order
    return [c[at] for c in columns]


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens, by multikey quicksort.

    A range of rows that agree up to some token is parted by a pivot of that token into smaller, equal and larger
    ones; only the equal ones go on to the next token. Small ranges are sorted at once.
    """
    order = np.arange(len(tokens[0]))
    open_ = [(0, len(order), 0)]
    while open_:
        low, high, depth = open_.pop()
        if high - low < 2 or depth == len(tokens):
            continue
        rows = order[low:high]
        if high - low <= SMALL_SORT:
            order[low:high] = rows[np.lexsort([t[rows] for t in tokens[depth:][::-1]])]
            continue
        value = tokens[depth][rows]
        pivot = np.sort(value[:: max(1, len(value) // 15)])[7 if len(value) >= 15 else 0]
        less, more = value < pivot, value > pivot
        a, c = int(less.sum()), int(more.sum())
        order[low:high] = np.concatenate([rows[less], rows[~less & ~more], rows[more]])
        open_ += [(low, low + a, depth), (low + a, high - c, depth + 1), (high - c, high, depth)]
    return order


#: What is known of a suffix: its segment occurs again; or its windows are yet to be compared, for itself or for others.
FULL, OPEN, WITNESS = 1, 2, 3


def judged(ranged: DataFrame) -> DataFrame:
    """(doc, tag, core, anchor, first, last, state) of the suffixes of each bucket that may hold a repeated window; one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            yield from judge(t.combine_chunks())

    def judge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lead, core, segment, doc, tag, anchor, first, last = (t.column(i).to_numpy() for i in range(1, 9))
        order = multikey_order([lead, core, segment])
        lead, core, segment, doc, tag, anchor, first, last = (x[order] for x in (lead, core, segment, doc, tag, anchor, first, last))
        as_core = np.append(False, (core[1:] == core[:-1]) & (lead[1:] == lead[:-1]))
        as_segment = as_core & np.append(False, segment[1:] == segment[:-1])
        repeated = as_core | np.append(as_core[1:], False)
        full = as_segment | np.append(as_segment[1:], False)
        group = np.cumsum(~as_core) - 1
        edge = np.zeros(group[-1] + 1, bool)  # groups with a segment that this bucket has once, or that may go on
        edge[group[repeated & ~full]] = True
        edge[[0, -1]] = True
        lone = ~full & (repeated | edge[group])
        witness = full & ~as_segment & edge[group]
        parts = [(np.flatnonzero(full), FULL), (np.flatnonzero(lone), OPEN), (np.flatnonzero(witness), WITNESS)]
        at = np.concatenate([p for p, _ in parts])
        state = np.concatenate([np.full(len(p), k, np.int32) for p, k in parts])
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(tag[k]), pa.array(core[k]), pa.array(anchor[k]), pa.array(first[k]), pa.array(last[k]), pa.array(state[i : i + (1 << 16)])], names=["doc", "tag", "core", "anchor", "first", "last", "state"])

    return ranged.mapInArrow(lean(run), "doc bigint, tag bigint, core bigint, anchor int, first int, last int, state int")


def with_texts(docs: DataFrame, entries: DataFrame, how: str) -> DataFrame:
    """The documents (doc, tag, text, ...) with their array `entries`; broadcast while it is small, else shuffled."""
    size = entries.agg(F.sum(F.size("entries"))).first()[0] or 0
    return docs.join(F.broadcast(entries) if size <= BROADCAST_ENTRIES else entries, KEY, how)


def segments(docs: DataFrame, undecided: DataFrame, window: int) -> DataFrame:
    """(core, doc, tag, anchor, first, state, hot, bytes): the bytes of the segments to compare."""
    entry = F.struct("core", "anchor", "first", "last", "state", "hot")
    entries = cut(undecided.groupBy(*KEY).agg(F.collect_list(entry).alias("entries")))
    rows = with_texts(docs, entries, "inner").select(*KEY, F.encode("text", "utf-8").alias("raw"), F.explode("entries").alias("e")).select(*KEY, "raw", "e.*")
    return rows.select("core", *KEY, "anchor", "first", "state", "hot", F.expr(f"substring(raw, first + 1, last - first + {window})").alias("bytes"))


def _windows(t: pa.Table, window: int) -> tuple[np.ndarray, ...]:
    """Of rows (core, doc, tag, anchor, first, state, bytes): the row, the start in the text and a key of each window."""
    raw = t.column("bytes").combine_chunks()
    offsets, data = raw.buffers()[1:3]
    at = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    hashes = Hashes(np.frombuffer(data, np.uint8)[at[0] : at[-1]])
    at = at - at[0]
    count = np.maximum(0, np.diff(at) - window + 1)
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][row] + step
    start = t.column("first").to_numpy()[row] + step
    offset = (t.column("anchor").to_numpy()[row] - start).astype(np.uint64)
    core = t.column("core").to_numpy().view(np.uint64)[row]
    return row, start, _mix(hashes.of(begin, begin + window) + core * _BASE + offset)


_SPAN = "doc bigint, tag bigint, start int, end int"


def _spans(t: pa.Table, row: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """The spans of successive repeated windows of each row."""
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
    tail = np.append(head[1:], len(row)) - 1
    doc, tag = (t.column(name).to_numpy()[row[head]] for name in KEY)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start[head].astype(np.int32)), pa.array((start[tail] + window).astype(np.int32))], names=[*KEY, "start", "end"])


def compared(parts: DataFrame, window: int) -> DataFrame:
    """(doc, tag, start, end): repeated windows of OPEN segments, each core in one task, a few thousand segments at a time."""
    dealt = parts.select("core", *KEY, "anchor", "first", "state", "bytes").repartition("core").sortWithinPartitions("core")

    def decide(t: pa.Table) -> Iterator[pa.RecordBatch]:
        row, start, key = _windows(t, window)
        if not len(row):
            return
        order = np.argsort(key)
        ranked = key[order]
        same = np.append(False, ranked[1:] == ranked[:-1])
        again = np.zeros(len(key), bool)
        again[order] = same | np.append(same[1:], False)
        again &= (t.column("state").to_numpy() == OPEN)[row]
        if again.any():
            yield _spans(t, row[again], start[again], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.slice(i, 2048)
                core = np.asarray(part.column(0))
                last = held[-1].column(0)[-1].as_py() if held else None
                if size >= 4096:  # up to the end of the core that is under way
                    stop = int(np.searchsorted(core, last, "right")) if core[0] == last else 0
                    if stop < len(part):
                        yield from decide(pa.Table.from_batches([*held, part.slice(0, stop)]))
                        held, size, part = [], 0, part.slice(stop)
                held.append(part)
                size += len(part)
        if held:
            yield from decide(pa.Table.from_batches(held))

    return dealt.mapInArrow(lean(run), _SPAN)


def compared_by_window(parts: DataFrame, window: int) -> DataFrame:
    """The same for cores with very many segments: windows are counted by key in the cluster, and hot keys are split in the join."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2048):
                t = pa.Table.from_batches([b.slice(i, 2048)])
                row, start, key = _windows(t, window)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(t.column(name).to_numpy()[row]) for name in KEY), pa.array(start.astype(np.int32)), pa.array(t.column("state").to_numpy()[row])], names=["key", *KEY, "start", "state"])

    rows = parts.select("core", *KEY, "anchor", "first", "state", "bytes").mapInArrow(lean(explode), "key bigint, doc bigint, tag bigint, start int, state int")
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return rows.where(F.col("state") == OPEN).join(often, "key").select(*KEY, "start", (F.col("start") + window).alias("end"))


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc, tag, start, end) in bytes: spans, overlapping or not, that cover what repeated windows cover."""
    found = suffixes(docs, window, sampled_splitters(docs, window))
    state = cut(judged(found.repartition("bucket").sortWithinPartitions("bucket")))
    full = state.where(F.col("state") == FULL).select(*KEY, F.col("first").alias("start"), (F.col("last") + window).alias("end"))
    undecided = state.where(F.col("state") != FULL)
    hot = cut(undecided.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CORE).select("core", F.lit(True).alias("hot")))
    if hot.limit(1).count() == 0:
        return full.union(compared(segments(docs, undecided.withColumn("hot", F.lit(False)), window), window))
    marked = undecided.join(hot, "core", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    texts = cut(segments(docs, marked, window))
    return full.union(compared(texts.where(~F.col("hot")), window)).union(compared_by_window(texts.where("hot"), window))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def deduplicate(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row; kept is what is left of the UTF-8 bytes, as binary.

    A byte goes if a string of `window` bytes covers it that starts anywhere else too, in any row. A null text is
    empty. Rows that share an id, or have none, are texts of their own; equal rows repeat each other. Other columns
    are not read, and an empty table gives no row.
    """
    if window < CORE:
        raise ValueError(f"a window has at least {CORE} bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A row without an id is named by two hashes of its text.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text, F.lit(7))).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        entries = cut(_merged_by_doc(repeated_spans(rows, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[(x["start"], x["end"]) for x in e] if e else [] for e in b.column(2).to_pylist()]
            texts = b.column(1)
            out = []
            for i, cuts in enumerate(lists):
                raw = texts[i].as_buffer()
                raw = memoryview(raw) if raw is not None else memoryview(b"")
                at, kept = 0, []
                for start, end in cuts:
                    kept.append(raw[at:start])
                    at = end
                kept.append(raw[at:])
                out.append((len(raw), sum(e - s for s, e in cuts), len(cuts), b"".join(kept)))
                if len(out) == 256 or i + 1 == len(lists):
                    first = i + 1 - len(out)
                    sizes, removed, number, left = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(out)), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(left, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])
                    out = []

    joined = with_texts(rows, entries, "left").select("id", "text", "entries")
    return joined.mapInArrow(lean(run), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)


def _merged_by_doc(spans: DataFrame) -> DataFrame:
    """(doc, tag, entries): the maximal removed runs of each document with any, as sorted structs (start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in r])] for r in b.column(2).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, kind)], names=[*KEY, "entries"])

    grouped = spans.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(lean(run), "doc bigint, tag bigint, entries array<struct<start:int,end:int>>")


def digest(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `deduplicate` leaves, as a SHA-256 of the kept bytes."""
    return deduplicate(docs, window, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
