"""Removal of word sequences that an earlier document holds, by matching statistics against suffix automata of reference shards.

A window is a number of consecutive words. Each window chooses one of its short cores by content, so equal windows
choose equal cores, and the successive windows that choose the same core form a passage. Only passages whose core
another document holds too can lose words. Their first occurrences, one of each content, are the reference. It is cut
into shards of bounded size by core, and each shard becomes a suffix automaton over whole words whose states know the
least document that holds their strings. The passages that can meet a shard stream through its automaton; where at
least a window's length matches and the state's least document is smaller, the window is removed, and so are the
maximal spans that these windows cover. A core that only one content surrounds has nothing to be compared with.

An automaton is sent only to the task that owns its shard, and the passages come there: sent to all tasks, each shard
would cost a pass over all documents. Equal passages of many documents come once. A core with very many different
passages is no part of a shard: its windows are counted by their words in the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doculith.llm.common import Scratch, cut, fresh, lean, release, runs, slices, small_batches, utf8
from doculith.llm.suffix_dedup import Hashes, lowest, merged

#: Words of a core.
CORE = 4
#: Windows of this many words at most: a passage's windows are the bits of one number.
MOST_WORDS = 64
#: Words of a shard, about. A core with more different passages than HOT_CORE is compared by window.
SHARD_WORDS, HOT_CORE = 200_000, 2_000
#: A text is named by its order (the id) and a hash of id and content, so that texts that share an id are judged apart.
KEY = ["doc", "tag"]
PASSAGE = "core bigint, segment bigint, doc bigint, tag bigint, first int, more int"
#: The order of a row without an id: behind all others.
LAST = (1 << 63) - 1
_NO_SPACE = np.ones(256, bool)
_NO_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def words_of(own: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets): the words of rows in one buffer, in bytes, and the first word of each row."""
    solid = np.append(_NO_SPACE[data], False)
    edge = np.zeros(len(solid), bool)
    edge[own[:-1]] = True
    before = np.append(False, solid[:-1])
    starts = np.flatnonzero(solid & (edge | ~before))
    edge[-1] = True
    after = np.append(solid[1:] & ~edge[1:], False)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, own)


def _runs_of_windows(offsets: np.ndarray, hashes: Hashes, words: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last): runs of windows of one row that choose the same core, as positions in the word stream."""
    low = lowest((hashes.every(CORE) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes.sums) - CORE, dtype=np.uint64), words - CORE + 1)
    count = np.maximum(0, np.diff(offsets) - words + 1)
    rows = np.flatnonzero(count)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 4
    start = np.repeat(offsets[:-1][rows] - (np.cumsum(count[rows]) - count[rows]), count[rows]) + np.arange(count.sum())
    row = np.repeat(rows, count[rows])
    chosen = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])))
    tail = np.append(head[1:], len(start)) - 1
    return row[head], chosen[head], start[head], start[tail]


def passages(docs: DataFrame, words: int) -> DataFrame:
    """The passages of rows (doc, tag, text): hashes of core and content, the first window's word and how many more windows follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(2))
            doc, tag = (np.asarray(b.column(i)) for i in (0, 1))
            for start, stop in slices(offsets):
                own = offsets[start : stop + 1] - offsets[start]
                part = data[offsets[start] : offsets[stop]]
                starts, ends, at = words_of(own, part)
                if len(starts) < words:
                    continue
                hashes = Hashes(Hashes(part).of(starts, ends))
                row, anchor, first, last = _runs_of_windows(at, hashes, words)
                core = hashes.of(anchor, anchor + CORE)
                segment = hashes.of(first, last + words) + (anchor - first).astype(np.uint64)
                arrays = [core.view(np.int64), segment.view(np.int64), doc[start:stop][row], tag[start:stop][row], (first - at[row]).astype(np.int32), (last - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["core", "segment", "doc", "tag", "first", "more"])

    return docs.select(*KEY, "text").mapInArrow(lean(run), PASSAGE)


def _with_words(docs: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """(shard, core, segment, doc, words): the words of passages (doc, tag, first, more, ...), joined by spaces, as binary."""
    entry = F.struct("shard", "core", "segment", "first", "more")
    entries = found.groupBy(*KEY).agg(F.collect_list(entry).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                list_ = b.column(2).slice(i, 1).flatten().flatten()
                first, more = list_[3].to_pylist(), list_[4].to_pylist()
                texts = [b" ".join(own[f : f + m + words]) for f, m in zip(first, more, strict=True)]
                yield pa.RecordBatch.from_arrays([*list_[:3], pa.array([doc] * len(texts), pa.int64()), pa.array(texts, pa.binary())], names=["shard", "core", "segment", "doc", "words"])

    rows = docs.join(entries, KEY).select("doc", "text", "entries")
    return rows.mapInArrow(lean(run), "shard int, core bigint, segment bigint, doc bigint, words binary")


class SuffixAutomaton:
    """All substrings of some sequences of numbers; each state knows the least document that holds its strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST]

    def add(self, sequence: list[int], doc: int) -> None:
        next_, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in sequence:
            known = next_[last].get(w)
            if known is not None:  # of another sequence: go there, or to the part of it that is as long
                last = known if length[known] == length[last] + 1 else self._split(last, w, known)
                if doc < least[last]:
                    least[last] = doc
                continue
            state = len(next_)
            next_.append({})
            length.append(length[last] + 1)
            least.append(doc)
            at = last
            while at >= 0 and w not in next_[at]:
                next_[at][w] = state
                at = link[at]
            if at < 0:
                link.append(0)
            else:
                below = next_[at][w]
                link.append(below)
                if length[below] != length[at] + 1:
                    link[state] = self._split(at, w, below)
            last = state

    def _split(self, at: int, w: int, below: int) -> int:
        """A state for the strings of `below` that are not longer than those of `at` with `w`."""
        next_, link, length = self.next, self.link, self.length
        part = len(next_)
        next_.append(next_[below].copy())
        link.append(link[below])
        length.append(length[at] + 1)
        self.least.append(LAST)
        link[below] = part
        while at >= 0 and next_[at].get(w) == below:
            next_[at][w] = part
            at = link[at]
        return part

    def settle(self) -> None:
        """Hands the least documents on to the states of shorter strings; once, after the last sequence."""
        least, link = self.least, self.link
        for state in np.argsort(-np.array(self.length), kind="stable")[:-1].tolist():
            if least[state] < least[link[state]]:
                least[link[state]] = least[state]

    def matched(self, sequence: list[int], size: int) -> list[int]:
        """For each place where a known string of `size` numbers ends, from `size` - 1 on, its least document; else LAST."""
        next_, link, length, least = self.next, self.link, self.length, self.least
        state = long = 0
        out = []
        for w in sequence:
            while state and w not in next_[state]:
                state = link[state]
                long = length[state]
            to = next_[state].get(w)
            if to is not None:
                state, long = to, long + 1
                while length[link[state]] >= size:  # longer matches are of no interest
                    state = link[state]
                    long = length[state]
            out.append(least[state] if long >= size else LAST)
        return out[size - 1 :]


def _judged(sharded: DataFrame, words: int) -> DataFrame:
    """(core, segment, hit): the windows of each passage, as bits, that a smaller document holds; one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            names: dict[bytes, int] = {}
            texts = [[names.setdefault(w, len(names)) for w in raw.split(b" ")] for raw in t.column("words").to_pylist()]
            docs = t.column("doc").to_pylist()
            automaton = SuffixAutomaton()
            for text, doc in zip(texts, docs, strict=True):
                automaton.add(text, doc)
            automaton.settle()
            hits = [sum(1 << j for j, least in enumerate(automaton.matched(text, words)) if least < doc) for text, doc in zip(texts, docs, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("core").combine_chunks(), t.column("segment").combine_chunks(), pa.array(hits, pa.int64())], names=["core", "segment", "hit"])

    # Equal rows of the table have each passage as often; a shard's task gets it once.
    once = sharded.repartition("shard").groupBy("shard", "core", "segment").agg(F.first("doc").alias("doc"), F.first("words").alias("words"))
    dealt = once.sortWithinPartitions("shard", "core", "doc")
    return dealt.mapInArrow(lean(run), "core bigint, segment bigint, hit bigint")


def _judged_by_window(passages_: DataFrame, words: int) -> DataFrame:
    """The same for cores of very many passages: windows are grouped by their words, and hot ones are split in the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, bits, texts = [], [], []
            for i, raw in enumerate(b.column(3).to_pylist()):
                own = raw.split(b" ")
                for j in range(len(own) - words + 1):
                    rows.append(i)
                    bits.append(1 << j)
                    texts.append(b" ".join(own[j : j + words]))
            took = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*took, pa.array(bits, pa.int64()), pa.array(texts, pa.binary())], names=["core", "segment", "doc", "bit", "window"])

    windows = passages_.select("core", "segment", "doc", "words").mapInArrow(lean(run), "core bigint, segment bigint, doc bigint, bit bigint, window binary")
    least = windows.groupBy("window").agg(F.min("doc").alias("least"))
    found = windows.join(least, "window").groupBy("core", "segment")
    return found.agg(F.bit_or(F.when(F.col("least") < F.col("doc"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("hit"))


def candidates(docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """The passages whose core another document holds too; a core of very many documents is split in the join."""
    found = passages(docs, words)
    cores = found.groupBy("core").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("core")
    shared = scratch.keep(cores)
    release(docs.sparkSession)
    return scratch.keep(found.join(shared, "core"))


def first_passages(found: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(core, segment, doc, tag, first, more, shard): the first passage of each content.

    A core that only one content surrounds has no shard: there is nothing that its passage could meet but itself. The
    passages of a core with very many contents have shard -1.
    """
    first = F.min(F.struct("doc", "tag", "first", "more")).alias("f")
    rows = scratch.keep(found.groupBy("core", "segment").agg(first).select("core", "segment", "f.*"))
    contents = scratch.keep(rows.groupBy("core").agg(F.count("*").alias("contents"), F.sum(F.col("more") + words).alias("size")).where("contents > 1"))
    size = contents.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("core"), F.lit(max(1, -(-size // SHARD_WORDS)))).cast("int")
    shards = contents.select("core", F.when(F.col("contents") > HOT_CORE, F.lit(-1)).otherwise(shard).alias("shard"))
    return rows.join(shards, "core", "left")


def removed_spans(docs: DataFrame, words: int) -> DataFrame:
    """(doc, tag, entries): for rows (doc, tag, text), the maximal spans of words, as structs (start, end), that windows
    of a row with a smaller `doc` cover; rows that lose nothing are left out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    found = candidates(docs, words, scratch)
    release(spark)
    reference = first_passages(found, words, scratch)
    texts = scratch.keep(_with_words(docs, reference.where("shard is not null"), words))
    release(spark)
    hits = _judged(texts.where("shard >= 0"), words).union(_judged_by_window(texts.where("shard < 0"), words))
    known = scratch.keep(reference.select("core", "segment", F.col("doc").alias("holder")).join(hits, ["core", "segment"], "left"))
    release(spark)
    out = cut(_spans(found, known, words))
    scratch.drop()
    release(spark)
    return out


def _spans(found: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """The spans of each text; a content of very many documents is split in the join. `known` has the first document of each content, and its hits."""
    # Of equal passages only the first document's can keep words.
    every = F.expr("shiftleft(2L, more) - 1")
    hit = F.when(F.col("doc") > F.col("holder"), every).otherwise(F.coalesce("hit", F.lit(0)))
    lost = found.join(known, ["core", "segment"]).select(*KEY, "first", hit.alias("hit")).where("hit <> 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for own in b.column(2).to_pylist():
                windows = [x["first"] + j for x in own for j in range(x["hit"].bit_length()) if x["hit"] >> j & 1]
                out.append([{"start": s, "end": e} for s, e in merged([(w, w + words) for w in windows])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=[*KEY, "entries"])

    grouped = lost.groupBy(*KEY).agg(F.collect_list(F.struct("first", "hit")).alias("windows"))
    return grouped.mapInArrow(lean(run), "doc bigint, tag bigint, entries array<struct<start:int,end:int>>")


def _apply(rows: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(1))
            out = []
            for i, cuts in enumerate(b.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                kept, at = [], 0
                for span in cuts or ():
                    kept += own[at : span["start"]]
                    at = span["end"]
                kept += own[at:]
                out.append((len(own), len(own) - len(kept), [(s["start"], s["end"]) for s in cuts or ()], b" ".join(kept).decode()))
                if len(out) == 256 or i + 1 == len(b):
                    number, removed, cuts_, left = zip(*out, strict=True)
                    lists = pa.array([[{"start": s, "end": e} for s, e in c] for c in cuts_], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i + 1 - len(out), len(out)), pa.array(number, pa.int64()), pa.array(removed, pa.int64()), lists, pa.array(left, pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])
                    out = []

    joined = rows.join(spans, KEY, "left").select("id", "text", "entries")
    schema = f"id {kind}, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string"
    return joined.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", reference: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for each row; kept is what is left of its words, joined by one space.

    Words are separated by ASCII white space. A word goes if a window of `words` words covers it whose sequence also
    starts in a row with a smaller id; or, given a `reference` with a column of the same name, in any row of that.
    Windows are judged on the input. spans are the removed runs, as (start, end) in words.

    A null text has no words. Rows that share an id do not remove each other's words; a row without an id is behind
    all others. Equal rows have equal results. Ids are integers; other columns are not read. An empty table gives no
    row, an empty reference removes nothing. Texts may be of any length.
    """
    if not CORE <= words <= MOST_WORDS - 1:
        raise ValueError(f"a window has {CORE} to {MOST_WORDS - 1} words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) if reference is None else F.lit(1).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), order.alias("doc"), F.xxhash64(F.col(id_col), text).alias("tag"), text.alias("text"))
    judged = rows.select(*KEY, "text")
    if reference is not None:
        known = F.coalesce(F.col(text_col), F.lit(""))
        judged = judged.union(reference.select(F.lit(0).cast("long"), F.xxhash64(known), known))
    with small_batches(docs.sparkSession):
        return _apply(rows, removed_spans(judged, words), id_col)


def digest(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `deduplicate` leaves, as a SHA-256 of the kept words."""
    found = deduplicate(docs, words, id_col, text_col)
    return found.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias(fresh("kept_sha256", [id_col])))
