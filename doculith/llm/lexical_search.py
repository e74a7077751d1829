"""The best documents of each query text by summed term impacts, score at a time.

Every task turns its documents, a block at a time, into an index whose postings are grouped by term and exact impact.
A query takes the groups of its terms by descending impact, whatever their term, and adds to the documents' scores. It
stops only when the groups that remain prove that every document of its top k is among a few candidates: a document
that was not met cannot get more than the sum of the terms' next impacts, one that was met no more than its score and
that sum. The candidates' scores are then completed from their own postings. Bounds are those of integers, so the
answer is exact; the k-th score of one block is the first bound of the next.

Documents are never shuffled: tasks send the top k of their documents, which are merged in two steps.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doculith.llm.common import cut, fresh, lean, remove_folder, shared_folder, utf8

#: Terms are maximal runs of these bytes of UTF-8: ASCII letters and digits, and all of every other code point.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Entries (query, term) that are broadcast at once; more queries take another pass over the documents.
BROADCAST_ENTRIES = 500_000
#: Postings of a block: what a task holds at once, or one document's.
BLOCK_POSTINGS = 1 << 20
#: Candidates, as a multiple of k, whose scores are completed at most once they are proven to hold the top k.
CANDIDATES = 4
#: Groups that a query takes before it first compares bounds; twice as many each time.
FIRST_STEP = 512
#: Bytes of text whose terms are listed at once.
LONG = 1 << 22
_IMPACT_BITS = 40


def counted(text: bytes) -> Counter:
    """The terms of a text, only A-Z lower-cased, with their occurrences."""
    text = text.lower()
    if len(text) <= LONG:
        return Counter(TERM.findall(text))
    return Counter(m.group() for m in TERM.finditer(text))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, id, term, times): the terms of each query row; rows are told apart, also those that share an id."""
    kind = queries.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(1))
            for i in range(len(b)):
                found = counted(data[offsets[i] : offsets[i + 1]].tobytes())
                if found:
                    n = len(found)
                    ids = b.column(0).take(pa.array(np.full(n, i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([uuid.uuid4().hex] * n), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["id", "query", "term", "times"])

    return queries.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, query string, term binary, times bigint")


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, times) for each row (doc, text) with a term: its length, and the terms of `vocabulary` it holds."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            offsets, data = utf8(b.column(1))
            rows, sizes, count, terms, times = [], [], [0], [], []
            for i in range(len(b)):
                found = counted(data[offsets[i] : offsets[i + 1]].tobytes())
                if found:
                    hits = [(known[t], c) for t, c in found.items() if t in known]
                    rows.append(i)
                    sizes.append(found.total())
                    terms += [t for t, _ in hits]
                    times += [c for _, c in hits]
                    count.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "times"])

    return docs.mapInArrow(lean(run), "doc bigint, n bigint, terms array<int>, times array<bigint>")


class Block:
    """Documents of a task with their impact-ordered index."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, times: np.ndarray, weight: np.ndarray, total: int, length: int):
        self.doc, self.starts, self.terms = doc, starts, terms
        row = np.repeat(np.arange(len(doc)), np.diff(starts))
        m = 100 - 75 + (75 * n * total) // length
        self.impact = weight[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
        key = (terms.astype(np.int64) << _IMPACT_BITS) | ((1 << _IMPACT_BITS) - 1 - self.impact)
        order = np.argsort(key)
        self.rows = row[order]
        key = key[order]
        #: Where each group (term, impact) begins among the ordered postings, its impact, and the groups of each term.
        self.group = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.group, len(key)))
        self.level = self.impact[order][self.group]
        self.first = np.searchsorted(key[self.group] >> _IMPACT_BITS, np.arange(len(weight) + 1))

    def best(self, query: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of candidates that hold the block's part of the top k, their scores complete; `least`: k others have as much."""
        ends = self.first[query + 1]
        at = self.first[query]
        count = ends - at
        if not count.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(query)), count)
        groups = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        impact = self.level[groups] * times[which]
        order = np.argsort(-impact, kind="stable")
        which, groups, impact = which[order], groups[order], impact[order]
        score = np.zeros(len(self.doc), np.int64)
        done, step = 0, FIRST_STEP
        while done < len(groups):
            stop = min(len(groups), done + step)
            part = groups[done:stop]
            size = self.size[part]
            places = np.repeat(self.group[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(score, self.rows[places], np.repeat(impact[done:stop], size))
            at = at + np.bincount(which[done:stop], minlength=len(query))
            done, step = stop, step * 2
            left = at < ends
            bound = int((self.level[at[left]] * times[left]).sum())
            kth = max(least, int(np.partition(score, -k)[-k]) if len(score) >= k else 0)
            if bound < kth:
                found = np.flatnonzero(score + bound >= kth)
                if len(found) <= CANDIDATES * k:
                    return found, self.complete(found, query, times)
        found = np.flatnonzero(score >= max(1, least))
        if len(found) > k:  # all scores are complete
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        return found, score[found]

    def complete(self, rows: np.ndarray, query: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for i, r in enumerate(rows.tolist()):
            own = slice(self.starts[r], self.starts[r + 1])
            at = np.searchsorted(query, self.terms[own])
            hit = np.flatnonzero(query[np.minimum(at, len(query) - 1)] == self.terms[own])
            out[i] = (self.impact[own][hit] * times[at[hit]]).sum()
        return out


#: The id of a document without one; it is behind all others among equal scores.
_NO_ID = np.iinfo(np.int64).max


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, n, starts, terms, times) of so many rows that their postings fill a block."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held).combine_chunks()
        doc, n = (t.column(c).fill_null(_NO_ID).to_numpy() for c in ("doc", "n"))
        lists = [t.column(c).combine_chunks() for c in ("terms", "times")]
        starts = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        return doc, n, starts, *(x.flatten().to_numpy() for x in lists)

    for b in batches:
        ends = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False)) if len(b) else np.zeros(0, np.int64)
        begin = 0
        while begin < len(b):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + BLOCK_POSTINGS - size, "right")))
            held.append(b.slice(begin, stop - begin))
            size += int(ends[stop - 1] - base)
            begin = stop
            if size >= BLOCK_POSTINGS or stop < len(b):
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _ranked(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query, id, doc, score) of the top k of each query, rank aside; `terms` are those of a batch of queries."""
    spark = docs.sparkSession
    entries = terms.toArrow().combine_chunks()
    vocabulary = {t: i for i, t in enumerate(sorted(set(entries.column("term").to_pylist())))}
    by_query: dict[str, tuple[list[int], list[int]]] = {}
    for query, term, times in zip(*(entries.column(c).to_pylist() for c in ("query", "term", "times")), strict=True):
        own = by_query.setdefault(query, ([], []))
        own[0].append(vocabulary[term])
        own[1].append(times)
    asked = []
    for query, (own, times) in by_query.items():
        order = np.argsort(own)
        asked.append((query, np.array(own)[order], np.array(times, np.int64)[order]))
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    postings(docs, vocabulary).write.parquet(folder)
    held = spark.read.parquet(folder)
    total, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(vocabulary), np.int64)
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    having[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in having.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((asked, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for parts in _blocks(batches):
            block = Block(*parts, weight, total, length)
            for i, (_, own, times) in enumerate(asked):
                doc, score = best[i]
                found, scores = block.best(own, times, k, int(score[-1]) if len(score) == k else 0)
                if len(found):
                    doc, score = np.append(doc, block.doc[found]), np.append(score, scores)
                    order = np.lexsort((doc, -score))[:k]
                    order = order[score[order] > 0]
                    best[i] = doc[order], score[order]
        for (query, _, _), (doc, score) in zip(asked, best, strict=True):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(doc)), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], names=["query", "doc", "score"])

    local = held.mapInArrow(lean(run), "query string, doc bigint, score bigint").withColumn("part", F.spark_partition_id() % 64)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    for keys in (["query", "part"], ["query"]):
        local = local.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    out = cut(local.drop("part"))
    remove_folder(spark, folder)
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, id, score): the k best rows of `docs` for each row of `queries`, by score and then by id; none has score 0.

    Terms are maximal runs of ASCII letters and digits and of all other code points from U+0080 on, A-Z lower-cased,
    of the whole text. A query's score of a document sums w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over the
    query's terms with repeats; w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 25 + (75 * n * N) div L. N counts the
    documents with a term, L all their terms, n a document's.

    A text that is null or has no term is no document and no query. Rows are judged apart where ids repeat; a null id
    comes last among equal scores. An empty table on either side gives no row. `id_col` is an integer column; other
    columns are not read. Queries beyond BROADCAST_ENTRIES different terms take a pass over the documents for each
    such part.
    """
    names = [fresh(c, [query_id, id_col]) for c in ("rank", "score")]
    terms = cut(query_terms(queries, query_id, query_text))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    entries = terms.count()
    parts = max(1, -(-entries // BROADCAST_ENTRIES))
    out = None
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part) if parts > 1 else terms
        found = _ranked(rows, own.select("query", "term", "times"), k)
        out = found if out is None else out.union(found)
    ids = terms.select("query", "id").distinct()
    return out.join(ids, "query").select(F.col("id").alias(query_id), F.col("rank").alias(names[0]), F.col("doc").alias(id_col), F.col("score").alias(names[1]))
