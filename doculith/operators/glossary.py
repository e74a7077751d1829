"""Terms to replace, as a table: which documents use which of them, by automata over all terms at once."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of terms, with those to use instead, that are sent to the workers at once; more terms take another pass.
SHARD_CHARS = 4_000_000
HIT = "struct<term:string,use:string,times:int>"


def glossary(terms: DataFrame, term: str = "term", use: str = "use") -> DataFrame:
    """(term, use): terms in lower case, one row each, with the least of the words to use instead; empty and null terms are left out."""
    rows = terms.select(F.lower(term).alias("term"), F.col(use).cast("string").alias("use")).where("term <> ''")
    return rows.groupBy("term").agg(F.min("use").alias("use"))


def shards(terms: DataFrame) -> list[list[tuple[str, str | None]]]:
    """The glossary in parts of about SHARD_CHARS, by a hash of the term; its size is counted before anything is collected."""
    own = glossary(terms)
    chars = own.agg(F.coalesce(F.sum(F.length("term") + F.coalesce(F.length("use"), F.lit(0)) + 8), F.lit(0))).first()[0]
    parts = max(1, -(-chars // SHARD_CHARS))
    if parts == 1:
        return [[tuple(r) for r in own.collect()]]
    return [[tuple(r) for r in own.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).collect()] for i in range(parts)]


class _Terms:
    """Finds all terms in a text by one walk through it."""

    def __init__(self, terms: list[tuple[str, str | None]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (term, _) in enumerate(terms):
            self.automaton.add_word(term, i)
        self.terms = terms
        if terms:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[dict] | None:
        if text is None:
            return None
        times: dict[int, int] = {}
        free: dict[int, int] = {}
        if self.terms:
            for end, i in self.automaton.iter(text):
                if end - len(self.terms[i][0]) >= free.get(i, -1):
                    times[i], free[i] = times.get(i, 0) + 1, end
        return [{"term": t, "use": u, "times": n} for (t, u), n in sorted((self.terms[i], n) for i, n in times.items())]


#: The automata that a worker has built, by glossary part; one at a time.
_BUILT: dict[str, _Terms] = {}


def _built(part: str, terms: list[tuple[str, str | None]]) -> _Terms:
    if part not in _BUILT:
        _BUILT.clear()
        _BUILT[part] = _Terms(terms)
    return _BUILT[part]


def uses(text: Column, df: DataFrame, terms: DataFrame) -> Column:
    """For each text the terms that it holds, in any case and anywhere, with what to use instead and how often, by term.

    Occurrences of one term do not overlap. A null text gives null. The texts of `df` go through Python once for each part of the glossary.
    """
    out = None
    for terms_ in shards(terms):
        held = df.sparkSession.sparkContext.broadcast(terms_)
        part = _finder(held, uuid.uuid4().hex)(F.lower(text))
        out = part if out is None else F.concat(out, part)
    return F.array_sort(out)


def _finder(held: Broadcast, name: str):
    kind = pa.list_(pa.struct([("term", pa.string()), ("use", pa.string()), ("times", pa.int32())]))

    @F.arrow_udf(f"array<{HIT}>")
    def run(texts: pa.Array) -> pa.Array:
        finder = _built(name, held.value)
        return pa.array([finder.found(t) for t in texts.to_pylist()], kind)

    return run.asNondeterministic()


def occurrences(docs: DataFrame, terms: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, term, use, times): one row for each term that a document holds."""
    rows = docs.withColumn("_uses", uses(F.col(text), docs, terms))
    return rows.select(*keys, F.explode("_uses").alias("u")).select(*keys, "u.*")
