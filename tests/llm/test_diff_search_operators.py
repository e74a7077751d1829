"""Substring dedup, snapshot differences and lexical search against brute force on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict, deque

import numpy as np
import pytest

from doculith.llm import lexical_search, snapshot_diff, substring_dedup
from doculith.llm.queries import QUERIES, SQL


def _duck(sf, sql):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.sql(sql)


@pytest.mark.parametrize("name", sorted(SQL))
def test_whole_tables_against_duckdb(spark, sf, name):
    got, want = QUERIES[name](spark, sf), _duck(sf, SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert Counter(map(tuple, got.select(*order).collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


# Substring dedup.


def _cut_words(rows, size, reference=None):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = defaultdict(lambda: math.inf)
    order = [math.inf if i is None else i for i, _ in rows]
    known = [(i, w) for i, w in zip(order, split, strict=True)] if reference is None else [(-math.inf, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in reference]
    for i, w in known:
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            seen[key] = min(seen[key], i)
    out = Counter()
    for (ident, _), i, w in zip(rows, order, split, strict=True):
        gone = set()
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            if key in seen and seen[key] < (i if reference is None else 0):
                gone.update(range(j, j + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[ident, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def _rows_of_words(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "c", "é", "dd", "日本", "x.", "The", "the"]
    say = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    shared = [say(30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = say(int(rng.integers(0, 25)))
        if i % 3 == 0:
            whole = shared[int(rng.integers(0, 4))]
            a, b = sorted(int(x) for x in rng.integers(0, 31, 2))
            parts += whole[a:b] + say(4)
        rows.append((int(i), "".join(w + str(rng.choice([" ", "\n", "\t ", "  "])) for w in parts)))
    rows += [(60, "a " * 40), (61, "a " * 3000 + "b"), (None, "a " * 20), (None, rows[0][1]), (62, None), (63, ""), (64, " \n\t"), (5, " ".join(shared[0])), (5, " ".join(shared[0])), (5, " ".join(shared[0][3:])), (-7, " ".join(shared[1])), (65, "a b " * 30), (66, "a b " * 30), (67, "x\x1cy " * 14), (68, "x\x1cy " * 14)]
    return rows


@pytest.mark.parametrize("size", [5, 13])
@pytest.mark.parametrize("hot", [0, 2_000])
def test_substrings_against_brute_force(spark, monkeypatch, size, hot):
    monkeypatch.setattr(substring_dedup, "HOT_CORE", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 150)
    rows = _rows_of_words(size)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, core string, words int").repartition(3)
    got = substring_dedup.digest(frame, size)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == _cut_words(rows, size)
    assert substring_dedup.digest(frame.where("false"), size).count() == 0


def test_substrings_of_a_reference(spark):
    rows = _rows_of_words(3)
    known = [rows[0][1], rows[3][1], None, "a " * 50]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    reference = spark.createDataFrame([(t,) for t in known], "text string")
    found = substring_dedup.deduplicate(frame, 6, reference=reference)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in found.collect())
    assert got == _cut_words(rows, 6, known)
    assert sum(r["n_removed"] for r in substring_dedup.deduplicate(frame, 6, reference=reference.where("false")).collect()) == 0
    one = found.where("doc_id = 61").first()
    assert one["spans"] == [(0, 3000)]  # the last window, with the b, is not in the reference
    with pytest.raises(ValueError):
        substring_dedup.deduplicate(frame, 3)


def test_automaton_knows_all_substrings():
    rng = np.random.default_rng(2)
    texts = [(rng.integers(0, 3, int(rng.integers(0, 30))).tolist(), int(rng.integers(0, 9))) for _ in range(40)]
    automaton = substring_dedup.SuffixAutomaton()
    for text, doc in texts:
        automaton.add(text, doc)
    automaton.settle()
    for size in (1, 3, 5):
        least = defaultdict(lambda: substring_dedup.LAST)
        for text, doc in texts:
            for j in range(len(text) - size + 1):
                least[tuple(text[j : j + size])] = min(doc, least[tuple(text[j : j + size])])
        for text in (rng.integers(0, 4, 60).tolist(), [], [0], [7] * 9):
            assert automaton.matched(text, size) == [least[tuple(text[j : j + size])] for j in range(len(text) - size + 1)]


# Snapshot differences.


def _sha(*values):
    return hashlib.sha256("\n".join("~" if v is None else v for v in values).encode()).hexdigest()


def _content(row):
    parts = [None if v is None else hashlib.sha256(str(v).encode()).digest() for v in row]
    return hashlib.sha256(b"".join(b"0" if p is None else b"1" + p for p in parts)).digest()


def _diff(earlier, later, columns):
    """Pairs rows of a key in the order of their contents' digests, then contents by deques."""
    out, left = [], (defaultdict(list), defaultdict(list))
    sides = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(sides, (earlier, later), strict=True):
        for key, *content in rows:
            side[key].append(tuple(content))
    low = lambda k: (k is not None, k)  # noqa: E731  null is the smallest key
    for key in sides[0].keys() | sides[1].keys():
        a, b = (sorted(s.get(key, []), key=_content) for s in sides)
        for x, y in zip(a, b, strict=False):
            changed = [c for c, v, w in zip(columns, x, y, strict=True) if v != w]
            out.append((key, key, "update" if changed else "same", tuple(changed), _sha(*y)))
        for own, at, rows in ((left[0], len(b), a), (left[1], len(a), b)):
            for row in rows[at:]:
                own[row].append(key)
    for content in left[0].keys() | left[1].keys():
        a = deque(sorted(left[0].get(content, []), key=low))
        b = deque(sorted(left[1].get(content, []), key=low, reverse=True))
        while a and b:
            out.append((b.popleft(), a.popleft(), "rekey", (), _sha(*content)))
            out[-1] = (out[-1][0], out[-1][1], *out[-1][2:])
        out += [(k, None, "insert", (), _sha(*content)) for k in b] + [(k, k, "delete", (), None) for k in a]
    return Counter(out)


def _snapshots(seed):
    rng = np.random.default_rng(seed)
    word = lambda: None if rng.random() < 0.2 else str(rng.choice(["", "~", "a", "b", "é" * 4000]))
    make = lambda n, low: [(None if rng.random() < 0.05 else int(k), word(), word(), word()) for k in rng.integers(low, low + 90, n)]
    earlier, later = make(150, 0), make(170, 30)
    earlier += [(1000 + i, "same", None, "s") for i in range(300)]
    later += [(5000 - i, "same", None, "s") for i in range(260)] + [(7, "k", "k", "k")] * 40
    return earlier, later + earlier[:50]


def test_differences_against_deques(spark):
    columns = ["text", "lang", "source"]
    earlier, later = _snapshots(1)
    shape = "doc_id bigint, text string, lang string, source string, op string, key int"
    frames = [spark.createDataFrame([(*r, "x", 3) for r in rows], shape).repartition(5) for rows in (earlier, later)]
    carry = {"row_sha256": snapshot_diff.row_sha256(*columns)}
    for a, b, one, two in ((*frames, earlier, later), (frames[0].where("false"), frames[1], [], later), (frames[0], frames[1].where("false"), earlier, []), (frames[0].where("false"), frames[1].where("false"), [], [])):
        found = snapshot_diff.difference(a, b, "doc_id", columns, carry)
        assert found.columns == ["key", "old_key", "op", "changed", "row_sha256"]
        assert Counter((r["key"], r["old_key"], r["op"], tuple(r["changed"]), r["row_sha256"]) for r in found.collect()) == _diff(one, two, columns)
    assert snapshot_diff.difference(*frames, "doc_id", ["text"]).columns == ["key", "old_key", "op", "changed"]
    with pytest.raises(ValueError):
        snapshot_diff.difference(*frames, "doc_id", columns, {"OP": carry["row_sha256"]})


def test_differences_build_dictionaries_without_a_shuffle(spark):
    spill = snapshot_diff.Spill(spark)
    one, two = (spark.range(n).selectExpr("cast(id as string) name", "id place", f"id {c}") for n, c in ((50, "a"), (90, "b")))
    joined = snapshot_diff.grace_join(spill, one, two, ["name", "place"], (50, 90))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildLeft" in plan and "Exchange" not in plan
    assert joined.count() == 90
    spill.drop()


def test_places_in_a_queue_that_spans_many_ranges(spark):
    rows = [("hot", i) for i in range(500)] + [(f"q{i % 7}", i) for i in range(60)]
    frame = spark.createDataFrame(rows, "q string, k int").repartition(6)
    got = {(r["q"], r["k"]): r["place"] for r in snapshot_diff.queued(frame, "q", frame["k"].desc()).collect()}
    for q in {q for q, _ in rows}:
        own = sorted((k for p, k in rows if p == q), reverse=True)
        assert [got[q, k] for k in own] == list(range(len(own)))


# Lexical search.


def _search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    bags = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for ident, text in items:
        scored = []
        for i, bag in bags:
            m = 25 + (75 * bag.total() * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, q in Counter(term.findall(lower(text))).items() if t in bag)
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[ident, rank, i, -score] += 1
    return out


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical_search, "FIRST_STEP", 2)
    monkeypatch.setattr(lexical_search, "LONG", 500)
    rng = np.random.default_rng(6)
    words = [f"W{i}" for i in range(60)] + ["é", "É", "日本", "a-b", "x_y", "½", "\x7f", "\x80"]
    odds = np.arange(len(words), 0, -1.0) ** 2
    say = lambda n: " ".join(str(w) for w in rng.choice(words, n, p=odds / odds.sum()))
    docs = [(i, say(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(i, docs[3][1]) for i in range(900, 960)] + [(i, docs[4][1]) for i in (5, 5, -3)] + [(None, docs[3][1]), (None, docs[5][1]), (1000, None), (1001, ""), (1002, "-- !"), (1003, say(2000)), (1004, "rare RARE rare")]
    items = [(i, say(int(rng.integers(1, 20)))) for i in range(12)] + [(50, docs[3][1]), (50, docs[7][1]), (None, "rare w0"), (60, None), (61, " - "), (62, "nowhere"), (63, "w0 W0 w0")]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id bigint, text string, rank int, query string").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, score int")
    found = lexical_search.search(frame, asked, 5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == _search(docs, items, 5)
    assert lexical_search.search(frame, asked.where("false")).count() == 0
    assert lexical_search.search(frame.where("false"), asked).count() == 0
    monkeypatch.setattr(lexical_search, "BROADCAST_ENTRIES", 40)  # several passes
    assert Counter(tuple(r) for r in lexical_search.search(frame, asked, 5).collect()) == _search(docs, items, 5)


def test_search_stops_before_its_lists_end():
    rng = np.random.default_rng(1)
    n, terms = 4000, 6
    held = rng.random((n, terms)) < 0.5
    held[7] = True
    starts = np.append(0, np.cumsum(held.sum(1)))
    weight = np.array([9000, 7000, 5000, 900, 500, 100], np.int64)
    times = np.ones(held.sum(), np.int64)
    at = np.flatnonzero(np.repeat(np.arange(n), held.sum(1)) == 7)
    times[at] = 50
    block = lexical_search.Block(np.arange(n), rng.integers(10, 5000, n), starts, np.nonzero(held)[1].astype(np.int32), times, weight, n, 2000 * n)
    found, score = block.best(np.arange(terms), np.ones(terms, np.int64), 1, 0)
    full = np.bincount(np.repeat(np.arange(n), held.sum(1)), block.impact, n)
    assert len(found) <= lexical_search.CANDIDATES and found[score.argmax()] == full.argmax() == 7 and score.max() == full.max()
