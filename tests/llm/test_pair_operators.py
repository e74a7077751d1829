"""Suffix dedup, the Jaccard join, near-duplicate vectors, components and the pipeline against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from doculith.llm import jaccard_join, nn_descent, suffix_dedup
from doculith.llm.common import components


def _least(links, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == _least(real, {n for x in real for n in x})
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def _removed(texts, window):
    seen = Counter()
    raws = {i: (t or "").encode() for i, t in texts}
    for raw in raws.values():
        seen.update(raw[p : p + window] for p in range(len(raw) - window + 1))
    out = {}
    for i, raw in raws.items():
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - window + 1):
            if seen[raw[p : p + window]] > 1:
                gone[p] += 1
                if p + window < len(gone):
                    gone[p + window] -= 1
        cover = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        spans = int((cover & ~np.append(False, cover[:-1])).sum()) if len(raw) else 0
        out[i] = (len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def _passages(rng):
    make = lambda n: "".join(rng.choice(list("abcdeé "), n))
    shared = [make(n) for n in (49, 60, 99, 100, 101, 150, 260, 700)]
    texts = [make(int(rng.integers(0, 400))) + str(rng.choice(shared)) + make(int(rng.integers(0, 300))) + str(rng.choice(shared)) for _ in range(60)]
    texts += [make(50) + shared[2] + shared[6][: 100 + i] + make(20) for i in range(12)]
    texts += [shared[7], shared[7], "a" * 2000, "ab" * 700, "", None, "x" * 99, shared[5] + shared[5], make(30_000)]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot,entries", [(20_000, 1_500_000), (2, 0)])
def test_repeated_strings_against_brute_force(spark, monkeypatch, hot, entries):
    """The second case sends every core window by window, and joins texts by a shuffle."""
    monkeypatch.setattr(suffix_dedup, "HOT_CORE", hot)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ENTRIES", entries)
    texts = _passages(np.random.default_rng(2))
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, core int").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs, 100).collect()}
    assert got == _removed(texts, 100)


def test_equal_suffixes_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 20)
    monkeypatch.setattr(suffix_dedup, "MOST_BUCKET", 20)
    texts = [(i, "the same text in every row of the table, again and again. " * 4 + ("" if i % 2 else f"{i:0100d}")) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs, 120).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == _removed(texts, 120)


def test_dedup_of_rows_with_one_id_and_of_none(spark):
    """Each row is judged by its own text: equal rows repeat each other, others of that id only what they share."""
    rng = np.random.default_rng(13)
    make = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = make(250)
    rows = [(1, make(50) + shared), (1, make(40)), (2, shared), (3, make(300)), (3, make(120)), (None, make(130)), (None, shared + make(10)), (4, "q" * 30 + "w" * 90), (4, "q" * 30 + "w" * 90), (None, None), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = _removed(list(enumerate(t for _, t in rows)), 100)
    assert Counter(map(tuple, suffix_dedup.digest(docs, 100).collect())) == Counter((i, *want[k]) for k, (i, _) in enumerate(rows))
    assert suffix_dedup.digest(docs.where("false"), 100).count() == 0


def test_splitters_part_suffixes_as_the_order_does():
    rng = np.random.default_rng(14)
    tokens = [rng.integers(0, 3, 400) for _ in range(5)]
    splitters = [rng.integers(0, 3, 9) for _ in range(5)]
    by = sorted(zip(*splitters, strict=True))
    splitters = [np.array(c) for c in zip(*by, strict=True)]
    assert suffix_dedup.located(splitters, tokens).tolist() == [sum(s <= t for s in by) for t in zip(*tokens, strict=True)]


@pytest.mark.parametrize("small", [1, 50, 4096])
def test_multikey_order(monkeypatch, small):
    monkeypatch.setattr(suffix_dedup, "SMALL_SORT", small)
    rng = np.random.default_rng(3)
    tokens = [rng.integers(0, 4, 500) for _ in range(4)]
    assert (multi := suffix_dedup.multikey_order(tokens)).tolist() and [tuple(t[i] for t in tokens) for i in multi] == sorted(zip(*tokens, strict=True))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sets(texts, size):
    out = {}
    for i, t in texts:
        w = _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def _joined(texts, size, percent):
    sets = _sets(texts, size)
    inverse, links = defaultdict(set), []
    for i, s in sets.items():
        for j in set().union(*(inverse[t] for t in s)) if s else ():
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                links.append((i, j))
        for t in s:
            inverse[t].add(i)
    root = _least(links, sets)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def _near_copies(rng, families=12, copies=14):
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(families):
        base = list(rng.choice(words, int(rng.integers(3, 260))))
        for _ in range(copies):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
            texts.append(" ".join(t[: len(t) - int(rng.integers(0, 1 + len(t) // 20))]))
    texts += [None, "", " \t\n", "one", "One", "one two", "ONE  TWO", "two one", "é É", "é é", "a b c", "common line of words here " * 3, "x " * 50_000]
    texts += ["a common line of text " + " ".join(rng.choice(words, 12)) for _ in range(120)]
    return [(i * 3 + 1, t) for i, t in enumerate(rng.permutation(np.array(texts, object)))]


@pytest.mark.parametrize("size,percent,short,block,broadcast", [(3, 90, 48, 4096, 10**6), (5, 80, 48, 4096, 10**6), (3, 90, 3, 8, 0), (2, 70, 2, 5, 0)])
def test_links_against_brute_force(spark, monkeypatch, size, percent, short, block, broadcast):
    """The later cases send nearly all lists and clusters through their blocks, and documents through a shuffle."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 600 if broadcast else 3_000_000)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", broadcast)
    texts = _near_copies(np.random.default_rng(size))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id bigint, text string, n int, token string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.join(docs, size, percent).collect()}
    assert got == _joined(texts, size, percent)
    kept = jaccard_join.keep_first(docs, size, percent)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}


def test_large_sets_use_the_large_sketch(spark):
    """Sets on both sides of the size from which sketches are longer."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 4300)]
    texts = []
    for i, n in enumerate((4300, 4250, 4150, 4110, 4095, 4080, 3950, 3800, 3700)):
        t = base[:n]
        for k in rng.integers(0, n, i * 12):
            t[int(k)] = "changed"
        texts.append((i, " ".join(t)))
    texts += [(100 + i, " ".join(f"v{k}" for k in rng.integers(0, 10**6, 4200))) for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.join(docs, 3, 90).collect()} == _joined(texts, 3, 90)


def test_sketches_refute_long_unrelated_sets():
    """Sets with one common shingle of any size and no others: sketches leave none of their pairs, at 80 and 90 percent."""
    rng = np.random.default_rng(16)
    for size in (30, 1000, 2400, 8000, 20_000, 70_000):
        token = [np.append(rng.integers(0, 2**63, size - 1), 5).astype(np.uint64) for _ in range(2)]
        n = np.array([size, size])
        one, two = jaccard_join.parity(np.repeat([0, 1], size), np.concatenate(token), n)
        apart = np.bitwise_count(np.frombuffer(one, np.uint8) ^ np.frombuffer(two, np.uint8)).sum(dtype=np.int64)
        assert 180 * apart > 20 * 2 * size and len(one) * 8 <= max(1024, 4 * size)


def test_long_texts_with_a_common_line(spark, monkeypatch):
    """Long texts of several lengths that share a line meet in one long list and link only where they are copies."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    rng = np.random.default_rng(17)
    texts = []
    for i, n in enumerate((900, 960, 1000, 1060, 1100, 2400, 3000, 4000, 4090, 4150, 4600)):
        base = [f"v{k}" for k in rng.integers(0, 10**6, n)]
        texts += [(10 * i, "a line in all " + " ".join(base)), (10 * i + 1, "a line in all " + " ".join(base[: n - n // 25]))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.join(docs, 3, 90).collect()} == _joined(texts, 3, 90)


def test_ties_of_the_upper_bits_are_told_apart():
    token = np.array([(5 << 20) | 1, (5 << 20) | 2, (5 << 20) | 1, 7], np.uint64)
    row, rank = np.array([0, 0, 0, 1]), np.array([2, 2, 2, 1], np.uint64)
    assert token[jaccard_join._order(token, row, np.zeros(0, np.uint64))].tolist() == [token[0], token[0], token[1], 7]
    assert token[jaccard_join._order(token, row, rank)].tolist() == [token[0], token[0], token[1], 7]


def test_join_of_an_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(2, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "z y x"), (None, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_join.join(docs).collect()), key=str) == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None), (None, 0, None)], key=str)
    assert jaccard_join.join(docs.where("false")).count() == 0 and jaccard_join.keep_first(docs.where("false")).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    """Every row is judged by its own text; of a group of near copies one row stays, and no unrelated one goes."""
    base = " ".join(f"w{k}" for k in range(60))
    near, other, third = base + " end", " ".join(f"u{k}" for k in range(40)), " ".join(f"t{k}" for k in range(30))
    rows = [(7, base, "a"), (7, other, "b"), (9, near, "c"), (7, base, "d"), (None, near, "e"), (None, third, "f"), (None, third, "g"), (None, None, "h"), (7, "", "i"), (None, "one", "j"), (3, other + " more", "k")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, w string, llm_doc int, LLM_TAG int").repartition(3)
    kept = jaccard_join.keep_first(docs, 5, 80)
    got = {r["w"] for r in kept.collect()}
    assert kept.columns == docs.columns and len(got) == kept.count()
    assert got - {"a", "d", "f", "g"} == {"h", "i", "j", "k"} and len(got & {"a", "d"}) == len(got & {"f", "g"}) == 1
    found = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.join(docs, 5, 80).collect())
    assert found == Counter([(7, 7), (7, 7), (None, 7), (9, 7), (7, 3), (3, 3), (7, 7), (None, None), (None, None), (None, None), (None, None)])


def _vector_truth(rows, threshold):
    """(id, n_links, component_id, kept) of each row, each row a vector of its own whatever its id."""
    groups = defaultdict(list)
    for r, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append((r, np.array(v, np.float64)))
    count, links = Counter(), []
    for own in groups.values():
        for a in range(len(own)):
            for b in range(a):
                x, y = own[a][1] / np.abs(own[a][1]).max(), own[b][1] / np.abs(own[b][1]).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    count[own[a][0]] += 1
                    count[own[b][0]] += 1
                    links.append((own[a][0], own[b][0]))
    root = _least(links, list(range(len(rows))))
    smallest = {}
    for r, (i, *_) in enumerate(rows):
        if i is not None:
            smallest[root[r]] = min(i, smallest.get(root[r], i))
    return [(i, count[r], smallest.get(root[r]), i == smallest.get(root[r])) for r, (i, *_) in enumerate(rows)]


def _vectors():
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in range(3):
        for _ in range(25):
            center = rng.standard_normal(24)
            for _ in range(int(rng.integers(1, 12))):
                rows.append((i := i + 1, [float(np.float32(x)) for x in center + rng.standard_normal(24) * 0.12], label))
        rows += [(i := i + 1, [float(np.float32(x)) for x in rng.standard_normal(24)], label) for _ in range(150)]
    tight = rng.standard_normal(24)
    close = lambda: [float(np.float32(x)) for x in tight + rng.standard_normal(24) * 0.02]
    rows += [(i := i + 1, close(), 1) for _ in range(90)]
    rows += [(i := i + 1, rows[0][1], 0) for _ in range(30)]
    rows += [(i := i + 1, v, label) for v, label in ((None, 1), ([0.0] * 24, 1), ([float("nan")] + [1.0] * 23, 1), ([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), (rows[0][1], None), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e-30] * 24, 2), ([1e30] * 24, 2))]
    # Ids that repeat, within a component and across, and rows without an id, linked, alone and unusable.
    rows += [(7, close(), 1), (7, close(), 1), (-5, rows[40][1], rows[40][2]), (-5, rows[90][1], rows[90][2]), (rows[3][0], rows[3][1], rows[3][2])]
    lonely = [float(np.float32(x)) for x in rng.standard_normal(24)]
    return rows + [(None, close(), 1), (None, close(), 1), (None, lonely, 2), (None, lonely, 2), (None, None, 1), (None, [1.0] * 24, None)]


@pytest.mark.parametrize("exact", [False, True])
def test_vectors_against_brute_force(spark, monkeypatch, exact):
    monkeypatch.setattr(nn_descent, "START_BLOCK", 40)
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    if exact:  # the recall is never enough, the tables run out, and every pair is compared
        monkeypatch.setattr(nn_descent, "TABLES", 1)
        monkeypatch.setattr(nn_descent, "MOST_TABLES", 1)
        monkeypatch.setattr(nn_descent, "audit", lambda *_: 0.0)
    rows = _vectors()
    frame = spark.createDataFrame([(a, b, c, "z") for a, b, c in rows], "vec_id bigint, embedding array<float>, label int, w string").repartition(3)
    got = Counter(tuple(r) for r in nn_descent.near_duplicates(frame, 0.93).collect())
    want = Counter(_vector_truth(rows, 0.93))
    assert got.total() == len(rows)
    missed = (want - got).total()
    assert missed == 0 if exact else missed <= 0.03 * len(rows)
    for i, links, component, kept in got - want:  # what was missed only makes counts lower and components smaller
        assert any(links <= n and (c is None or component >= c) for j, n, c, _ in want if j == i) and kept == (i == component)
    assert nn_descent.near_duplicates(frame.where("false")).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b, far = [1.0, 0.0, 0.1], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0]
    frame = spark.createDataFrame([(1, a, 0), (1, b, 0), (3, a, 0), (3, far, 0), (None, b, 0), (None, far, 1), (9, far, 1)], "vec_id bigint, embedding array<double>, label int")
    got = Counter(tuple(r) for r in nn_descent.near_duplicates(frame, 0.93).collect())
    assert got == Counter([(1, 3, 1, True), (1, 3, 1, True), (3, 3, 1, False), (3, 0, 3, True), (None, 3, 1, False), (None, 1, 9, False), (9, 1, 9, True)])


def _planted(seed, rows, pairs, dense=0):
    """Unit vectors of one label; the first `pairs` of them have a partner right above 0.93, and `dense` more lie close together."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, c = unit(rng.standard_normal((rows, 64))), rng.uniform(0.932, 0.95, pairs)[:, None]
    other = rng.standard_normal((pairs, 64))
    other = unit(other - (other * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    tight = unit(rng.standard_normal((1, 64))) + rng.standard_normal((dense, 64)) * 0.01
    return np.concatenate([x, c * x[:pairs] + np.sqrt(1 - c * c) * other, tight])


def test_separate_pairs_of_a_large_label_are_found(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "START_BLOCK", 40)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(_planted(3, 8000, 300, 500))], "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.near_duplicates(frame, 0.93).collect()}
    assert sum(got[i] > 0 for i in range(300)) >= 0.96 * 300


def test_audit_sees_missing_pairs_beside_a_dense_group(spark):
    x = _planted(5, 1500, 40, 300)
    nodes = spark.createDataFrame([(i, 1, 1, v.tobytes()) for i, v in enumerate(x)], "id bigint, g bigint, w bigint, vec binary")
    asked = nn_descent.sampled(nodes, nn_descent._labels(nodes, 0.93), 0.93, "float64")
    dense = spark.createDataFrame([(i, 299, 299) for i in range(1540, 1840)], "id bigint, links bigint, near bigint")
    pairs = spark.createDataFrame([(i, 1, 1) for i in [*range(40), *range(1500, 1540)]], "id bigint, links bigint, near bigint")
    # All 80 nodes of pairs are asked: their label is asked as a whole while it shows under LINKED of them.
    assert asked.where("real = 1").count() == 80
    assert nn_descent.audit(asked, dense) == 0.0 and nn_descent.audit(asked, dense.union(pairs)) == 1.0


def test_pipeline_stages_against_plain_readings(spark, sf):
    import corpus_pipeline as p
    from doculith.llm import pii

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != p.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "ngram_jaccard_join":
            texts = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert set(kept[name]) == {i for i, (_, c) in _joined(texts, p.SHINGLE, p.PERCENT).items() if c == i}
        if name == "benchmark_decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(t in (r["text"] or "") for r in kept[name].values() for t in items)
        if name == "pii":
            assert all(not [s for s in pii.find(r["text"] or "") if s[2] == "email"] and r["n_chars"] == len(r["text"]) for r in kept[name].values())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept["toxicity"] for i in clean) >= 0.98 * len(clean)
    whole = p.run(spark, sf)
    assert whole.count() == docs.count() and whole.columns == docs.columns


def test_stages_pass_odd_rows(spark, sf):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "src0", 0), (3, "a b c d e f", "en", "src0", 11), (3, "a b c d e f", "en", "src0", 11), (None, "x", None, None, 1)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for frame, least in ((docs, 4), (docs.where("false"), 0)):
        for name, stage in p.STAGES:
            out = stage(spark, frame, sf)
            assert out.count() >= (least if name != "mix_sources" else 0)
            assert set(frame.columns) <= set(out.columns)
