"""Language, URL rules, archives, leaks, toxicity, personal data and mixing on small tables with odd rows."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doculith.llm import decontaminate, lang_id, mixing, pii, toxicity, url_filter, warc

WORDS = {"en": "the of and to in is that it was for on are with as his they be at one have this".split(), "de": "der die und das nicht sich auch werden eine ist von mit dem ein auf für sind über schön".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au où été".split()}
DOC = "doc_id bigint, text string, lang string, source string, row int, entries string, rate double"


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, _text(rng, lang := ["en", "de", "fr"][i % 3], 60), lang, f"s{i % 4}", i, "x", 0.5) for i in range(120)]
    rows += [(200, None, "en", "s0", None, None, None), (201, "", "en", None, 1, "", 0.0), (202, " 12 34 !", None, "s1", 1, "", 0.0), (203, _text(rng, "de", 60_000), None, "s1", 1, "", 0.0), (204, "und", "de", "s9", 1, "", 0.0), (204, "und", "de", "s9", 1, "", 0.0), (None, "the and of", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def test_language_of_held_out_texts(docs):
    model = lang_id.fit(docs, ~lang_id.held_out())
    rows = lang_id.predict(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == ["en", "de", "fr"][i % 3] for i in range(120))
    assert {by[i]["lang_pred"] for i in (200, 201, 202)} == {"und"} and by[203]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = docs.sparkSession.createDataFrame([(1, "zxqv kjqx wvzk xqjz " * 30)], "doc_id bigint, text string")
    assert not lang_id.predict(odd, model).first()["accepted"]


def test_language_model_is_a_distribution(docs):
    model = lang_id.fit(docs)
    known = np.unique(model.keys[0])
    context = model.contexts[3][len(model.contexts[3]) // 2]
    logs = lang_id.log_probs(model, (context << lang_id.SYMBOL_BITS) | known)
    unseen = 1 - np.exp(logs).sum(0)
    assert (unseen > -1e-5).all() and (unseen < 0.5).all()


def _kneser_ney(texts, alphabet):
    """log p of a symbol after a context, from the plain recursion over dictionaries."""
    order = lang_id.ORDER
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = " " * (order - 1) + t + " "
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    discount = []
    for c in counts:
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5)

    def p(context, symbol):
        n = len(context) + 1
        lower = p(context[1:], symbol) if n > 1 else 1 / (alphabet + 1)
        after = {g: c for g, c in counts[n].items() if g[:-1] == context}
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(context + symbol, 0) - discount[n], 0) / total + discount[n] * len(after) / total * lower

    return lambda text: [np.log(p(t[i : i + order - 1], t[i + order - 1])) for t in [" " * (order - 1) + text + " "] for i in range(len(t) - order + 1)]


def test_entropies_are_those_of_the_plain_recursion():
    rng = np.random.default_rng(23)
    texts = {lang: [_text(rng, lang, 12) for _ in range(6)] for lang in ("de", "en")}
    grams_of = {}
    for lang, own in texts.items():
        stream, row, _ = lang_id.symbols(own, lang_id.ORDER - 1)
        grams_of[lang] = np.unique(lang_id.grams(stream, row, lang_id.ORDER)[0], return_counts=True)
    model = lang_id._estimate(sorted(grams_of), grams_of)
    alphabet = len(set("".join(t for own in texts.values() for t in own)) | {" "})
    asked = [_text(rng, "de", 5), _text(rng, "en", 4), "qxzj", texts["en"][0], "ø the"]
    found, _ = lang_id.entropies(model, asked)
    for i, lang in enumerate(model.langs):
        plain = _kneser_ney(texts[lang], alphabet)
        assert np.allclose(found[:, i], [-np.mean(plain(t)) for t in asked], atol=1e-4)


def test_every_ngram_of_a_large_language_counts(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4000)) for _ in range(100)]
    model = lang_id.fit(spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"))
    stream, row, _ = lang_id.symbols(texts, lang_id.ORDER - 1)
    known = np.unique(lang_id.grams(stream, row, lang_id.ORDER)[0])
    # What one text in sixteen holds alone is kept for calibration.
    assert len(known) > 350_000 and np.isin(model.keys[-1], known).all() and len(model.keys[-1]) > 0.85 * len(known)


def test_language_without_training(spark, docs):
    model = lang_id.fit(docs.where("false"))
    assert {r["lang_pred"] for r in lang_id.predict(docs, model).collect()} == {"und"}
    assert lang_id.predict(docs.where("false"), model).count() == 0


def _verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(re.split(r"[/?#]", rest)[0]) :])[0]
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.action if best else "allow"


def test_url_rules_against_a_plain_reading(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/")]
    rules += [url_filter.Rule("block" if i % 2 else "allow", f"h{i}.org", "/p/") for i in range(200)]
    urls = ["http://WWW.Example.com/en/1?x", "http://a.example.com/en/", "https://example.com", "http://example.com?/en/", "x.net/es/", "ftp://q.NET/es/x#y", None, "", "http:///en/", "http://notexample.com/en/", "http://com/", "http://ex.com//en/", "a://b://c.com/", "http://example.com/en"]
    urls += [f"http://{'sub.' * (i % 3)}h{i}.org/{'p' if i % 5 else 'q'}/x" for i in range(400)] + [f"http://r{i}.org/p/" for i in range(2000)]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)] + [(3, urls[3], "k", 1)], "page_id bigint, url string, keys string, h1 int").repartition(4)
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: _verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_cascade_ends_though_levels_collide(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FALSE_POSITIVES", 10**9)
    listed = spark.createDataFrame([(f"in{i}",) for i in range(500)], "key string")
    universe = listed.union(spark.createDataFrame([(f"out{i}",) for i in range(20_000)], "key string"))
    levels = url_filter.cascade(listed, universe)
    rows = universe.select("key", *[h.alias(f"h{i}") for i, h in enumerate(url_filter.hashed(F.col("key")))]).toPandas()
    said = url_filter.listed_in(levels, rows["h0"].to_numpy(), rows["h1"].to_numpy())
    assert (said == rows["key"].str.startswith("in").to_numpy()).all() and len(levels) > 2


def _roles(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row (page_id, url, html), by the plain rule."""
    raws = [(v or "").encode() for _, _, v in rows]
    out, done = [], set()
    for i, (k, _, _) in enumerate(rows):
        same = [rows[j][:2] for j, raw in enumerate(raws) if raw == raws[i]]
        key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
        first = max(same, key=key)
        lead = len(raws[i]) < least or (rows[i][:2] == first and raws[i] not in done)
        if lead:
            done.add(raws[i])
        out.append((k, len(raws[i]), base64.b32encode(hashlib.sha1(raws[i]).digest()).decode(), "response" if lead else "revisit", None if lead else first[0]))
    return Counter(out)


def test_archive_round_trip(spark, tmp_path):
    html = {1: "<p>é</p>", 2: "", 3: None, 4: "<p>é</p>", 5: "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\nWARC/1.0", 6: "z" * 300_000, 7: "<p>é</p>", 8: "\r\n\r\n\r\nWARC/", 9: "\r\n\r\nWARC/" * 9000}
    rows = [(k, None if k == 6 else f"http://h/{k}", v) for k, v in html.items()] + [(2, "http://h/2", ""), (7, "http://h/7", "<p>é</p>"), (7, "http://h/8", "<p>é</p>"), (7, "http://h/8", "<p>é</p>"), (7, "http://h/8", "other"), (-4, "", "minus")]
    rows += [(None, "http://n", "<p>n</p>"), (None, "http://n", "<p>n</p>"), (None, None, "")]
    pages = spark.createDataFrame([(*r, "r", "q") for r in rows], "page_id bigint, url string, html string, digest string, uri string").repartition(3)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for least in (0, 8, 10**6):
        got = warc.round_trip(pages, str(tmp_path / f"w{least}"), least).select(columns).collect()
        assert Counter(map(tuple, got)) == _roles(rows, least)
    assert Counter(map(tuple, warc.round_trip(pages).select(columns).collect())) == _roles(rows)
    captures = warc.transactions(warc.read(spark, str(tmp_path / "w0"))).collect()
    assert len(captures) == len(rows) and all(c["request"] and c["metadata"] and c["response"] for c in captures)
    assert Counter(bytes(c["response"]["payload"]).decode() for c in captures if c["response"]["type"] == "response") == Counter({v or "" for _, _, v in rows})
    assert warc.round_trip(pages.where("false"), str(tmp_path / "e")).count() == 0


def test_archives_of_random_bytes_come_back(spark, tmp_path):
    """Blocks that hold parts of the seam at all places, over the buffers of the reader."""
    rng = np.random.default_rng(15)
    pieces = ["\r", "\n", "\r\n", "\r\n\r\n", "\r\n\r\nWA", "\r\n\r\nWARC/", "WARC/1.1", "x" * 997, "é"]
    rows = [(i, "http://h/", "".join(rng.choice(pieces, int(rng.integers(0, 400))))) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = warc.round_trip(pages, str(tmp_path / "r")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == _roles(rows)


def test_records_of_one_piece_are_parted():
    """Pieces in which a seam was missed, at every place of three records."""
    make = lambda i, block: f"WARC/1.1\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    blocks = ["\r\n", "", "\r\n\r\nWARC/", "end\r\n\r"]
    whole = b"".join(make(i, x) for i, x in enumerate(blocks))
    cuts = whole.split(warc.SEAM)
    for missed in range(1 << (len(cuts) - 1)):
        pieces = [cuts[0]]
        for i, c in enumerate(cuts[1:]):
            if missed >> i & 1:
                pieces[-1] += warc.SEAM + c
            else:
                pieces.append(c)
        records = warc.Assembler()
        found = [x for piece in pieces for x in records.add("f", piece)] + list(records.end())
        assert [(h["warc-record-id"][0], b.decode()) for h, b in found] == [(str(i), x) for i, x in enumerate(blocks)]


def test_payloads_that_end_like_a_seam(spark):
    """Many records over many buffers of the reader: none is lost."""
    rows = [(i, "h", str(i) + "\r\n" * (i % 4) + "\r" * (i % 3 == 1)) for i in range(20_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)
    got = warc.round_trip(pages).select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(i, len(h)) for i, _, h in rows]


def test_malformed_archives_are_read(spark, tmp_path):
    body = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    text = body.format("response", "a", "x7", "HTTP\r\n\r\nab") + body.format("metadata", "b", 11, "page-id: 1x") + body.format("revisit", "c", 25, "Content-Length: none\r\n\r\n.") + "WARC/1.0\r\nWARC-Type: metadata\r\n" + "\r\n\r\n" + body.format("response", "e", 500, "cut off")
    (tmp_path / "part-0").write_bytes(text.encode())
    got = {r["record_id"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c", None, "e"} and got["a"]["payload_bytes"] >= 2 and got["b"]["page_id"] is None and got["c"]["payload_bytes"] is None


def test_transactions_by_either_pointer(spark):
    rows = [("r1", "request", None, "s1"), ("s1", "response", None, None), ("m1", "metadata", None, "s1"), ("r2", "request", None, None), ("s2", "revisit", None, "r2"), ("x", "metadata", None, "gone")]
    records = spark.createDataFrame([(i, t, u, c) for i, t, u, c in rows], "record_id string, type string, uri string, concurrent_to string")
    got = {r["capture_id"]: tuple(x and x["record_id"] for x in (r["request"], r["response"], r["metadata"])) for r in warc.transactions(records).collect()}
    assert got == {"s1": ("r1", "s1", "m1"), "s2": ("r2", "s2", None), "gone": (None, None, "x")}


def _edits(pattern, stream):
    """Fewest edits of the pattern to a substring of the stream, by the plain recurrence."""
    row = [0] * (len(stream) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(stream, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_are_found_as_alignment_says(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = lambda n: " ".join("".join(rng.choice(letters, rng.integers(2, 8))) for _ in range(n))
    items = [(i, words(40)) for i in range(6)] + [(6, None), (7, ""), (8, "tiny")]
    docs = [(100 + i, words(80)) for i in range(20)]
    for i in range(6):
        t = items[i][1]
        docs.append((i, words(30) + " -- " + t.upper() + "!! " + words(20)))
        docs.append((10 + i, words(10) + " " + t[: len(t) // 2] + " " + words(10)))
        noisy = list(t)
        for k in range(0, len(noisy), 40):
            noisy[k + int(rng.integers(0, 10))] = rng.choice(letters)
        docs.append((20 + i, words(10) + " " + "".join(noisy) + " " + words(10)))
        docs.append((30 + i, words(10) + " " + " ".join(w if k % 3 else words(1) for k, w in enumerate(t.split())) + " " + words(10)))
    docs += [(300, None), (301, ""), (302, "tiny"), (303, items[0][1] * 400), (304, items[1][1]), (304, items[1][1])]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, item_id int, edits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.matches(frame, bench).collect()
    index = decontaminate.build(items)
    from doculith.llm.common import symbols

    want = set()
    for i, t in docs:
        if i == 303:
            want.add((303, 0))
            continue
        stream = symbols([t], 1, digits=True)[0].tolist()
        for s, pattern in enumerate(index.pattern(np.arange(len(index.item)))):
            if len(stream) >= decontaminate.Q and _edits(pattern[: index.size[s]].tolist(), stream) <= index.budget[s]:
                want.add((i, int(index.item[s])))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {(i, i) for i in range(6)} <= want and {(10 + i, i) for i in range(6)} <= want
    assert not any(r["doc_id"] >= 100 and r["doc_id"] < 300 for r in got)
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench).collect()]
    assert sorted(kept) == sorted(i for i, _ in docs if i not in {d for d, _ in want})
    assert decontaminate.matches(frame, bench.where("false")).count() == 0 and decontaminate.matches(frame.where("false"), bench).count() == 0


def test_neighbours_do_not_complete_a_passage(spark):
    """Rows that together hold an item, in every order and partitioning: none of them is reported, or goes."""
    item = "the quick brown fox jumps over a lazy dog and then it runs away home again"
    bench = spark.createDataFrame([(1, item), (2, item + " 12 plus 30 makes 42 " * 8)], "item_id bigint, text string")
    rows = [(i, t) for i in range(0, 40, 4) for i, t in ((i, "zz the quick brown fox jumps over a lazy"), (i + 1, "dog and then it runs away home again yy"), (i + 2, ""), (i + 3, None))]
    for texts in (rows, rows[::-1]):
        frame = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
        assert decontaminate.matches(frame, bench).count() == 0
        assert decontaminate.drop_contaminated(frame, bench).count() == len(rows)


def test_verbatim_passages_at_every_offset(spark):
    """A passage of SEGMENT + STRIDE - 1 symbols is found wherever it begins; digits are symbols, and other numbers are no leak."""
    rng = np.random.default_rng(12)
    item = " ".join(str(x) for x in rng.integers(100, 10**6, 60))
    size = decontaminate.SEGMENT + decontaminate.STRIDE - 1
    rows = [(i, "begin. " + item[i : i + size] + " .end") for i in range(0, len(item) - size)]
    rows += [(1000 + i, " ".join(str(x) for x in rng.integers(100, 10**6, 60))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"] for r in decontaminate.matches(frame, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == set(range(len(item) - size))


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    items = [(i, words(30)) for i in range(12)]
    frame = spark.createDataFrame([(i, words(20) + t) for i, t in items], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, decontaminate.matches(frame, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    assert one == sorted(map(tuple, decontaminate.matches(frame, bench).collect())) and len(one) == 12


def test_toxic_words_of_held_out_texts(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(900):
        words = [str(w) for w in rng.choice(WORDS[["en", "de", "fr"][i % 3]], int(rng.integers(20, 200)))]
        if i % 5 == 0:
            words.insert(int(rng.integers(0, len(words))), "Idiot" + ["", "en", "s"][i % 3])
        rows.append((i, " ".join(words), 3))
        labels.append((i, int(i % 5 == 0), 9))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "the and " * 50_000, 1), (1003, "the idiot", 1), (1003, "the idiot", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int").repartition(3)
    known = spark.createDataFrame([*labels, (1003, None, 1), (None, 1, 1)], "doc_id bigint, toxic int, text int")
    held = lang_id.held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, known, ~held)
    got = toxicity.score(docs, model).withColumn("held_out", held).collect()
    assert len(got) == len(rows)
    truth = dict((i, y) for i, y, _ in labels)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert {r["predicted"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {0} and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows if truth.get(i, int(i == 1003)) == 0}
    nothing = toxicity.fit(docs, known.where("false"))
    assert {r["predicted"] for r in toxicity.score(docs, nothing).collect()} == {0}


def _plain_features(text):
    """The 4- and 5-grams of lower-cased letters, every other run being a gap, with a gap at both ends."""
    t = " " + re.sub(r"[^a-zäöüßéèêàùîû]+", " ", (text or "").lower())
    t += "" if t.endswith(" ") and len(t) > 1 else " "
    return {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}


def test_every_ngram_counts_with_its_ratio(spark):
    """The model's features are all n-grams of the labelled texts, and its fit starts from their log-count ratios."""
    rng = np.random.default_rng(21)
    rows = [(i, _text(rng, ["en", "de", "fr"][i % 3], int(rng.integers(1, 30))), "a", "b", "c") for i in range(150)]
    labels = [(i, int(i % 4 == 0), "x") for i in range(150)]
    rows += [(150, "the same id has both labels", "", "", ""), (150, "the same id has both labels", "", "", "")]
    labels += [(150, 0, ""), (150, 1, ""), (151, 1, ""), (5, None, ""), (None, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tox_y string, llm_toxicity_score string, LLM_TOXICITY_SCORE_ string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int, id string")
    model = toxicity.fit(docs, known)
    truth = {i: y for i, y, _ in labels[:150] if y is not None} | {150: 1}
    counts = [Counter(), Counter()]
    for i, t, *_ in rows:
        counts[truth[i]].update(_plain_features(t))
    n0, n1 = (sum(truth[i] == k for i, *_ in rows) for k in (0, 1))
    names = set(counts[0]) | set(counts[1])
    assert len(model.key) == len(names)
    add = toxicity.SMOOTH / (n0 + n1)
    want = sorted(np.log((counts[1][f] + add * n1) / n1) - np.log((counts[0][f] + add * n0) / n0) for f in names)
    row, key = toxicity.ngrams([t for _, t, *_ in rows])
    at = np.searchsorted(model.key, key)
    row, at = toxicity.distinct(row, at, len(model.key))
    y = np.array([truth[i] for i, *_ in rows])
    c0, c1 = (np.bincount(at[y[row] == k], minlength=len(model.key)) for k in (0, 1))
    assert np.allclose(sorted(toxicity.log_count_ratio(c0, c1, n0, n1)), want, atol=1e-5)
    scores = toxicity.scorer(model)([t for _, t, *_ in rows])
    plain = [1 / (1 + np.exp(-(model.weight[at[row == i]].sum(dtype=np.float64) + model.bias))) for i in range(len(rows))]
    assert np.allclose(scores, plain, atol=1e-5)
    kept = toxicity.keep_clean(docs, model, threshold=1.1)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows)


def test_places_of_keys():
    rng = np.random.default_rng(22)
    key = np.unique(rng.integers(0, 2**61, 5000))
    places = toxicity.Places(key)
    assert (places.of(key[::-1]) == np.arange(len(key))[::-1]).all() and (places.of(key + 1)[~np.isin(key + 1, key)] == -1).all()
    assert toxicity.Places(key[:0]).of(key[:3]).tolist() == [-1, -1, -1]


def _base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(8)
    pieces = ["a.b@c.d", "@", "x@y", "x@y.", "u@v.w@z.q", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456", "+1", "+12345678901234567", " ", "é", "\n", "-", "7", "..", "%+", "😀"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces, rng.integers(1, 12)))
        assert [s for s in ((k, a, b) for a, b, k, _ in pii.find(t)) if s[0] in pii.BASE] == _base_spans(t), t


def test_validators_and_context():
    assert [s[2] for s in pii.find("IBAN GB82 WEST 1234 5698 7654 32")] == ["iban"] and pii.find("GB82 WEST 1234 5698 7654 33") == []
    assert [s[2] for s in pii.find("social security 123-45-6789")] == ["ssn"] and pii.find("part 123-45-6789") == []
    # A context word stands alone.
    assert pii.find("ship to 1.2.3.4")[0][3] == pii.START["ip"] < pii.find("ip is 1.2.3.4")[0][3] and pii.find("antisocial 123-45-6789") == []
    assert pii.find("1" * 300_000) == [] and pii.find("a" * 300_000) == [] and len(pii.find("x@y.z " * 20_000)) == 20_000


def test_personal_data_over_odd_rows(spark):
    rows = [(1, "mail a@b.co or 1.2.3.4", "k"), (2, None, None), (3, "", ""), (1, "mail a@b.co or 1.2.3.4", "k"), (None, "+49 30 1234567", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = [tuple(r) for r in pii.digest(docs).orderBy("doc_id").collect()]
    line = "email:5:11,ip:15:22"
    assert got.count((1, 1, 1, 0, 0, hashlib.sha256(line.encode()).hexdigest(), line)) == 2 and len(got) == 5
    assert (2, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "") in got and (3, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "") in got
    masked = pii.redact(docs)
    assert masked.schema == docs.schema and Counter(r["text"] for r in masked.collect()) == Counter({"mail [EMAIL] or [IP]": 2, None: 1, "": 1, "[PHONE]": 1})
    assert pii.redact(docs.where("false")).count() == 0


def test_mixing_meets_its_weights(spark, docs):
    many = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 10 + cast(id % 50 as int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 's1' ELSE NULL END AS source", "1 AS rate", "2 AS cdf", "3 AS first")
    mixed = mixing.mix(many, {"hot": 1.0, "s1": 3.0}, 0.5)
    assert mixed.columns == [*many.columns, "mix_copies", "mix_copy", "mix_key"]
    chars = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(chars.values())
    for source, share in (("hot", 1 / 4.5), ("s1", 3 / 4.5), (None, 0.5 / 4.5)):
        assert abs(chars[source] / total - share) < 0.03
    rows = mixed.collect()
    assert Counter(Counter((r["doc_id"]) for r in rows).values()) == Counter({r["doc_id"]: r["mix_copies"] for r in rows}.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(many.repartition(7), {"hot": 1.0, "s1": 3.0}, 0.5).collect())) if None not in chars else True
    assert {r["source"] for r in mixing.mix(many.na.fill("n"), {"hot": 0.0}, 1.0).collect()} == {"s1", "n"}
    assert mixing.mix(docs, {}, 1.0).count() > 0 and mixing.mix(docs.where("false"), {}, 1.0).count() == 0


def test_poisson_is_inverted_also_for_large_rates(spark):
    rated = spark.createDataFrame([("a", 0.5), ("b", 900.0), ("c", 4.0e8), (None, 250.0), ("z", 0.0)], "source string, rate double")
    got = {r["source"]: r for r in mixing.poisson_cdfs(rated, "source", "rate", "first", "cdf").collect()}
    assert set(got) == {"a", "b", "c", None} and got["a"]["first"] == 0
    assert abs(got["a"]["cdf"][0] - np.exp(-0.5)) < 1e-12 and abs(got["a"]["cdf"][1] - 1.5 * np.exp(-0.5)) < 1e-12
    for name, rate in (("b", 900.0), ("c", 4.0e8), (None, 250.0)):
        cdf, first = np.array(got[name]["cdf"]), got[name]["first"]
        p = np.diff(np.append(0.0, cdf))
        k = first + np.arange(len(p))
        assert abs(cdf[-1] - 1) < 1e-6 and abs((p * k).sum() / rate - 1) < 1e-6 and abs((p * (k - rate) ** 2).sum() / rate - 1) < 1e-3
        assert len(cdf) < 24 * rate**0.5 + 170 and (first > 0) == (name in "bc" if name else False)


def test_a_tiny_source_beside_a_large_one(spark):
    """One character has a rate of many thousands: its copies come in parts, and its table of probabilities stays small."""
    docs = spark.range(200).selectExpr("id AS doc_id", "CASE WHEN id = 0 THEN 'x' ELSE repeat('y', 1000) END AS text", "CASE WHEN id = 0 THEN 'tiny' ELSE 'large' END AS source")
    mixed = mixing.mix(docs, {}, 1.0)
    n = mixed.where("doc_id = 0").agg(F.count("*").alias("n"), F.min("mix_copies").alias("copies"), F.countDistinct("mix_copy").alias("different"), F.max("mix_copy").alias("last")).first()
    assert abs(n["n"] - 99_500) < 2_000 and n["n"] == n["copies"] == n["different"] == n["last"]


def test_mixing_keeps_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(i, "ab", "s", 5.5, 7, 8, "k", "x", 1) for i in range(60)], "doc_id bigint, text string, source string, mix_rate double, mix_copies int, MIX_COPY int, mix_key string, llm_u string, llm_source int")
    mixed = mixing.mix(docs, {}, 1.0)
    assert mixed.columns == [*docs.columns, "mix_copies_", "mix_copy_", "mix_key_"]
    assert {tuple(r)[3:9] for r in mixed.collect()} == {(5.5, 7, 8, "k", "x", 1)}
