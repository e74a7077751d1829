"""Recognition in page batches, backend answers, the review log and observed progress."""

import itertools
import os
import uuid

import pytest
from pyspark.sql import functions as F

from doculith.operators import answers, reviewlog
from doculith.plans import analysis
from doculith.plans.progress import Progress
from doculith.sources import recognition


def test_pages_fail_alone_and_keep_their_order(spark, tmp_path):
    calls = str(tmp_path)

    def recogniser(images):
        open(f"{calls}/{len(images)}-{uuid.uuid4().hex}", "w").close()
        if b"bad" in images:
            raise RuntimeError("smudge")
        return [i.decode() for i in images]

    rows = [("a", p, f"a{p}".encode()) for p in range(1, 13)] + [("b", 1, b"b1"), ("b", 2, b"bad"), ("b", 3, None), ("b", 4, b"b4"), ("c", None, b"c"), (None, 1, b"n")]
    df = spark.createDataFrame(rows[::-1], "doc string, page int, image binary").repartition(3)
    got = {(r["doc"], r["page"]): (r["text"], r["method"], r["error"]) for r in recognition.recognise(df, recogniser, "doc").collect()}
    assert got.pop(("b", 2)) == ("", "ocr", "RuntimeError: smudge") and got.pop(("b", 3)) == ("", "ocr", "no image")
    assert got == {(d, p): (i.decode(), "ocr", None) for d, p, i in rows if i not in (None, b"bad")}
    sizes = sorted(int(f.split("-")[0]) for f in os.listdir(calls))
    # a: 5, 5 and 2 pages; b: three at once, then each alone; c and the document without a name: one each.
    assert sizes == [1, 1, 1, 1, 1, 2, 3, 5, 5]
    whole = {r["doc"]: (r["text"], r["pages"], r["failed_pages"]) for r in recognition.documents(recognition.recognise(df, recogniser, "doc"), "doc").collect()}
    assert whole["a"] == ("\n---\n".join(f"a{p}" for p in range(1, 13)), 12, 0) and whole["b"] == ("b1\n---\n\n---\n\n---\nb4", 4, 2)
    assert recognition.recognise(df.where("false"), recogniser, "doc").count() == 0


def test_equal_questions_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")
    os.makedirs(log)

    def backend(asked):
        name = f"{log}/{uuid.uuid4().hex}"
        with open(name, "w") as f:
            f.write("\n".join(asked))
        if any("bad" in q for q in asked):
            raise ConnectionError("refused")
        return [q.upper() for q in asked]

    def questions():
        out = [q for f in os.listdir(log) for q in open(f"{log}/{f}").read().split("\n")]
        for f in os.listdir(log):
            os.remove(f"{log}/{f}")
        return sorted(out)

    cache = str(tmp_path / "cache")
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(["x", "y", "x", "bad", None, "x", "z", "bad"])], "k int, q string").repartition(3)
    got = answers.ask(rows, "q", backend, cache, batch=2, retries=1, parallel=1)
    assert sorted((r["k"], r["answer"], r["error"]) for r in got.collect()) == [(0, "X", None), (1, "Y", None), (2, "X", None), (3, None, "ConnectionError: refused"), (4, None, None), (5, "X", None), (6, "Z", None), (7, None, "ConnectionError: refused")]
    first = questions()
    assert set(first) == {"x", "y", "z", "bad"} and all(first.count(q) <= 3 for q in "xyz") and first.count("bad") == 4
    got.collect()
    assert questions() == []  # reading again asks nothing
    more = rows.union(spark.createDataFrame([(9, "new")], "k int, q string"))
    assert {r["answer"] for r in answers.ask(more, "q", backend, cache, batch=8, retries=0, parallel=1).collect()} == {"X", "Y", "Z", "NEW", None}
    second = questions()
    assert set(second) == {"bad", "new"}  # the answers of before are kept, failures are asked again
    assert answers.ask(rows.where("false"), "q", backend, cache).count() == 0 and questions() == []
    short = answers.called(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, question string").coalesce(1), lambda asked: asked[:1], retries=0)
    assert {r["key"]: r["answer"] for r in short.collect()} == {"a": "1", "b": "2"}


_EVENTS = [
    ("e1", "c1", "2024-01-01 10:00:00", None, None), ("e2", "c1", "2024-01-01 11:00:00", "Task", "ann"), ("e3", "c1", "2024-01-01 10:30:00", "Concept", "bob"),
    ("e4", "c2", "2024-01-01 10:00:00", None, None), ("e5", "c3", "2024-01-01 09:00:00", "Task", "ann"), ("e5", "c3", "2024-01-01 09:00:00", "Task", "ann"),
    ("e6", "c3", "2024-01-01 09:00:00", None, None), ("e7", "c4", "2024-01-01 12:00:00", "Task", "ann"), ("e8", "c4", "2024-01-01 13:00:00", None, None),
    (None, "c5", "2024-01-01 12:00:00", "Task", "x"), ("e9", None, "2024-01-01 12:00:00", "Task", "x"), ("e10", "c5", None, "Task", "x"),
]
_WANT = {"c1": ("labelled", "Task", "ann"), "c2": ("queued", None, None), "c3": ("labelled", "Task", "ann"), "c4": ("queued", None, None)}


def _frame(spark, events):
    return spark.createDataFrame(events, "event_id string, chunk_id string, at string, label string, reviewer string").withColumn("at", F.col("at").cast("timestamp"))


def _told(state):
    return {r["chunk_id"]: (r["status"], r["label"], r["reviewer"]) for r in state.collect()}


def test_batches_in_any_order_give_one_state(spark, tmp_path):
    parts = [_EVENTS[:4], _EVENTS[3:8], _EVENTS[7:] + _EVENTS[:1]]
    for n, order in enumerate(itertools.permutations(range(3))):
        log = reviewlog.ReviewLog(spark, str(tmp_path / str(n)))
        assert log.compact() is None and log.state().count() == 0
        for i, k in enumerate(order):
            log.append(_frame(spark, parts[k]))
            if i == n % 3:
                log.compact()
        assert _told(log.state()) == _WANT
        log.append(_frame(spark, parts[order[0]]), 0)  # a stream repeats a batch
        assert _told(log.state()) == _WANT
        log.compact()
        assert _told(log.state()) == _WANT
        if n == 1:
            break
    assert _told(reviewlog.state(_frame(spark, _EVENTS))) == _WANT
    assert [r["chunk_id"] for r in reviewlog.queue(log.state()).collect()] == ["c2", "c4"]


def test_a_broken_snapshot_is_not_seen(spark, tmp_path):
    log = reviewlog.ReviewLog(spark, str(tmp_path))
    log.append(_frame(spark, _EVENTS[:2]))
    assert log.compact() == 0
    log.append(_frame(spark, _EVENTS[2:]))
    os.makedirs(tmp_path / "snapshots" / f"{1:012d}")  # a compaction that ended before its marker
    assert _told(log.state()) == _WANT
    assert log.compact() == 1 and _told(log.state()) == _WANT


def test_a_stream_of_events_feeds_the_log(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(0, len(_EVENTS), 4):
        _frame(spark, _EVENTS[i : i + 4]).coalesce(1).write.mode("append").parquet(source)
    log = reviewlog.ReviewLog(spark, str(tmp_path / "log"))
    shape = spark.read.parquet(source).schema
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        log.follow(stream, str(tmp_path / "check"), every=2).trigger(availableNow=True).start().awaitTermination()
    assert _told(log.state()) == _WANT and log._versions("snapshots") == [0]


def test_stages_are_counted_while_the_plan_runs(spark):
    docs = spark.createDataFrame([("a", "# T\n\n## How to install\n\n1. Open it.\n2. Run it.\n\n## Overview of it\n\nIt is a thing. It means much."), ("b", "## What is it\n\nIt is a tool."), ("c", None)], "doc_id string, markdown string")
    seen = []
    progress = Progress(seen.append)
    rows = analysis.end_to_end(docs, progress=progress).collect()
    stages = {s.name: (s.rows_in, s.rows_out, s.failed) for s in progress.stages()}
    assert stages["documents"] == (None, 3, 1) and stages["chunks"][:2] == (3, 3) and stages["topics"] == (3, 3, 0)
    assert stages["scored"][:2] == (3, len(rows)) and stages["scored"][2] == sum(not r["qa_success"] for r in rows)
    assert [s.name for s in seen] == ["documents", "chunks", "topics", "scored"]


@pytest.mark.parametrize("wrong", ["x", "1"])
def test_retries_end(spark, wrong):
    df = spark.createDataFrame([("k", wrong)], "key string, question string")

    def never(asked):
        raise TimeoutError(asked[0])

    assert answers.called(df, never, retries=1, wait=0.01).first()["error"] == f"TimeoutError: {wrong}"


def test_settings_reach_the_classifiers_and_the_loop(spark):
    names = {"doculith.ruleWeight": "1.0", "doculith.sure": "1.0", "doculith.reviewBelow": "0.0", "doculith.passes": "1"}
    docs = spark.createDataFrame([("a", "## How to install\n\n1. Open it.\n2. Run it.")], "doc_id string, markdown string")
    before = analysis.analyse(docs).first()
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        options = analysis.Options.of(spark)
        assert (options.rule_weight, options.sure, options.review_below, options.passes) == (1.0, 1.0, 0.0, 1)
        chunk = analysis.analyse(docs, options=options).first()
        assert chunk["confidence"] == chunk["t1_confidence"] and not chunk["needs_review"]
        assert analysis.end_to_end(docs, options=options).first()["iterations"] == 1
        for k, v in (("doculith.sure", "2"), ("doculith.passes", "0")):
            spark.conf.set(k, v)
            with pytest.raises(ValueError):
                analysis.Options.of(spark)
            spark.conf.set(k, names[k])
    finally:
        for k in names:
            spark.conf.unset(k)
    assert analysis.Options.of(spark) == analysis.Options() and analysis.analyse(docs).first() == before


def test_merged_rows_are_the_merged_document(spark):
    from doculith.operators import quality

    rows = [(k, i, f"<task><taskbody><p>{i}</p></taskbody></task>", i % 4 > 0) for k in ("a", None, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "k string, i int, final_xml string, qa_success boolean").repartition(5)
    lines = quality.merged_rows(docs, "k", "i").collect()
    whole = {r["k"]: r["merged_xml"] for r in quality.merge(docs, "k", "i").collect()}
    for k in ("a", None, "b"):
        assert "\n".join(r["line"] for r in sorted(lines, key=lambda r: r["line_no"]) if r["k"] == k) == whole[k]
    assert quality.merged_rows(docs.where("false"), "k", "i").count() == 0


def test_json_arrays_and_the_marker_rule(spark, tmp_path):
    import json

    from doculith.sources import files, sinks

    rows = spark.range(10).selectExpr("id", "nullif(concat('x', id), 'x3') AS t").repartition(3)
    sinks.write_json_array(rows, str(tmp_path / "many"))
    sinks.write_json_array(rows, str(tmp_path / "one"), 1)
    sinks.write_json_array(rows.where("false").coalesce(1), str(tmp_path / "none"))
    read = lambda name: [json.load(open(tmp_path / name / f)) for f in os.listdir(tmp_path / name) if f.startswith("part-")]
    want = [{"id": i, "t": None if i == 3 else f"x{i}"} for i in range(10)]
    assert sorted((x for part in read("many") for x in part), key=lambda x: x["id"]) == want
    assert [sorted(p, key=lambda x: x["id"]) for p in read("one")] == [want] and read("none") == [[]]
    pages = spark.createDataFrame([("a", "x", "marker"), ("a", "", "text"), ("b", "x", "text"), ("c", "x" * 200, None)], "d string, text string, m string")
    assert {r["d"]: r["needs_ocr"] for r in files.needs_ocr(pages, "d", method="m").collect()} == {"a": False, "b": True, "c": False}
    assert {r["d"]: r["needs_ocr"] for r in files.needs_ocr(pages, "d").collect()} == {"a": True, "b": True, "c": False}
