"""Glossaries, image links in one pass, and the images of Word files with their commit."""

import io
import os
import random
import re
import subprocess
import sys
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from doculith.operators import features, glossary, rules, xmlnodes
from doculith.sources import images, sinks


def test_fifty_thousand_terms(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 9))).strip()
    terms = {}
    while len(terms) < 50_000:
        if w := word():
            terms[w] = f"use {w}" if len(w) % 2 else None
    texts = [(i, "".join(rng.choice("abcdeéABC \n") for _ in range(400))) for i in range(60)] + [(100, None), (101, ""), (102, "aaaa")]
    table = spark.createDataFrame([*terms.items(), ("AAA", "b"), ("aaa", "c"), ("aa", None), (None, "x"), ("", "y")], "term string, use string")
    terms |= {"aaa": "b" if terms.get("aaa") is None else min("b", terms["aaa"]), "aa": terms.get("aa")}
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    want = {(i, t, u, t_.lower().count(t)) for i, t_ in texts if t_ for t, u in terms.items() if t in t_.lower()}
    got = glossary.occurrences(docs, table, "doc_id")
    assert {tuple(r) for r in got.collect()} == want and ("aaa", "b") in {(r["term"], r["use"]) for r in got.where("doc_id = 102").collect()}
    monkeypatch.setattr(glossary, "SHARD_CHARS", 300_000)  # several passes
    assert len(glossary.shards(table)) > 2
    assert {tuple(r) for r in glossary.occurrences(docs, table, "doc_id").collect()} == want
    assert glossary.occurrences(docs, table.where("false"), "doc_id").count() == 0


def test_issues_carry_the_right_term(spark):
    parsed = xmlnodes.parse(spark.createDataFrame([("<concept><title>Utilize</title><p>In <b>order</b> to click on it</p></concept>",), ("<a/>",), ("<broken",)], "xml string"))
    terms = spark.createDataFrame([("click on", "click"), ("Utilize", "use"), ("unused", "x")], "term string, use string")
    rows = rules.glossary_issues(parsed, terms).collect()
    assert [[(i["rule"], i["detail"], i["suggestion"]) for i in r["glossary_issues"]] for r in rows] == [[("terminology_consistency", "click on", "click"), ("terminology_consistency", "utilize", "use")], [], []]
    own = rules.Registry().run(parsed).first()["rule_issues"]
    assert {(i["detail"], i["suggestion"]) for i in own if i["rule"] == "terminology_consistency"} == {("click on", "click"), ("utilize", "use")}


def _fold(text, entries):
    """The entries of a map one after another, as the definition says."""
    for name, path in entries:
        put = lambda m, p=path: f"![{m[1]}]({p})"
        text = re.sub(r"!\[([^\]]*)\]\(" + re.escape(name) + r"(?:\.png)?\)", put, text)
        text = re.sub(r'<img\s+src="' + re.escape(name) + r'\.png"[^\n]*?>', lambda m, p=path: f'<img src="{p}">', text)
    return text


def _rewritten(spark, rows):
    df = spark.createDataFrame(rows, "k int, md string, m array<struct<key:string,value:string>>")
    return [r["t"] for r in df.select("k", features.rewrite_image_links(F.col("md"), F.map_from_entries("m")).alias("t")).orderBy("k").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_links_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "a.png", "b.png.png", "x(1)", "x(1", "q\"r", "s p", "$1", "\\d", ""]
    rows = []
    for k in range(150):
        entries = [(n, rng.choice([f"../images/{len(n)}.png", "b", "c.png", "s p", "$0\\1", "a"])) for n in rng.sample(names, rng.randrange(0, 8))]
        pieces = []
        for _ in range(rng.randrange(0, 12)):
            n = rng.choice(names) + rng.choice(["", ".png", ".PNG", ".png.png"])
            alt = rng.choice(["", "alt", "a![", "](", f'<img src="{n}">', "line\nend"])
            pieces.append(rng.choice([f"![{alt}]({n})", f'<img src="{n}">', f'<img\n src="{n}" width="3">', f'<img src="{n}"\n>', f"[x]({n})", "![open](", "text ", f"![u]({n}", '<img src="']))
        rows.append((k, "".join(pieces), entries))
    assert _rewritten(spark, rows) == [_fold(t, e) for _, t, e in rows]


def test_five_thousand_images_in_one_document(spark):
    entries = [(f"i{n}", f"../images/i{n}.png" if n % 5 else f"i{n + 3}") for n in range(5000)]
    order = list(range(5000))
    random.Random(1).shuffle(order)
    text = "\n".join(f"![{n}](i{n}.png)" if n % 2 else f'<img src="i{n}.png" width="1">' for n in order)
    began = time.time()
    got = _rewritten(spark, [(0, text, entries), (1, None, entries), (2, text, None)])
    assert time.time() - began < 10
    place = dict(entries)

    def last(n, bare):
        path = place[f"i{n}"]
        return last(n + 3, True) if bare and n % 5 == 0 and n + 3 < 5000 else path

    assert got[1:] == [None, None]
    assert got[0] == "\n".join(f"![{n}]({last(n, True)})" if n % 2 else f'<img src="{last(n, False)}">' for n in order)


def _docx(rels, body, media):
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        if rels is not None:
            listed = "".join(f'<Relationship Id="{i}" Type="{kind}/{t}" Target="{p}"{" TargetMode=\"External\"" if x else ""}/>' for i, t, p, x in rels)
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{listed}</Relationships>')
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        for name, data in media.items():
            z.writestr(name, data)
    return out.getvalue()


def _files(spark):
    shape = lambda how: f"<w:p><w:r><w:drawing><wp:inline><a:graphic><a:blip {how}/></a:graphic></wp:inline></w:drawing></w:r></w:p>"
    rels = [("r1", "image", "media/one.png", False), ("r2", "image", "/word/media/two.png", False), ("r3", "styles", "styles.xml", False), ("r4", "image", "http://x/y.png", True), ("r5", "image", "media/gone.png", False)]
    body = "".join(shape(h) for h in ('r:embed="r2"', 'r:embed="r5"', 'r:link="r4"', 'r:embed="r1"', 'r:embed="r9"', 'r:embed="r2"')) + '<w:p><w:r><w:drawing><wp:anchor/></w:drawing></w:r></w:p>'
    rows = [("a.docx", _docx(rels, body, {"word/media/one.png": b"ONE", "word/media/two.png": b"TWO" * 1000})), ("b.docx", _docx(None, "<w:p/>", {})), ("c.docx", b"no zip"), ("d.docx", None)]
    return spark.createDataFrame(rows, "path string, content binary").repartition(2)


def test_images_of_word_files(spark):
    df = _files(spark)
    graph = {(r["path"], r["rel_id"]): (r["kind"], r["target"], r["external"]) for r in images.relationships(df, "content", "path").where("error is null").collect()}
    assert graph == {("a.docx", "r1"): ("image", "word/media/one.png", False), ("a.docx", "r2"): ("image", "word/media/two.png", False), ("a.docx", "r3"): ("styles", "word/styles.xml", False), ("a.docx", "r4"): ("image", "http://x/y.png", True), ("a.docx", "r5"): ("image", "word/media/gone.png", False)}
    rows = images.word_images(df, "content", "path")
    good = [(r["path"], r["image_index"], bytes(r["image"]), r["image_name"], r["image_file"], r["image_path"]) for r in rows.where("error is null").orderBy("image_index").collect()]
    assert good == [("a.docx", i, b, f"0_image_{i}", f"0_image_{i}.png", f"../images/0_image_{i}.png") for i, b in enumerate([b"TWO" * 1000, b"ONE", b"TWO" * 1000])]
    bad = {(r["path"], r["rel_id"]): r["error"] for r in rows.where("error is not null").collect()}
    assert set(bad) == {("a.docx", "r5"), ("a.docx", "r4"), ("a.docx", "r9"), ("c.docx", None), ("d.docx", None)} and bad["a.docx", "r9"] == "no relationship"
    docs = spark.createDataFrame([("a.docx", "Text"), ("b.docx", "Other")], "path string, markdown string")
    closed = {r["path"]: r["markdown"] for r in images.with_image_section(docs, rows, "path").collect()}
    shown = "\n\n".join(f"![0_image_{i}](../images/0_image_{i}.png)" for i in range(3))
    assert closed == {"a.docx": f"Text\n\n## 文档图片\n\n{shown}", "b.docx": "Other"}


def _tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names if "_log" not in d}


def test_commit_of_files(spark, tmp_path):
    folder = str(tmp_path)
    rows = images.word_images(_files(spark), "content", "path").select(F.concat(F.lit("a/images/"), "image_file").alias("name"), "image").where("name is not null")
    extra = spark.createDataFrame([("twice", b"1"), ("twice", b"2"), ("../out", b"3"), ("/abs", b"4"), (None, b"5"), ("null", None), ("", b"6")], "name string, image binary")
    done = sinks.commit_files(rows.union(extra), "name", "image", folder)
    assert {(r["name"], r["bytes"], r["error"]) for r in done.collect()} == {("a/images/0_image_0.png", 3000, None), ("a/images/0_image_1.png", 3, None), ("a/images/0_image_2.png", 3000, None), ("twice", None, "the name occurs twice"), ("../out", None, "the name leads out of the folder"), ("/abs", None, "the name leads out of the folder"), (None, None, "no name"), ("", None, "no name"), ("null", None, "no content")}
    want = {"a/images/0_image_0.png": b"TWO" * 1000, "a/images/0_image_1.png": b"ONE", "a/images/0_image_2.png": b"TWO" * 1000}
    assert _tree(folder) == want
    sinks.commit_files(rows, "name", "image", folder)  # again
    assert _tree(folder) == want

    def fails(batches):
        for b in batches:
            yield b
            raise RuntimeError("a lost disk")

    with pytest.raises(Exception, match="a lost disk"):
        sinks.commit_files(spark.createDataFrame([("new", b"7")], "name string, image binary").mapInArrow(fails, "name string, image binary"), "name", "image", folder)
    assert _tree(folder) == want


_RETRIED = """
import os, sys
from pyspark.sql import SparkSession
from doculith.sources import sinks
folder, marks = sys.argv[1:]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()

def first_attempt_fails(batches):
    from pyspark import TaskContext
    mark = f"{marks}/{TaskContext.get().partitionId()}"
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1)
            if i == 2 and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("the first attempt fails after it has written files")

rows = spark.range(40).selectExpr("concat('f', id) AS name", "cast(id AS string) AS content").repartition(4).mapInArrow(first_attempt_fails, "name string, content string")
done = sinks.commit_files(rows, "name", "content", folder)
assert done.count() == 40 and done.where("error is not null").count() == 0
assert len(os.listdir(marks)) == 4
"""


def test_failing_first_attempts_leave_each_file_once(tmp_path):
    folder, marks = tmp_path / "out", tmp_path / "marks"
    folder.mkdir(), marks.mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", _RETRIED, str(folder), str(marks)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert _tree(folder) == {f"f{i}": str(i).encode() for i in range(40)}


def test_links_are_rewritten_some_texts_at_a_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    from doculith.operators import features, xmlnodes

    monkeypatch.setattr(features, "pieces", lambda texts: ((i, 1) for i in range(len(texts))))
    rows = spark.createDataFrame([(i, f"![a](p{i}.png)" if i % 7 else None, {f"p{i}": f"q{i}"}) for i in range(40)], "k int, md string, m map<string,string>").coalesce(1)
    assert {r["k"]: r["x"] for r in rows.select("k", features.rewrite_image_links(F.col("md"), F.col("m")).alias("x")).collect()} == {i: f"![a](q{i})" if i % 7 else None for i in range(40)}
    assert xmlnodes.BATCH <= 512 and xmlnodes.BATCH_CHARS <= 1_000_000
