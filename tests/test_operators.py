"""Fixtures of single operators, invariants, and what has no SQL."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from doculith.functions import prompts, text
from doculith.operators import chunking, classify, errors, features, modelrecords, quality, render, repair, rules, stats, structure, validate, xmlnodes
from doculith.plans import analysis
from doculith.sources import files, sinks
from doculith.streaming import filedrop

SAMPLE = """# Introduction

This is the introduction section.

## Background

Some background information here.

### Prerequisites

- Python 3.8+
- pip installed
- Basic knowledge of APIs

## Installation

Follow these steps:

1. Install the package
2. Configure the API key
3. Run the application

### Code Example

```python
import requests
response = requests.get("https://api.example.com")
print(response.json())
```

## Conclusion

This is the conclusion.
"""


def _md(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, markdown string")


def test_heading_chunks_of_a_sample(spark):
    rows = features.extract(chunking.chunk(_md(spark, SAMPLE))).orderBy("chunk_no").collect()
    assert [(r["id"], r["level"], r["title"], r["char_count"], r["line_count"], r["list_items"]) for r in rows] == [
        ("chunk_1", 2, "Background", 36, 4, 0),
        ("chunk_2", 3, "Prerequisites", 58, 6, 3),
        ("chunk_3", 2, "Installation", 94, 8, 3),
        ("chunk_4", 3, "Code Example", 106, 8, 0),
        ("chunk_5", 2, "Conclusion", 26, 4, 0),
    ]
    code = rows[3]
    assert code["has_code_block"] and code["code_blocks"] == 1 and not code["has_inline_code"]
    assert rows[1]["has_bullet_list"] and rows[2]["has_numbered_list"]


def test_edges_of_chunking(spark):
    rows = chunking.chunk(_md(spark, "##    \nbody", "#### x\ny", "```\n## x\n```", " \n\t", None, "## a\n\n## b\nc", "x" * 1200 + "\n" + "y" * 10, "")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["id"], r["title"], r["level"], r["content"]))
    assert by == {
        0: [("chunk_1", "", 2, "body\n")],
        1: [("chunk_1", "Section 1", 2, "#### x\ny\n")],
        2: [("chunk_1", "x", 2, "```\n")],
        5: [("chunk_1", "b", 2, "c\n")],
        6: [("chunk_1", "Section 1", 2, "x" * 1200 + "\n"), ("chunk_2", "Section 2", 2, "y" * 10 + "\n")],
    }


def test_size_chunks_hold_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("markdown"))
    pieces = {}
    for r in chunking.chunk(docs).orderBy("doc_id", "chunk_no").collect():
        pieces.setdefault(r["doc_id"], []).append(r["content"])
        assert len(r["content"]) <= 501 or r["content"].count("\n") == 1
    for r in docs.collect():
        assert "".join(pieces[r["doc_id"]]).split() == r["markdown"].split()


def test_structural_edges(spark):
    texts = ["1.5 x\n1. y", "|a|\n|---|---|---|\n", "|a|\n| --- | --- |\n", "![a](b)", "```\n`x`\n```"]
    df = _md(spark, *texts).select("doc_id", F.col("markdown").alias("content"))
    rows = features.extract(df, only="structural").orderBy("doc_id").collect()
    assert rows[0]["has_numbered_list"] and rows[0]["list_items"] == 1
    assert (rows[1]["has_table"], rows[1]["table_count"], rows[2]["has_table"], rows[2]["table_count"]) == (True, 3, True, 0)
    assert rows[3]["has_links"] and rows[3]["has_images"] and not rows[4]["has_inline_code"]


def test_fusion_of_two_confident_answers(spark):
    row = spark.createDataFrame([("Task", 0.75, 0.75, 0.15, 0.10, "Task", 0.85, 0.85, 0.10, 0.05)], "t1_type string, t1_confidence double, t1_task double, t1_concept double, t1_reference double, t2_type string, t2_confidence double, t2_task double, t2_concept double, t2_reference double")
    r = classify.fuse(row).first()
    assert (round(r["task"], 6), round(r["concept"], 6), round(r["reference"], 6), r["type"], r["needs_review"]) == (0.82, 0.115, 0.065, "Task", False)
    assert r["reasoning"] == "Strong agreement: Both classifiers predict Task (Rules: 0.75, LLM: 0.85)"
    with pytest.raises(ValueError):
        classify.fuse(row, 0.5, 0.6)


def test_a_backend_sees_only_unsure_rows(spark):
    docs = _md(spark, SAMPLE, "## What is it\n\nIt is a thing.\n")
    seen = []

    def backend(rows):
        seen.append(rows.count())
        return classify.without_model(rows)

    with_backend = analysis.analyse(docs, backend=backend)
    plain = analysis.analyse(docs)
    cols = ["doc_id", "chunk_no", "type", "confidence", "needs_review", "reasoning", "t2_type"]
    assert sorted(map(str, with_backend.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    assert seen == [plain.where("t1_confidence < 0.9").count()]


def test_every_chunk_is_either_sure_or_for_review(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("markdown"))
    rows = analysis.analyse(docs)
    assert rows.where((F.col("confidence") >= 0.9) == F.col("needs_review")).count() == 0
    assert rows.where(F.abs(F.col("task") + F.col("concept") + F.col("reference") - 1) > 1e-9).count() == 0


def test_records_keep_the_quirks(spark):
    rows = [
        (1, "Task", "Installing Git", "lead\n1. one\n 2.two\n1.5 GB\n- not"),
        (2, "Task", "b", "**bold** x\n- y\n"),
        (3, "Task", "安装Git", "nothing"),
        (4, "Concept", "Section", "p1\n\np2\n\np3"),
        (5, "Concept", "Section 2", "p1\n\np2"),
        (6, "Reference", "1x", "| a |\n|  | b |\n| c | d |\n\n| e |"),
        (7, "Reference", "x", "no table"),
        (8, "Other", "x", "y"),
        (9, "Concept", None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, type string, title string, content string")
    got = {r["doc_id"]: r for r in structure.fix(structure.records(df)).collect()}
    assert got[1]["steps"] == ["one", "two", "5 GB"] and got[1]["record_id"] == "installing_git_2"
    assert got[2]["steps"] == ["*bold** x", "y"] and got[3]["steps"] == ["Complete the task"] and got[3]["record_id"] == "git_2"
    assert [s["id"] for s in got[4]["sections"]] == ["section_2_1", "section_3"] and [s["id"] for s in got[5]["sections"]] == ["section_2_3"]
    assert got[6]["columns"] == ["a"] and got[6]["rows"] == [["c", "d"]] and got[6]["record_id"] == "id_1x_2"
    assert got[7]["sections"][0]["content"] == "Reference information" and got[8]["record_error"].endswith("Other") and got[9]["introduction"] == "This is a concept description."
    xml = {r["doc_id"]: r["xml"] for r in render.render(structure.fix(structure.records(df))).collect()}
    assert xml[8] is None and all(xmlnodes.nodes_of(x)[1] is None for k, x in xml.items() if k != 8)


def test_rendered_task_has_its_shape(spark):
    df = spark.createDataFrame([(1, "Task", "A & B", "1. do <it>\n2. then")], "doc_id int, type string, title string, content string")
    xml = analysis.convert(df).first()["xml"]
    assert xml.split("\n")[2:] == ['<task id="a_b_2">', "  <title>A &amp; B</title>", "", "  <taskbody>", "", "    <steps>", "      <step>", "        <cmd>do &lt;it&gt;</cmd>", "      </step>", "      <step>", "        <cmd>then</cmd>", "      </step>", "    </steps>", "", "  </taskbody>", "</task>"]


@pytest.mark.parametrize("xml,good", [("<a/>", True), ('<!DOCTYPE a SYSTEM "x.dtd"><a/>', True), ("<a>", False), ("text", False), ("<a>&nbsp;</a>", False), ("<a>&</a>", False), ("<a/><b/>", False), ("", False), ('<a x="1" x="2"/>', False), (None, False), ('<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>', False)])
def test_well_formedness(xml, good):
    assert (xmlnodes.nodes_of(xml)[1] is None) == good


def test_texts_follow_the_document(spark):
    df = spark.createDataFrame([("<a>1<b>2<c>3</c>4</b>5<d/>6</a>",), ("<a/>",)], "xml string")
    rows = xmlnodes.parse(df).select(xmlnodes.texts(F.col("nodes")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["1 2 3 4 5 6", ""]


def test_repairs_in_turn(spark):
    xml = '<task id="a b"><title>Install it</title><taskbody><steps><step id="a b"><cmd>x</cmd></step></steps></taskbody></task>'
    out = repair.loop(spark.createDataFrame([(1, xml, "Task")], "doc_id int, xml string, content_type string")).first()
    assert out["loop_success"] and [n["id_attr"] for n in out["nodes"] if n["id_attr"]] == ["a_b", "a_b_2"] and out["iterations"] == 3


def test_quality_of_known_topics(spark):
    good = '<?xml version="1.0"?><task id="t"><title>Good</title><taskbody><steps><step><cmd>Go</cmd></step></steps></taskbody></task>'
    bare = '<task id="t"><taskbody><steps><step><cmd>Go</cmd></step></steps></taskbody></task>'
    bad = '<?xml version="1.0"?><task id="my invalid id"><title>Install it</title><taskbody><steps><step><cmd>Go</cmd></step></steps></taskbody></task>'
    no_cmd = '<?xml version="1.0"?><task id="t"><title>Install it</title><taskbody><steps><step/></steps></taskbody></task>'
    df = spark.createDataFrame([(1, good, "Task"), (2, bare, "Task"), (3, bad, "Task"), (4, no_cmd, "Task"), (5, "<a", "Task")], "doc_id int, xml string, content_type string")
    got = {r["doc_id"]: r for r in analysis.assure(df).collect()}
    assert (round(got[1]["overall_quality"], 6), got[1]["overall_status"], got[1]["qa_success"]) == (0.97, "passed_with_warnings", True)
    assert got[2]["total_issues"] == 0 and got[2]["overall_status"] == "failed"
    assert 'id="my_invalid_id"' in got[3]["final_xml"] and got[3]["iterations"] == 2 and round(got[3]["structure_quality"], 6) == 0.9
    assert (got[4]["iterations"], round(got[4]["overall_quality"], 6)) == (1, 0.81)
    assert got[5]["content_completeness"] == 1.0 and got[5]["rule_issues"][0]["rule"] == "xml_parse" and got[5]["total_issues"] == 0
    page = quality.html(analysis.assure(df), "doc_id").first()["html"]
    assert page.startswith("<!DOCTYPE html>")


def test_registry_takes_rules(spark):
    registry = rules.Registry()
    registry.add(rules.Rule("has_note", "info", lambda n: rules.when(F.size(xmlnodes.tagged(n, "note")) == 0, rules.found("has_note", "info"))))
    assert registry.remove("step_count") and not registry.remove("step_count") and registry.get("has_note") and "step_count" not in registry.names()
    df = xmlnodes.parse(spark.createDataFrame([("<concept><title>Long enough</title></concept>",)], "xml string"))
    out = registry.summary(registry.run(df)).first()
    assert (out["passed_rules"], out["failed_rules"], out["rule_infos"]) == (5, 1, 1)


def test_image_rule_with_known_files(spark):
    df = xmlnodes.parse(spark.createDataFrame([('<a><image href="x.png"/><image href="y.png"/><image href="http://z"/></a>',)], "xml string"))
    out = rules.Registry(known_images=["x.png"]).run(df).first()
    assert [(i["rule"], i["detail"]) for i in out["rule_issues"]] == [("image_references", "y.png")]


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, *runs: f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}{''.join(runs)}</w:p>"
    r = lambda t, props="": f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}<w:t>{t}</w:t></w:r>"
    c = lambda t: f"<w:tc>{p(None, r(t))}</w:tc>"
    table = f"<w:tbl><w:tr>{c('a')}{c('b')}</w:tr><w:tr>{c('1')}{c('2')}</w:tr></w:tbl>"
    body = p("H2", r("Title")) + table + p("ListBullet", r("item")) + p(None, r("bold", "<w:b/>"), r(" and "), r("code", '<w:rFonts w:ascii="Consolas"/>')) + p(None) + p(None, r("x = 1", '<w:rFonts w:ascii="Courier New"/>'))
    styles = f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
        z.writestr("word/media/image1.png", b"x")
    return out.getvalue()


def test_word_files(spark):
    df = spark.createDataFrame([("a.docx", _docx()), ("b.docx", b"no zip"), ("c.docx", None)], "path string, content binary")
    got = {r["path"]: r for r in files.read_word(df, "content", "path").collect()}
    assert got["a.docx"]["markdown"] == "## Title\n\n- item\n\n**bold** and `code`\n\n```\nx = 1\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert got["a.docx"]["headings"] == {"h2": 1} and (got["a.docx"]["tables"], got["a.docx"]["images"]) == (1, 1)
    assert got["b.docx"]["error"] and got["c.docx"]["error"]


def test_routes_of_odd_paths(spark):
    df = spark.createDataFrame([("/a/b.PDF",), ("noext",), ("/a.b/c",), (".docx",), (None,)], "path string")
    got = {r["path"]: (r["processor"], r["error"]) for r in files.route(df).collect()}
    assert got == {"/a/b.PDF": ("pdf", None), "noext": (None, "Unsupported file format: "), "/a.b/c": (None, "Unsupported file format: "), ".docx": (None, "Unsupported file format: "), None: (None, "File not found")}
    assert files.without_extractor(df).where("text = '' and error is not null").count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.dita", "<a>é</a>"), (2, "b.dita", None)], "doc_id int, file_name string, xml string")
    sinks.write_topics(df, str(tmp_path / "t"), "doc_id")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("1", "a.dita", "<a>é</a>")]
    sinks.write_markdown(df, str(tmp_path / "m"), "doc_id", "xml")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == [("1", "<a>é</a>"), ("2", "")]
    sinks.write_conversion_report(df, str(tmp_path / "r"))
    assert {r["doc_id"]: r["xml_length"] for r in spark.read.json(str(tmp_path / "r")).collect()} == {1: 8, 2: 0}
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_json(df, str(tmp_path / "j"), "append")
    assert files.read_review_log(spark, str(tmp_path / "j")).count() == 4
    folder = str(tmp_path)

    def store(name, content):
        with open(f"{folder}/{name}", "w") as f:
            f.write(content)

    assert sinks.export_files(df.where("xml is not null"), "file_name", "xml", store) == 1 and (tmp_path / "a.dita").read_text() == "<a>é</a>"
    (tmp_path / "rules.json").write_text('{"style_guide": {\n"max_steps": 15}}')
    assert files.read_rules(spark, str(tmp_path / "rules.json")).first()["style_guide"]["max_steps"] == 15


def test_dropped_files_are_analysed_once(spark, tmp_path):
    docs = _md(spark, SAMPLE, "## What is it\n\nIt is a thing.\n")
    docs.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def store(rows, batch):
        rows.select("doc_id", "chunk_no", "type").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for _ in range(2):
        filedrop.watch(spark, str(tmp_path / "in"), "doc_id int, markdown string", str(tmp_path / "ck"), store).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("doc_id", "chunk_no", "type").collect())) == sorted(map(tuple, analysis.analyse(docs).select("doc_id", "chunk_no", "type").collect()))


def test_forms_of_verbs():
    assert {"copies", "copied", "presses", "moved", "moving", "typing", "installing", "checks"} <= set(text.ACTION_FORMS)


def test_latest_rows_of_a_log(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, v string")
    assert sorted(map(tuple, stats.latest(log, ["k"], F.col("seq")).collect())) == [(1, 2, "b"), (2, 1, "c")]


def test_empty_inputs(spark):
    empty = _md(spark, "x").where("false")
    assert analysis.end_to_end(empty).count() == 0
    assert validate.toolkit_log(F.lit("")) is not None


def test_a_model_repairs_only_what_rules_cannot(spark):
    hard = "<task><title>Install it</title></task>"
    easy = '<task id="a b"><title>Install it</title><taskbody><steps><step><cmd>x</cmd></step></steps></taskbody></task>'
    df = spark.createDataFrame([(1, hard, "Task"), (2, hard.replace("it", "them"), "Task"), (3, easy, "Task")], "doc_id int, xml string, content_type string")
    checked = validate.quality_issues(xmlnodes.parse(df))
    seen = []

    def ask(rows):
        seen.append(sorted(r["doc_id"] for r in rows.collect()))
        return rows.withColumn("answer", F.when(F.col("doc_id") == 1, F.lit("```xml\n<task><title>New</title></task>\n```")).otherwise(F.lit("<no")))

    got = {r["doc_id"]: r["model_xml"] for r in repair.with_model(checked, ask).collect()}
    assert got == {1: "<task><title>New</title></task>", 2: None, 3: None} and seen == [[1, 2]]


def test_prompts_show_no_more_than_they_may(spark):
    df = features.extract(spark.createDataFrame([("T", "x" * 9000)], "title string, content string"))
    row = df.select(prompts.classification(F.col("title")).alias("a"), prompts.structuring(F.lit("Task"), F.col("title"), F.col("content")).alias("b"), prompts.repairing(F.col("content"), F.array(validate.issue("EmptyElement", "p"))).alias("c")).first()
    assert row["a"].count("x") < 1500 + 20 and "word_count: 1" in row["a"] and "steps" in row["b"] and "EmptyElement p" in row["c"] and len(row["c"]) < 5200


def test_collected_errors(spark):
    df = spark.range(1).select(F.concat(errors.from_texts(F.array(F.lit("old"))), F.array(errors.error("xml", "W1", F.lit("w"), True))).alias("errors"))
    r = errors.collected(df).first()
    assert (r["error_count"], r["warning_count"], r["has_errors"], r["has_warnings"]) == (1, 1, True, True) and r["errors"][0]["code"] == "LEGACY_ERROR"
    assert errors.collected(spark.range(1).select(F.lit(None).cast(errors.ERROR).alias("errors"))).first()["error_count"] == 0


def test_own_renderers(spark):
    df = structure.records(spark.createDataFrame([("Task", "t", "1. a"), ("Memo", "m", "b")], "type string, title string, content string"))
    rows = render.render(df, renderers={"Memo": F.concat(F.lit("<memo>"), F.col("content"), F.lit("</memo>"))}).collect()
    assert {r["type"]: r["xml"][:6] for r in rows} == {"Task": "<?xml ", "Memo": "<memo>"}


def test_work_of_a_document_grows_with_its_lines(spark):
    """Chunks, steps and tables of documents of 10,000 and of 40,000 lines: split once, so four times the lines are no sixteen times the work."""
    import time

    from doculith.operators import chunking, structure

    seconds = {}
    for n in (1000, 10_000, 40_000):  # the first compiles
        lines = [f"## Head {i}" if i % 20 == 0 else f"{i}. step" if i % 3 else f"| {i} | x |" for i in range(n)]
        docs = spark.createDataFrame([(1, "\n".join([*lines, "|---|---|", *lines]))], "doc_id bigint, markdown string").cache()
        assert docs.count() == 1
        began = time.time()
        chunks = chunking.chunk(docs, how="headings")
        assert chunks.agg(F.count("*"), F.max("chunk_no")).first() == (n // 10, n // 10)
        found = docs.select(F.size(structure.steps(F.col("markdown"))).alias("s"), F.size(structure.table(F.col("markdown"))["columns"]).alias("c")).first()
        assert found["s"] == 2 * sum(x.endswith("step") for x in lines)
        seconds[n] = time.time() - began
    assert seconds[40_000] < 10 * max(seconds[10_000], 0.5)


def test_records_of_a_model(spark):
    """Messages and fixes of answers, worked out by hand; an answer that is no object lacks everything."""
    body = {"Task": "缺少必需元素: taskbody", "Concept": "缺少必需元素: conbody", "Reference": "缺少必需元素: refbody"}
    bare = "Reference必须包含properties、table或sections中的至少一项"
    cases = [
        ("Task", '{"taskbody": 1, "steps": [{"cmd": "a"}]}', []),
        ("Task", '{"taskbody_id": "x", "steps": []}', ["steps数量不足: 需要至少1个，实际0个"]),
        ("Task", '{"steps": [{"cmd": "a"}, "b", {"info": "c"}]}', [body["Task"], "第2个step格式错误: 必须是字典", "第3个step缺少必需字段: cmd"]),
        ("Task", None, [body["Task"], "steps数量不足: 需要至少1个，实际0个"]),
        ("Task", "not json", [body["Task"], "steps数量不足: 需要至少1个，实际0个"]),
        ("Concept", '{"conbody": {}, "introduction": "i", "sections": [{"id": "a"}, {"id": "b"}, {"id": "a"}, {"content": "x"}]}', ["ID重复: a"]),
        ("Concept", '{"introduction": "", "sections": []}', [body["Concept"], "Concept必须包含introduction或sections"]),
        ("Reference", '{"reference_id": "r", "title": "t", "shortdesc": "s"}', [body["Reference"], bare]),
        ("Reference", '{"reference_id": "r", "title": "t", "note": "s"}', [body["Reference"]]),
        ("Reference", "{}", [body["Reference"], bare]),
        ("Reference", '{"refbody": 1, "table": [1]}', ["table必须是字典格式"]),
        ("Reference", '{"refbody": 1, "table": {"columns": ["a"]}}', ["table必须包含columns和rows字段"]),
        ("Reference", '{"refbody": 1, "table": {"columns": ["a"], "rows": [["1"]]}}', []),
        ("Memo", "{}", ["不支持的内容类型: Memo"]),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, type string, answer string")
    got = {r["i"]: r for r in modelrecords.fix(modelrecords.parse(df)).collect()}
    assert [got[i]["model_errors"] for i in range(len(cases))] == [c[2] for c in cases]
    assert [s["cmd"] for s in got[2]["model_steps"]] == ["a", "Perform action", "Perform action"]
    assert [s["cmd"] for s in got[1]["model_steps"]] == [None] and [s["cmd"] for s in got[3]["model_steps"]] == ["Complete the task"]
    assert got[6]["model_introduction"] == "This is a concept description." and got[7]["model_sections"][0]["content"] == "Reference information"
    assert got[12]["model_table"]["rows"] == [["1"]] and got[12]["model_sections"] == []


def test_files_of_results(spark, tmp_path):
    """Formats, the embedded topic, batches of successful topics, and names of what could not be stored."""
    import json

    docs = _md(spark, SAMPLE)
    scored = analysis.end_to_end(docs).withColumn("name_of", F.concat_ws("_", "doc_id", "chunk_no")).cache()
    n, ok = scored.count(), scored.where("qa_success").count()
    assert n > 1
    folder = str(tmp_path)

    def store(name, content):
        if name.endswith(".html"):
            raise OSError("full")
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(content)

    assert sinks.write_results(scored, "name_of", store, log=str(tmp_path / "log")) == 2 * n
    log = spark.read.json(str(tmp_path / "log")).collect()
    assert len(log) == 3 * n and {r["error"] for r in log if r["name"].endswith("_report.html")} == {"full"}
    for r in scored.select("name_of", "final_xml", "overall_status").collect():
        report = json.loads((tmp_path / f"{r['name_of']}_report.json").read_text("utf-8"))
        assert report["final_dita_xml"] == r["final_xml"] == (tmp_path / f"{r['name_of']}.dita").read_text("utf-8")
        assert report["overall_status"] == r["overall_status"] and report["document_id"] == r["name_of"]
    plain = quality.outputs(scored, "name_of", ("json",), embed=False).collect()
    assert len(plain) == n and all("final_dita_xml" not in json.loads(r["content"]) for r in plain)
    assert sinks.write_batch(scored, "name_of", store, ("dita",)) == ok
    issue = [("title_length", "warning", "title", "<long>"), ("step_count", "info", None, None), ("title_length", "warning", None, None)]
    fields = "struct<rule:string,severity:string,element:string,detail:string>"
    told = F.array(*[F.struct(*[F.lit(v).cast("string") for v in x]) for x in issue]).cast(f"array<{fields}>")
    one = xmlnodes.parse(spark.createDataFrame([("<a>x y\n<c>z</c></a>",)], "final_xml string"), "final_xml").crossJoin(scored.limit(1).drop("final_xml", "nodes", "parse_error"))
    one = one.withColumn("rule_issues", told)
    page = quality.html(one, "name_of").first()["html"]
    assert "<tr><td>title_length</td><td>warning</td><td>2</td></tr><tr><td>step_count</td><td>info</td><td>1</td></tr></table>" in page
    assert all(f"<b>{n}</b> {v}<" in page for n, v in (("xml_size", 19), ("element_count", 2), ("line_count", 1), ("word_count", 3)))
    assert "<table>" not in quality.html(one.withColumn("rule_issues", F.array().cast(f"array<{fields}>")), "name_of").first()["html"]
    assert quality.outputs(scored, "name_of", ()).count() == 0
    with pytest.raises(ValueError):
        quality.outputs(scored, "name_of", ("pdf",))


def test_style_and_options(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"style_guide": {"title_max_length": 7,\n "max_nesting_depth": 2}, "terminology": {"replacements": {"utilise": "use"}}}')
    s = rules.load_style(spark, str(tmp_path / "r.json"))
    assert (s.title_max, s.max_depth, s.max_steps, s.replacements) == (7, 2, 15, {"utilise": "use"})
    assert rules.load_style(spark) == rules.Style()
    assert "terminology_consistency" not in rules.Registry(rules.style({})).names() and "terminology_consistency" in rules.Registry().names()
    assert analysis.Options.of(spark) == analysis.Options()
    spark.conf.set("doculith.chunkSize", "500")
    spark.conf.set("doculith.formats", "json, dita")
    try:
        assert analysis.Options.of(spark) == analysis.Options(500, None, ("json", "dita"))
        spark.conf.set("doculith.formats", "pdf")
        with pytest.raises(ValueError):
            analysis.Options.of(spark)
    finally:
        spark.conf.unset("doculith.chunkSize")
        spark.conf.unset("doculith.formats")


def test_topics_of_a_model(spark):
    """Whole topics, worked out by hand: every optional element, ids that clash, and nothing where nothing is."""
    task = """{"short_description": "s & t", "prerequisites": ["p", "q"], "context": "c", "steps": [{"cmd": "a", "info": "i", "example": "e"}], "result": "r", "example": "x"}"""
    concept = """{"concept_id": "own", "title": "T", "introduction": "i", "definition": "d", "note": "n", "sections": [{"id": "own", "title": "h", "content": "c", "example": "e"}, {"id": "own", "content": "<"}, {"content": "z"}]}"""
    reference = """{"reference_id": "ref_it", "introduction": "i", "properties": [{"name": "n", "value": 1}], "table": {"columns": ["k"], "rows": [["v"]]}, "sections": [{"id": "ref_it", "content": "c"}]}"""
    df = spark.createDataFrame([("Task", "Do It", task), ("Concept", "Do It", concept), ("Reference", "Ref it", reference), ("Memo", "m", "{}"), ("Task", None, None)], "type string, title string, answer string")
    rows = modelrecords.render(modelrecords.fix(modelrecords.parse(df))).collect()
    got = {(r["type"], r["title"]): r for r in rows}
    t = got["Task", "Do It"]
    assert t["model_id"] == "do_it_1"
    assert t["model_xml"].split("\n", 2)[2] == """<task id="do_it_1">
  <title>Do It</title>

  <shortdesc>s &amp; t</shortdesc>

  <taskbody>
    <prereq>
      <ul>
        <li>p</li>
        <li>q</li>
      </ul>
    </prereq>

    <context>
      <p>c</p>
    </context>

    <steps>
      <step>
        <cmd>a</cmd>
        <info>i</info>
        <stepxmp>e</stepxmp>
      </step>
    </steps>

    <result>
      <p>r</p>
    </result>

    <example>
      <title>Example</title>
      <p>x</p>
    </example>
  </taskbody>
</task>"""
    c = got["Concept", "Do It"]
    assert c["model_id"] == "own" and [s["id"] for s in c["model_sections"]] == ["own_1", "own_2", None]
    assert "<title>T</title>" in c["model_xml"] and "<title>Definition</title>\n      <p>d</p>" in c["model_xml"] and '<note type="note">n</note>' in c["model_xml"]
    assert '    <section id="own_1">\n      <title>h</title>\n      <p>c</p>\n\n      <example>\n        <p>e</p>\n      </example>\n    </section>\n' in c["model_xml"]
    r = got["Reference", "Ref it"]
    assert r["model_id"] == "ref_it_1" and r["model_sections"][0]["id"] == "ref_it_2"
    assert "<proptype>n</proptype>\n        <propvalue>1</propvalue>\n        <propdesc></propdesc>" in r["model_xml"] and '<tgroup cols="1">' in r["model_xml"]
    assert got["Memo", "m"]["model_xml"] is None and "<cmd>Complete the task</cmd>" in got["Task", None]["model_xml"]
    topics = spark.createDataFrame([(x["model_xml"],) for x in rows if x["model_xml"]], "xml string")
    assert xmlnodes.parse(topics).where("nodes is null").count() == 0


def test_chunks_are_made_once_and_not_again_by_a_filter(spark):
    df = spark.createDataFrame([("a", "## T\nx"), ("b", "no heading"), ("c", "")], "doc_id string, markdown string")
    out = chunking.chunk(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "split(" in line]
    assert sorted(r["doc_id"] for r in out.collect()) == ["a", "b"]


def test_lexical_counts_a_text_as_it_counts_its_sentences(spark):
    wanted = {"It is\nNew. Install it?! Install it.. 'open is_ x": (2, 1, 0), "?. - Install New York.\nSo New\nYork is": (1, 1, 2), "...": (0, 0, 0), "open": (1, 0, 0), "open's it's been, are": (0, 1, 0)}
    rows = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", text.lexical(F.col("t")).alias("x")).collect()
    assert {r["t"]: (r["x"]["imperative_verbs"], r["x"]["is_statements"], r["x"]["named_entities"]) for r in rows} == wanted
