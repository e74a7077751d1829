"""Checks and repairs of large topics: linear in the nodes, and no parse that is not needed."""

import re
import time

import pytest
from pyspark.sql import functions as F

from doculith.operators import repair, validate, xmlnodes


def _task(steps, fault=lambda i: ""):
    listed = "".join(f"<step{fault(i)}><cmd>Do {i}</cmd></step>" if i % 1000 else f"<step{fault(i)}><info>No command</info></step>" for i in range(1, steps + 1))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<task id="t"><title>Many steps</title><taskbody><steps>{listed}</steps></taskbody></task>'


def _seconds(spark, steps):
    df = spark.createDataFrame([(_task(steps, lambda i: f' id="s{i % 1500}"'), "Task")], "xml string, content_type string").coalesce(1).persist()
    parsed = xmlnodes.parse(df)
    checked = validate.quality_issues(parsed).select("l4_errors", "l4_warnings")
    best = 1e9
    for _ in range(5):
        began = time.time()
        row = checked.first()
        best = min(best, time.time() - began)
    return best, row, validate.converter_issues(parsed).select("l3_errors").first()


def test_twenty_thousand_steps_in_proportion(spark):
    _seconds(spark, 10)
    small, *_ = _seconds(spark, 2_500)
    large, row, other = _seconds(spark, 20_000)
    kinds = [(e["type"], e["element"], e["id"]) for e in row["l4_errors"]]
    assert kinds[:20] == [("MissingRequiredElement", f"step[{i}]/cmd", None) for i in range(1000, 20_001, 1000)]
    assert kinds[20:] == [("DuplicateID", None, f"s{i % 1500}") for i in range(1501, 20_001)]
    assert sum(e["type"] == "DuplicateID" for e in other["l3_errors"]) == 1500
    assert large < 2
    assert large < 16 * max(small, 0.1)


def test_repairs_of_a_large_topic_are_linear():
    xml = _task(20_000, lambda i: f' id="{i % 9000} x"')
    began = time.time()
    again = [f"{i % 9000} x" for i in range(9001, 20_001)]
    text, fixes = repair.tree_repairs(xml, ["steps"], again)
    bad = re.findall(r'id="([0-9]+ x)"', text)
    text = repair.ids_replaced(text, {b: "id_" + b.replace(" ", "_") for b in bad})
    assert time.time() - began < 5
    assert fixes == 11_001 and text.count(" x_2") == 9000 and text.count(" x_3") == 2000 and text.count('"id_') == 9000


@pytest.mark.parametrize("seed", range(5))
def test_place_fields_agree_with_the_tree(seed):
    import random
    from xml.etree import ElementTree

    rng = random.Random(seed)

    def make(depth):
        ident = f' id="i{rng.randrange(6)}"' if rng.random() < 0.5 else ""
        inside = "".join(rng.choice(["", "x &lt; é", "<!-- c -->", "<![CDATA[<!ENTITY a>]]>"]) + make(depth + 1) for _ in range(rng.randrange(4))) if depth < 5 else "t"
        tag = rng.choice("abc")
        return f"<{tag}{ident}>{inside}</{tag}>" + rng.choice(["", "tail", "\n "])

    xml = f'  <?xml version="1.0"?>\n<!DOCTYPE r PUBLIC "x" "y.dtd"><r xmlns:n="urn:u"><n:q/>{"".join(make(1) for _ in range(6))}</r>'
    nodes, error = xmlnodes.nodes_of(xml)
    assert error is None
    root = ElementTree.fromstring(xml.split("?>", 1)[1])
    tree = list(root.iter())
    parents = {id(c): p for p in tree for c in p}
    assert [n["tag"] for n in nodes] == [e.tag for e in tree] and [n["text"] for n in nodes] == [e.text for e in tree] and [n["tail"] for n in nodes][1:] == [e.tail for e in tree][1:]
    place = {id(e): i for i, e in enumerate(tree)}
    ids = [e.get("id") for e in tree]
    for n, e in zip(nodes, tree, strict=True):
        i = n["node_id"]
        assert n["last"] == i + len(list(e.iter())) - 1 and n["n_children"] == len(e) and n["id_attr"] == ids[i]
        assert n["id_nth"] == (ids[: i + 1].count(ids[i]) if ids[i] else None) and n["id_count"] == (ids.count(ids[i]) if ids[i] else None)
        if i:
            above = parents[id(e)]
            assert n["parent_id"] == place[id(above)] and above[n["pos"]] is e and [c for c in above if c.tag == e.tag][n["nth"] - 1] is e


def test_entities_are_refused_where_they_are_declared():
    assert xmlnodes.nodes_of('<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')[1] == "entity declarations are refused"
    assert xmlnodes.nodes_of("<a><![CDATA[<!ENTITY b>]]></a>")[0][0]["text"] == "<!ENTITY b>"
    assert "undefined entity &b;" in xmlnodes.nodes_of('<!DOCTYPE a SYSTEM "a.dtd"><a>&b;</a>')[1]


def test_the_loop_parses_a_valid_topic_once(spark, monkeypatch):
    good, bad = _task(3), _task(3, lambda i: ' id="same"')
    twice = _task(3, lambda i: ' id="1 x"')
    df = spark.createDataFrame([(1, good, "Task"), (2, bad, "Task"), (3, "<broken", "Task"), (4, twice, "Task"), (5, None, "Task")], "k int, xml string, content_type string")
    out = repair.loop(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3 and "MapInArrow" not in plan
    # What goes to Python after the first parse: only the text of a topic that still has errors, and its edits.
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert sum("_text" in line for line in sent) == 2 and all("nodes" not in re.sub(r"run\(.*?\)#\d+", "", line).split("],")[0] for line in sent)
    rows = {r["k"]: r for r in out.collect()}
    assert [(rows[k]["iterations"], rows[k]["repairs_applied"], rows[k]["loop_success"]) for k in (1, 2, 3, 4, 5)] == [(1, 0, True), (2, 2, True), (1, 0, False), (3, 7, True), (1, 0, False)]
    assert rows[1]["final_xml"] == good and rows[4]["final_xml"].count("id_1_x") == 3
    texts = out.select(F.when(F.col("iterations") > 1, F.col("final_xml")).alias("xml"), "nodes").where("xml is not null")
    for r in texts.collect():
        assert [n["id_attr"] for n in r["nodes"]] == [n["id_attr"] for n in xmlnodes.nodes_of(r["xml"])[0]]


def test_the_nodes_that_checks_look_at_give_the_issues_of_all(spark):
    import random

    rng = random.Random(7)

    def step(i):
        ident = rng.choice(["", f' id="p{rng.randrange(40)}"', f' id="{i} x"', ' id="ok"'])
        return f"<step{ident}>" + rng.choice(["<cmd>Do</cmd>", "<cmd/>", "<info>x</info>", "", "<foo><cmd>a</cmd></foo>", "<cmd>a</cmd><cmd>b</cmd>", "<note>n</note><cmd>c</cmd>", "  "]) + "</step>" + rng.choice(["", " ", "t"])

    def body(i):
        parts = ["<context/>", "<steps>" + "".join(map(step, range(rng.randrange(60)))) + "</steps>", "<steps/>", "<result>r</result>", "<prereq> </prereq>"]
        return "".join(rng.sample(parts, rng.randrange(len(parts) + 1)))

    def topic(i):
        kind = rng.choice([("task", "taskbody"), ("concept", "conbody"), ("reference", "refbody"), ("other", "x")])
        parts = rng.sample(["<title>T</title>", "<shortdesc/>", f"<{kind[1]}>{body(i)}</{kind[1]}>", "<prolog>p</prolog>"], rng.randrange(5))
        return f'<{kind[0]} id="t">\n{"".join(parts)}' + ("" if i % 17 == 3 else f"</{kind[0]}>")

    rows = [(i, topic(i), rng.choice(["Task", "Concept", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, xml string, content_type string").coalesce(2)

    def found(whole):
        parsed = xmlnodes.parse(df, whole=whole)
        checked = validate.converter_issues(validate.quality_issues(parsed))
        for c, level in (("l4_errors", "l4"), ("l4_warnings", "l4"), ("l3_errors", "l3"), ("l3_warnings", "l3")):
            checked = validate.described(checked, c, level)
        looped = repair.loop(df, whole=whole).select("k", "final_xml", "iterations", "repairs_applied", F.col("l4_errors").alias("left"))
        return checked.drop("nodes").join(looped, "k").orderBy("k").collect(), checked.agg(F.sum(F.size("nodes"))).first()[0]

    (all_issues, all_nodes), (issues, nodes) = found(True), found(False)
    assert issues == all_issues and nodes < 0.8 * all_nodes


def test_texts_leave_python_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(xmlnodes, "BATCH", 4)
    monkeypatch.setattr(xmlnodes, "BATCH_CHARS", 10)
    cut = lambda *texts: list(xmlnodes.pieces(pa.array(texts, pa.string())))
    assert cut() == [] and cut(None) == [(0, 1)] and cut("x" * 99, "y") == [(0, 1), (1, 1)]
    assert cut("aaaa", "bbbbbb", "c", None, "d", "e", "f") == [(0, 2), (2, 4), (6, 1)]
