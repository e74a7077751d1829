"""What the queries over the Markdown corpus must not do again for each line, sentence or section."""

from pyspark.sql import functions as F

from doculith.functions import text
from doculith.operators import chunking, classify, features, render, structure
from doculith.plans import corpus



def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_grouped_as_numbers(spark, sf):
    plan = corpus.markdown(spark, sf)._jdf.queryExecution().executedPlan().toString()
    grouped = [x for x in plan.splitlines() if "partial_collect_list" in x and "l_orderkey" in x]
    assert grouped and not any("check it" in x for x in grouped)


def test_white_space_of_a_topic(spark):
    wanted = {"a \t\n b": "a\n b", "\n \n\t\n  \n x": "\n\n x", "a\n\nb  ": "a\n\nb", "a \r\nb": "a\nb", "a  b\u00a0\n": "a  b\u00a0\n"}
    rows = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", render.tidy(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == wanted


def test_a_type_asks_for_no_sentences(spark):
    df = spark.createDataFrame([("a", "## T\nx")], "doc_id string, markdown string")
    chunks = features.extract(chunking.chunk(df))
    sentences = r"\p{L}[^.!?"
    assert sentences in _plan(chunks) and sentences not in _plan(classify.hybrid(chunks).select("doc_id", "type"))
    odd = {"'open it": (1, 0, False), "it means much": (0, 0, True), "check. it's, is": (1, 1, False), None: (None, None, None)}
    rows = features.extract(spark.createDataFrame([(t,) for t in odd], "content string"), only="lexical").collect()
    assert {r["content"]: (r["imperative_verbs"], r["is_statements"], r["has_definition"]) for r in rows} == odd


def test_lines_of_steps_are_matched_once(spark):
    df = spark.createDataFrame([("1.   \n2. b \n- c",), ("* a\n-\n -b",), ("x\n1.",)], "t string").select(structure.steps(F.col("t")).alias("s"))
    assert "RLIKE" not in _plan(df) and [r["s"] for r in df.collect()] == [["", "b"], ["a", "b"], []]


def test_sections_share_the_form_of_their_title(spark):
    df = spark.createDataFrame([("Section 2", ["a", "b"]), ("x", ["a"])], "t string, p array<string>").select(structure.section_ids(F.col("t"), F.col("p")).alias("s"))
    inside = _plan(df)
    assert inside.count("[^a-z0-9") <= text.slug(F.lit("x"))._jc.toString().count("[^a-z0-9")
    assert [[s["id"] for s in r["s"]] for r in df.collect()] == [["section_2_3", "section_3"], ["section_2"]]
