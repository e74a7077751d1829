"""Tasks made from line items, one per order and one per supplier, with one step a line and faults that follow from the data.

An order has a few steps, a supplier hundreds. Spark builds the XML and checks it. The SQL never sees XML: it works out
from the rows alone what the checks have to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.operators.render import DECLARATION

#: The children of a body by key % 5, and of a root by key % 7; other roots have title and taskbody.
BODIES = [["context", "steps", "result"], ["result", "steps"], ["steps", "context"], ["steps"], ["postreq", "context", "steps", "prereq"]]
ROOTS = {0: ["title", "shortdesc", "taskbody"], 1: ["shortdesc", "title", "taskbody"], 2: ["taskbody", "title"]}
PLAIN_ROOT = ["title", "taskbody"]
_BODY_ORDER = ["prereq", "context", "steps", "result", "example", "postreq"]
_ROOT_ORDER = ["title", "shortdesc", "prolog", "taskbody", "related-links"]


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, key, content_type, xml). A topic holds the lines of one order or of one supplier, in a fixed order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = F.col("l_partkey").cast("string")
    ident = F.when(F.col("l_tax") > 0.07, F.concat(part, F.lit(" x"))).otherwise(F.concat(F.lit("p"), part))
    attribute = F.when(F.col("l_linestatus") == "F", F.concat(F.lit(' id="'), ident, F.lit('"'))).otherwise(F.lit(""))
    bare = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 5)
    inner = F.when(bare, F.lit("<info>Take care</info>")).otherwise(F.concat(F.lit("<cmd>Ship part "), part, F.lit(" &amp; sign</cmd>")))
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.concat(F.lit("<step"), attribute, F.lit(">"), inner, F.lit("</step>")).alias("step"))
    owners = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in (("o", "l_orderkey"), ("s", "l_suppkey"))))
    rows = lines.select(F.explode(owners).alias("owner"), line.alias("line")).groupBy("owner.kind", "owner.key").agg(F.collect_list("line").alias("lines"))
    k = F.col("key")
    listed = F.array_join(F.transform(F.array_sort("lines"), lambda x: x["step"]), "")
    steps = F.when(k % 19 == 4, "").when(k % 23 == 6, "<steps></steps>").otherwise(F.concat(F.lit("<steps>"), listed, F.lit("</steps>")))
    filled = {"steps": steps, "context": F.lit("<context/>")}

    def element(tag: str) -> Column:
        return filled.get(tag, F.lit(f"<{tag}>Text</{tag}>"))

    def chosen(by: int, choices: dict[int, list[str]], other: list[str]) -> Column:
        whole = lambda tags: F.concat(*(element(t) for t in tags))
        out = None
        for i, tags in choices.items():
            out = (F if out is None else out).when(k % by == i, whole(tags))
        return out.otherwise(whole(other))

    order = F.when(k % 23 == 6, element("steps")).otherwise(chosen(5, dict(enumerate(BODIES)), BODIES[0]))
    filled["taskbody"] = F.when(k % 17 == 3, "").otherwise(F.concat(F.lit("<taskbody>"), order, F.lit("</taskbody>")))
    filled["title"] = F.when(k % 13 == 5, "").otherwise(F.lit("<title>Ship the parts</title>"))
    name = F.concat("kind", k.cast("string"))
    end = F.when(k % 29 == 7, "").otherwise(F.lit("</task>"))
    xml = F.concat(F.lit(DECLARATION + '<task id="'), name, F.lit('">'), chosen(7, ROOTS, PLAIN_ROOT), end)
    return rows.select(name.alias("topic"), "key", F.lit("Task").alias("content_type"), xml.alias("xml"))


def _list(tags: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in tags) + "]"


_BODY_CASES = " ".join(f"WHEN {i} THEN {_list(t)}" for i, t in enumerate(BODIES))
_ROOT_CASES = " ".join(f"WHEN {i} THEN {_list(t)}" for i, t in ROOTS.items())

#: topic, what it lacks, the ids and steps in document order, and the misplaced children.
FACTS = f"""owned AS (SELECT 'o' || l_orderkey AS topic, l_orderkey AS key, * FROM lineitem UNION ALL SELECT 's' || l_suppkey, l_suppkey, * FROM lineitem),
steps AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM owned),
topics AS (SELECT DISTINCT topic, key, key % 29 = 7 AS broken, key % 13 = 5 AS no_title, key % 17 = 3 AS no_body, key % 17 <> 3 AND key % 19 = 4 AS no_steps, key % 17 <> 3 AND key % 19 <> 4 AND key % 23 = 6 AS no_step FROM owned),
whole AS (SELECT * FROM topics WHERE NOT broken),
listed AS (SELECT s.* FROM steps s JOIN whole USING (topic) WHERE NOT (no_body OR no_steps OR no_step)),
bare AS (SELECT topic, i FROM listed WHERE l_returnflag = 'R' AND l_linenumber > 5),
ids AS (SELECT topic, i, id, row_number() OVER (PARTITION BY topic, id ORDER BY i) AS nth, count(*) OVER (PARTITION BY topic, id) AS n
  FROM (SELECT topic, i, CASE WHEN l_tax > 0.07 THEN l_partkey || ' x' ELSE 'p' || l_partkey END AS id FROM listed WHERE l_linestatus = 'F')),
bad AS (SELECT * FROM ids WHERE id LIKE '% x'),
kids AS (SELECT topic, 2 AS part, {_list(_BODY_ORDER)} AS wanted, list_filter(CASE WHEN key % 23 = 6 THEN ['steps'] ELSE CASE key % 5 {_BODY_CASES} END END, lambda t: NOT (t = 'steps' AND no_steps)) AS have FROM whole WHERE NOT no_body
  UNION ALL SELECT topic, 4, {_list(_ROOT_ORDER)}, list_filter(CASE key % 7 {_ROOT_CASES} ELSE {_list(PLAIN_ROOT)} END, lambda t: NOT (t = 'title' AND no_title OR t = 'taskbody' AND no_body)) FROM whole),
placed AS (SELECT topic, part, rank, wanted[rank] AS tag, list_position(have, wanted[rank]) AS pos FROM (SELECT *, unnest(range(1, len(wanted) + 1)) AS rank FROM kids)),
misplaced AS (SELECT topic, part, rank, tag FROM (SELECT *, lag(pos) OVER (PARTITION BY topic, part ORDER BY rank) AS before FROM placed WHERE pos > 0) WHERE pos < before)"""


def _numbered(parts: str) -> str:
    return f"WITH {FACTS}, found(topic, part, i, type, element, id) AS ({parts}) SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY part, i) - 1)::INTEGER AS issue_no, type, element, id FROM found"


_LACKS = """SELECT topic, 0, 0, 'XMLSyntaxError', NULL, NULL FROM topics WHERE broken
UNION ALL SELECT topic, {title}, 0, 'MissingRequiredElement', 'title', NULL FROM whole WHERE no_title
UNION ALL SELECT topic, 3, 0, 'MissingRequiredElement', 'taskbody', NULL FROM whole WHERE no_body
UNION ALL SELECT topic, 3, 0, 'MissingRequiredElement', 'steps', NULL FROM whole WHERE no_steps
UNION ALL SELECT topic, 3, 0, '{empty}', 'steps', NULL FROM whole WHERE no_step
UNION ALL SELECT topic, 3, i, 'MissingRequiredElement', 'step[' || i || ']/cmd', NULL FROM bare"""

L4 = _numbered(
    _LACKS.format(title=1, empty="EmptyElement")
    + """ UNION ALL SELECT topic, part, rank, 'ElementOrderError', tag, NULL FROM misplaced
UNION ALL SELECT topic, 5, i, 'DuplicateID', NULL, id FROM ids WHERE nth > 1 UNION ALL SELECT topic, 6, i, 'InvalidIDFormat', NULL, id FROM bad"""
)
L3 = _numbered(
    _LACKS.format(title=2.5, empty="EmptySteps") + " UNION ALL SELECT topic, 1, i, 'DuplicateID', NULL, id FROM ids WHERE nth = 1 AND n > 1 UNION ALL SELECT topic, 2, i, 'InvalidIDFormat', NULL, id FROM bad"
)
#: Bad ids that repeat get a suffix first and are mended a round later; an empty list of steps goes, and is then missing.
LOOP = f"""WITH {FACTS},
hard AS (SELECT topic, no_title::INT + no_body::INT + no_steps::INT + (SELECT count(*) FROM bare b WHERE b.topic = w.topic) + (SELECT count(*) FROM misplaced m WHERE m.topic = w.topic) AS hard, no_step::INT AS empty FROM whole w),
soft AS (SELECT topic, hard, empty, (SELECT count(*) FROM ids x WHERE x.topic = h.topic AND nth > 1) + (SELECT count(*) FROM bad x WHERE x.topic = h.topic) + empty AS first, (SELECT count(*) FROM bad x WHERE x.topic = h.topic AND nth > 1) AS second FROM hard h)
SELECT topic, CASE WHEN first = 0 THEN 1 WHEN second = 0 THEN 2 ELSE 3 END::INTEGER AS iterations, hard + empty = 0 AS success, (first + second)::INTEGER AS repairs, (hard + empty)::INTEGER AS errors FROM soft
UNION ALL SELECT topic, 1, false, 0, 1 FROM topics WHERE broken"""
#: Elements with neither text nor children: an empty context, an empty list of steps, a body or a root without children.
L4_WARNINGS = f"""WITH {FACTS}
SELECT topic, 'context' AS element, count(*) AS n FROM kids WHERE part = 2 AND list_contains(have, 'context') GROUP BY topic
UNION ALL SELECT topic, 'steps', 1 FROM whole WHERE no_step UNION ALL SELECT topic, 'taskbody', 1 FROM kids WHERE part = 2 AND len(have) = 0
UNION ALL SELECT topic, 'task', 1 FROM kids WHERE part = 4 AND len(have) = 0"""
#: The same errors with their messages, but for syntax errors; all of a topic stands in its second line.
L4_MESSAGES = f"""SELECT topic, issue_no, CASE WHEN type = 'MissingRequiredElement' AND element NOT LIKE 'step[%' THEN NULL ELSE 2 END AS line, CASE WHEN type = 'MissingRequiredElement' AND element LIKE 'step[%' THEN '第 ' || regexp_extract(element, '[0-9]+') || ' 个 <step> 缺少必需的 <cmd> 元素'
  WHEN type = 'MissingRequiredElement' AND element = 'steps' THEN '<taskbody> 必须包含 <steps> 元素' WHEN type = 'MissingRequiredElement' THEN '<task> 必须包含 <' || element || '> 元素' WHEN type = 'EmptyElement' THEN '<steps> 必须至少包含一个 <step>'
  WHEN type = 'DuplicateID' THEN 'ID "' || id || '" 重复使用' WHEN type = 'InvalidIDFormat' THEN 'ID "' || id || '" 格式无效（必须以字母开头，只能包含字母、数字、-_. ）' ELSE '元素 <' || element || '> 的顺序不正确' END AS message,
  CASE WHEN type = 'InvalidIDFormat' THEN 'ID必须以字母开头，只能包含字母、数字、下划线、连字符、点号' END AS suggestion FROM ({L4}) WHERE type <> 'XMLSyntaxError'"""
