"""A Markdown corpus made from the star tables by SQL that both Spark and DuckDB run, so that the two work on the same texts.

One document per brand with tables of parts, one per order with steps from its line items, one per nation with
statements. `{join}` stands for an engine's ordered string aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doculith.functions.text import ACTION_VERBS

_VERBS = ",".join(ACTION_VERBS)


def _join(engine: str, text: str, order: str) -> str:
    if engine == "duckdb":
        return f"string_agg({text}, '' ORDER BY {order})"
    return f"array_join(sort_array(collect_list(struct({order} AS k, {text} AS t))).t, '')"


def markdown_sql(engine: str) -> str:
    """SELECT doc_id, markdown."""
    nl = "chr(10)"
    rows = _join(engine, f"'| ' || p_name || ' | ' || cast(p_size AS varchar(20)) || ' | ' || cast(p_partkey AS varchar(20)) || ' |' || {nl}", "p_partkey")
    sections = _join(engine, "section", "p_type")
    name = f"split_part('{_VERBS}', ',', cast(l_linenumber * 5 % 34 AS int) + 1)"
    verb = f"upper(substr({name}, 1, 1)) || substr({name}, 2)"
    line = "CASE CAST(l_orderkey % 4 AS int) WHEN 0 THEN cast({n} AS varchar(20)) || '. ' WHEN 1 THEN '- ' WHEN 2 THEN '* ' ELSE '+ ' END || {verb} || ' part ' || cast({part} AS varchar(20)) || ' & check it < twice.' || chr(10)"
    order = "l_linenumber * 100000000 + l_partkey"
    if engine == "duckdb":
        steps = _join(engine, line.format(n="l_linenumber", verb=verb, part="l_partkey"), order)
    else:
        # Numbers are shuffled and sorted, and become lines afterwards; verbs come from a constant array, so that no line splits the list.
        listed = "array(" + ", ".join(f"'{v.capitalize()}'" for v in ACTION_VERBS) + ")"
        made = line.format(n="x.n", verb=f"coalesce(get({listed}, cast(x.n * 5 % 34 AS int)), '')", part="x.p")
        steps = f"array_join(transform(sort_array(collect_list(struct({order} AS k, l_linenumber AS n, l_partkey AS p))), x -> {made}), '')"
    return f"""
SELECT 'part-' || p_brand AS doc_id, '# ' || p_brand || {nl} || 'Parts of ' || p_brand || '.' || {nl} || {nl} || {sections} AS markdown FROM (
  SELECT p_brand, p_type, '## ' || p_type || ' reference' || {nl} || CASE WHEN min(p_partkey) % 5 = 0 THEN '' ELSE
    {nl} || '| name | size | key |' || {nl} || CASE WHEN substr(p_brand, length(p_brand), 1) IN ('0', '3', '6', '9') THEN '| --- | --- | --- |' ELSE '|---|---|---|' END || {nl} || {rows} END || {nl} AS section
  FROM part GROUP BY p_brand, p_type) AS typed GROUP BY p_brand
UNION ALL
SELECT 'order-' || cast(l_orderkey AS varchar(20)) AS doc_id, 'Orders' || {nl} || {nl} || '## How to install order ' || cast(l_orderkey AS varchar(20)) || {nl} || {nl} || 'Before you begin.' || {nl} || {nl} || {steps}
  || CASE WHEN l_orderkey % 7 = 0 THEN {nl} || '#### Note' || {nl} || {nl} || '```' || {nl} || 'run ' || cast(l_orderkey AS varchar(20)) || {nl} || '```' || {nl} ELSE '' END
  || CASE WHEN l_orderkey % 5 = 0 THEN {nl} || '###   ' || {nl} || {nl} || 'Use `check` at the end of It Works Inc.' || {nl} ELSE '' END AS markdown
FROM lineitem GROUP BY l_orderkey
UNION ALL
SELECT 'nation-' || cast(n_nationkey AS varchar(20)) AS doc_id, '## What is ' || n_name || {nl} || {nl} || n_name || ' is a nation.' || {nl} || {nl} || repeat('It is large. ', cast(n_nationkey % 6 AS int)) || 'We like "' || n_name || '".' || {nl}
  || CASE WHEN n_nationkey % 3 = 0 THEN {nl} || '![map](0_image_' || cast(n_nationkey AS varchar(20)) || '.png) and [more](http://example.com) in order to utilize it.' || {nl} ELSE '' END
  || {nl} || '### Overview of ' || n_name || {nl} || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE {nl} || 'Why? Will it be asked?' || {nl} || {nl} || 'It means much.' || {nl} END AS markdown
FROM nation"""


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "part", "lineitem", "nation")
    return spark.sql(markdown_sql("spark"))
