"""All queries of the engine by name, and their oracles in SQL. Texts come from the star tables, topics from suppliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.functions import messages, text
from doculith.operators import chunking, classify, features, glossary, linguistics, modelrecords, quality, render, repair, reviewlog, rules, stats, structure, validate, xmlnodes
from doculith.plans import analysis, corpus, linetopics, oracle
from doculith.plans.oracle import escape, fused, slug, upto
from doculith.sources import files, recognition

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(corpus.markdown(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract(_chunks(spark, sf_dir))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.hybrid(_features(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.records(_hybrid(spark, sf_dir))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.convert(_hybrid(spark, sf_dir))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir, "supplier")
    return spark.sql(oracle.topics_sql())


def _joined(c: Column, by: str = "|") -> Column:
    return F.array_join(c, by)


# Sources -----------------------------------------------------------------------------------------------------------

_NAMES = "CASE cast(p_partkey % 9 AS int) WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' WHEN 3 THEN '.Png' WHEN 4 THEN '.jpeg' WHEN 5 THEN '.tar.gz' WHEN 6 THEN '' WHEN 7 THEN '.bmp' ELSE '.tiff' END"


@query(
    f"""
WITH named AS (SELECT p_partkey, '/in/' || replace(p_name, ' ', '_') || {_NAMES} AS path FROM part),
ext AS (SELECT *, lower(regexp_extract(path, '[^./](\\.[^./]+)$', 1)) AS ext FROM named)
SELECT p_partkey, path, ext, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.docx', '.doc') THEN 'word' WHEN ext IN ('.png', '.jpg', '.jpeg', '.tiff', '.bmp') THEN 'ocr' END AS processor,
  CASE WHEN ext IN ('.pdf', '.docx', '.doc', '.png', '.jpg', '.jpeg', '.tiff', '.bmp') THEN NULL ELSE 'Unsupported file format: ' || ext END AS error FROM ext"""
)
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "part").select("p_partkey", F.expr(f"'/in/' || replace(p_name, ' ', '_') || {_NAMES}").alias("path"))
    return files.route(named).select("p_partkey", "path", "ext", "processor", "error")


@query("SELECT * FROM (VALUES ('.pdf', 'pdf'), ('.docx', 'word'), ('.doc', 'word'), ('.png', 'ocr'), ('.jpg', 'ocr'), ('.jpeg', 'ocr'), ('.tiff', 'ocr'), ('.bmp', 'ocr')) AS t(ext, processor)")
def supported_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(files.PROCESSORS.items()), "ext string, processor string")


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    return turns.groupBy("conv_id").agg(F.array_join(parts, "\n---\n").alias("markdown"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS page, text, regexp_matches(text, '\\S') AS has_text FROM conversations")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.pages(_talks(spark, sf_dir), "markdown", "conv_id")


@query("SELECT conv_id, count(*) AS pages, avg(length(text)::DOUBLE) AS avg_chars, avg(length(text)::DOUBLE) < 100 AS needs_ocr FROM conversations GROUP BY conv_id")
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.needs_ocr(page_split(spark, sf_dir), "conv_id")


_METHODS = "SELECT doc_id, 'marker' AS method, 0 AS method_rank, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 100) ELSE text END AS text FROM documents UNION ALL SELECT doc_id, 'ocr' AS method, 1 AS method_rank, CASE WHEN doc_id % 5 = 0 THEN text ELSE substr(text, 1, 90) END AS text FROM documents"


@query(f"SELECT doc_id, method, length(text)::INTEGER AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, method_rank) AS r FROM ({_METHODS})) WHERE r = 1")
def pick_best_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir, "documents")
    return files.best_extraction(spark.sql(_METHODS), "doc_id").select("doc_id", "method", F.length("text").alias("chars"))


_STYLES = "CASE cast(p_partkey % 6 AS int) WHEN 0 THEN 'Heading 2' WHEN 1 THEN 'List Bullet' WHEN 2 THEN 'List Number' WHEN 3 THEN 'Normal' WHEN 4 THEN 'Quote' ELSE 'Heading 3' END"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda t, bold, italic, font: F.struct(t.alias("text"), bold.alias("bold"), italic.alias("italic"), font.alias("font"))
    c = F.col
    first = run(c("p_name"), c("p_size") % 2 == 0, c("p_size") % 3 == 0, F.when(c("p_size") % 5 == 0, "Consolas"))
    second = run(F.concat(F.lit(" "), c("p_type")), F.lit(False), F.lit(True), F.when(c("p_size") % 7 == 0, "Courier"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.expr(_STYLES).alias("style"), F.array(first, second).alias("runs"))


_RUNS_SQL = """runs AS (SELECT p_partkey, p_size, p_name, p_type, CASE cast(p_partkey % 6 AS int) WHEN 0 THEN 'Heading 2' WHEN 1 THEN 'List Bullet' WHEN 2 THEN 'List Number' WHEN 3 THEN 'Normal' WHEN 4 THEN 'Quote' ELSE 'Heading 3' END AS style,
  CASE WHEN p_size % 2 = 0 THEN '**' || p_name || '**' ELSE p_name END AS b1 FROM part),
italic AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN '*' || b1 || '*' ELSE b1 END AS i1 FROM runs),
inline AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN '`' || i1 || '`' ELSE i1 END || CASE WHEN p_size % 7 = 0 THEN '`* ' || p_type || '*`' ELSE '* ' || p_type || '*' END AS line FROM italic)"""


@query(f"WITH {_RUNS_SQL} SELECT p_partkey, line FROM inline")
def word_inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).select("p_partkey", files.inline(F.col("runs")).alias("line"))


@query(
    f"""WITH {_RUNS_SQL} SELECT p_partkey, CASE WHEN style = 'Heading 2' THEN '## ' || p_name || ' ' || p_type WHEN style = 'Heading 3' THEN '### ' || p_name || ' ' || p_type WHEN style = 'List Bullet' THEN '- ' || p_name || ' ' || p_type
  WHEN style = 'List Number' THEN '1. ' || p_name || ' ' || p_type WHEN p_size % 5 = 0 THEN '```' || chr(10) || p_name || ' ' || p_type || chr(10) || '```' ELSE line END AS markdown FROM inline"""
)
def word_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).select("p_partkey", files.paragraph(F.col("style"), F.col("runs")).alias("markdown"))


@query(
    """SELECT p_brand, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS markdown FROM part GROUP BY p_brand"""
)
def word_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t")), F.col("p_size").cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("cells")))), lambda r: r["cells"])
    grouped = _table(spark, sf_dir, "part").groupBy("p_brand").agg(rows.alias("rows"))
    return grouped.select("p_brand", files.table_markdown(F.concat(F.array(F.array(F.lit("name"), F.lit("size"))), F.col("rows"))).alias("markdown"))


# Chunks --------------------------------------------------------------------------------------------------------------

_BY_SIZE = r"""
lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
fold AS (
  SELECT doc_id, ls, 1 AS i, ls[1] || chr(10) AS cur, NULL::VARCHAR AS done FROM lines
  UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN length(cur) + length(ls[i + 1]) > 500 THEN ls[i + 1] || chr(10) ELSE cur || ls[i + 1] || chr(10) END, CASE WHEN length(cur) + length(ls[i + 1]) > 500 AND regexp_matches(cur, '\S') THEN cur END
  FROM fold WHERE i < len(ls)),
made AS (SELECT doc_id, i, done AS content FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, 1000000000, cur FROM fold WHERE i = len(ls) AND regexp_matches(cur, '\S')),
sized AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, content FROM made)"""


@query(f"WITH RECURSIVE {_BY_SIZE} SELECT doc_id, no::INTEGER AS chunk_no, 'Section ' || no AS title, content FROM sized")
def chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"))
    return chunking.chunk(docs, how="size").select("doc_id", "chunk_no", "title", "content")


@query(upto("chunks", "SELECT doc_id, chunk_no, id, title, level, content FROM chunks"))
def chunk_by_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(corpus.markdown(spark, sf_dir), how="headings")


@query(f"WITH RECURSIVE {_BY_SIZE} SELECT 'auto' AS how, count(*) AS chunks, sum(length(content))::BIGINT AS chars, max(no) AS most FROM sized")
def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"))
    return chunking.chunk(docs).agg(F.lit("auto").alias("how"), F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.max("chunk_no").cast("long").alias("most"))


@query(f"WITH RECURSIVE {_BY_SIZE} SELECT doc_id, no::INTEGER AS chunk_no, max(no) OVER (PARTITION BY doc_id) > 10 AS has_more FROM sized QUALIFY no <= 10")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"))
    return chunking.preview(docs).select("doc_id", "chunk_no", "has_more")


_PAGE_IMAGES = "SELECT page_id // 12 AS doc, (page_id % 12 + 1)::INTEGER AS page, coalesce(html, '') AS html FROM pages"


def _stub(images: list[bytes]) -> list[str]:
    """Stands in for a recogniser: reads the text of a page, and fails on pages of some lengths."""
    if any(len(i) % 7 == 0 for i in images):
        raise ValueError("unreadable")
    return [i.decode() for i in images]


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id div 12 AS doc", "cast(page_id % 12 + 1 AS int) AS page", "cast(coalesce(html, '') AS binary) AS image")
    return recognition.recognise(pages, _stub, "doc")


@query(f"SELECT doc, page, CASE WHEN strlen(html) % 7 = 0 THEN '' ELSE html END AS text, 'ocr' AS method, CASE WHEN strlen(html) % 7 = 0 THEN 'ValueError: unreadable' END AS error FROM ({_PAGE_IMAGES})")
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recognised(spark, sf_dir)


@query(
    f"SELECT doc, string_agg(CASE WHEN strlen(html) % 7 = 0 THEN '' ELSE html END, chr(10) || '---' || chr(10) ORDER BY page) AS text, count(*)::INTEGER AS pages, count(*) FILTER (strlen(html) % 7 = 0)::INTEGER AS failed_pages FROM ({_PAGE_IMAGES}) GROUP BY doc"
)
def recognised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.documents(_recognised(spark, sf_dir), "doc")


# Features ------------------------------------------------------------------------------------------------------------


@query(upto("features", f"SELECT doc_id, chunk_no, {', '.join(oracle.STRUCTURAL)} FROM features"))
def structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract(_chunks(spark, sf_dir), only="structural").select("doc_id", "chunk_no", *oracle.STRUCTURAL)


@query(upto("features", f"SELECT doc_id, chunk_no, {', '.join(oracle.LEXICAL)} FROM features"))
def lexical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract(_chunks(spark, sf_dir), only="lexical").select("doc_id", "chunk_no", *oracle.LEXICAL)


@query()
def linguistic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linguistics.extract(_chunks(spark, sf_dir)).select("doc_id", "chunk_no", "verb_count_tagged", "noun_count_tagged", "adj_count", F.array_join("entity_types", ",").alias("entity_types"), "dependency_patterns.*")
    return rows


@query(
    r"""SELECT n_nationkey, 'See ![a](../images/0_image_' || n_nationkey || '.png), ![b](../images/0_image_' || n_nationkey || '.png), <img src="../images/0_image_' || n_nationkey || '.png"> and ![c](other_' || n_nationkey || '.png)' AS markdown FROM nation"""
)
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    name = F.concat(F.lit("0_image_"), k)
    md = F.concat(F.lit("See ![a]("), name, F.lit(".png), ![b]("), name, F.lit('), <img src="'), name, F.lit('.png" width="3"> and ![c](other_'), k, F.lit(".png)"))
    mapping = F.create_map(F.lit("missing"), F.lit("../images/missing.png"), name, F.concat(F.lit("../images/"), name, F.lit(".png")))
    return _table(spark, sf_dir, "nation").select("n_nationkey", features.rewrite_image_links(md, mapping).alias("markdown"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("fig_image_"), F.col("l_partkey").cast("string"), F.lit(".png"))).when(F.col("l_partkey") % 3 == 1, F.col("l_linenumber").cast("string")).otherwise(F.lit("cover"))
    return features.image_names(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", key.alias("image_key"), (F.col("l_linenumber") % 2).alias("image_index")))


_IMAGES = """images AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'fig_image_' || l_partkey || CASE WHEN l_linenumber % 2 > 0 THEN '_' || l_linenumber % 2 ELSE '' END
  WHEN l_partkey % 3 = 1 THEN l_linenumber || '_image_' || l_linenumber % 2 ELSE '0_image_' || l_linenumber % 2 END AS image_name FROM lineitem)"""


@query(f"WITH {_IMAGES} SELECT l_orderkey, l_partkey, image_name, image_name || '.png' AS image_file, '../images/' || image_name || '.png' AS image_path FROM images")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("l_orderkey", "l_partkey", "image_name", "image_file", "image_path")


@query(f"WITH {_IMAGES} SELECT l_orderkey, string_split(image_name, '_image_')[1] AS page, count(*) AS images FROM images GROUP BY ALL")
def images_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.images_by_page(_images(spark, sf_dir), "l_orderkey")


@query(
    """WITH linked AS (SELECT l_suppkey, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN '<img src="p' || l_partkey || '.png">' ELSE '![' || l_linenumber || '](' || CASE WHEN l_partkey % 2 = 0 THEN '../images/p' || l_partkey || '.png' ELSE 'p' || l_partkey || '.png' END || ')' END, chr(10)
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS markdown FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, regexp_replace(markdown, '<img src="(p[0-9]*[02468])\\.png">', '<img src="../images/\\1.png">', 'g') AS markdown FROM linked"""
)
def supplier_image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of links of a supplier's text, looked up among the images of its even parts."""
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    link = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('<img  src="'), part, F.lit('.png" width="9">'))).otherwise(F.concat(F.lit("!["), F.col("l_linenumber").cast("string"), F.lit("]("), part, F.when(F.col("l_orderkey") % 2 == 0, "").otherwise(".png"), F.lit(")")))
    link = F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_partkey") % 2 == 1), F.concat(F.lit('<img src="'), part, F.lit('.png">'))).when((F.col("l_linenumber") % 3 != 0) & (F.col("l_partkey") % 2 == 1), F.concat(F.lit("!["), F.col("l_linenumber").cast("string"), F.lit("]("), part, F.lit(".png)"))).otherwise(link)
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", link.alias("link"))
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 2 == 0, part))).alias("known"))
    mapping = F.map_from_arrays(F.col("known"), F.transform("known", lambda n: F.concat(F.lit("../images/"), n, F.lit(".png"))))
    return rows.select("l_suppkey", features.rewrite_image_links(F.array_join(F.transform("lines", lambda x: x["link"]), "\n"), mapping).alias("markdown"))


@query(f"WITH {_IMAGES} SELECT l_orderkey, count(*) AS total_images, count(DISTINCT string_split(image_name, '_image_')[1]) AS pages_with_images FROM images GROUP BY l_orderkey")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.image_stats(_images(spark, sf_dir), "l_orderkey")


# Classification --------------------------------------------------------------------------------------------------------


@query(upto("tier1", "SELECT doc_id, chunk_no, t1_task, t1_concept, t1_reference FROM tier1"))
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.by_rules(_features(spark, sf_dir)).select("doc_id", "chunk_no", "t1_task", "t1_concept", "t1_reference")


@query(upto("tier1", "SELECT doc_id, chunk_no, t1_rules FROM tier1"))
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.by_rules(_features(spark, sf_dir)).select("doc_id", "chunk_no", _joined(F.col("t1_rules"), ",").alias("t1_rules"))


@query(upto("tier1", "SELECT doc_id, chunk_no, t1_type, t1_confidence FROM tier1"))
def tier1_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.by_rules(_features(spark, sf_dir)).select("doc_id", "chunk_no", "t1_type", "t1_confidence")


_DOCUMENT_FEATURES = "WITH RECURSIVE " + _BY_SIZE + ", chunks AS (SELECT doc_id, no AS chunk_no, 'Section ' || no AS title, content FROM sized)," + oracle.FEATURES + "," + oracle.RULED + "," + oracle.HYBRID


@query(_DOCUMENT_FEATURES + " SELECT doc_id, chunk_no::INTEGER AS chunk_no, type, confidence, needs_review FROM hybrid")
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"))
    return analysis.analyse(docs).select("doc_id", "chunk_no", "type", "confidence", "needs_review")


def _two_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir, "part")
    return spark.sql(_ANSWERS)


_ANSWERS = """SELECT p_partkey, t1_task, t1_concept, t1_reference, t2_task, t2_concept, t2_reference,
  CASE WHEN t1_task = greatest(t1_task, t1_concept, t1_reference) THEN 'Task' WHEN t1_concept = greatest(t1_task, t1_concept, t1_reference) THEN 'Concept' ELSE 'Reference' END AS t1_type, greatest(t1_task, t1_concept, t1_reference) AS t1_confidence,
  CASE WHEN t2_task = greatest(t2_task, t2_concept, t2_reference) THEN 'Task' WHEN t2_concept = greatest(t2_task, t2_concept, t2_reference) THEN 'Concept' ELSE 'Reference' END AS t2_type, greatest(t2_task, t2_concept, t2_reference) AS t2_confidence
FROM (SELECT p_partkey, cast(p_size % 7 + 1 AS double) / 64 AS t1_task, cast((p_size * 3) % 11 AS double) / 64 AS t1_concept, cast(p_size AS double) / 64 AS t1_reference,
  cast(p_partkey % 5 AS double) / 4 AS t2_task, cast(p_partkey % 3 AS double) / 8 AS t2_concept, cast(p_partkey % 7 AS double) / 16 AS t2_reference FROM part) AS s"""


@query(f"WITH answers AS ({_ANSWERS}), {fused('answers')} SELECT p_partkey, task, concept, reference, type, confidence, needs_review FROM fused")
def fuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.fuse(_two_answers(spark, sf_dir)).select("p_partkey", "task", "concept", "reference", "type", "confidence", "needs_review")


@query(
    f"WITH answers AS ({_ANSWERS}), {fused('answers')} SELECT split_part(reasoning, ' ', 1) AS opening, type, count(*) AS n, min(length(reasoning))::INTEGER AS shortest FROM fused GROUP BY ALL"
)
def fusion_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.fuse(_two_answers(spark, sf_dir)).select(F.split("reasoning", " ")[0].alias("opening"), "type", "reasoning")
    return rows.groupBy("opening", "type").agg(F.count("*").alias("n"), F.min(F.length("reasoning")).alias("shortest"))


@query(upto("hybrid", "SELECT doc_id, chunk_no, type, confidence, task, concept, reference, needs_review, reasoning FROM hybrid"))
def hybrid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("doc_id", "chunk_no", "type", "confidence", "task", "concept", "reference", "needs_review", "reasoning")


_ANSWER_TEXT = """'Sure: {"type": "' || CASE WHEN p_size % 4 = 0 THEN 'tASK' WHEN p_size % 4 = 1 THEN 'concept' WHEN p_size % 4 = 2 THEN 'Other' ELSE 'REFERENCE' END || '", "confidence": ' || cast(p_size AS varchar(20)) || 'e-1, ' || CASE WHEN p_size % 5 = 0 THEN '' ELSE '"reasoning": "r", ' END || '"scores": {"Task": 0.5, "Concept": 0.25, "Reference": 0.25}} ok'"""


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'Task' WHEN p_size % 4 = 3 THEN 'Reference' ELSE 'Concept' END AS type,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE least(1.0::DOUBLE, (p_size || 'e-1')::DOUBLE) END AS confidence, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 0.5::DOUBLE END AS task FROM part"""
)
def llm_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", classify.parse_answer(F.expr(_ANSWER_TEXT)).alias("a"))
    return rows.select("p_partkey", "a.type", "a.confidence", "a.task")


_LOOSE = "CASE cast(p_partkey % 4 AS int) WHEN 0 THEN '```json' || chr(10) || '{\"k\": ' || p_partkey || '}' || chr(10) || '```' WHEN 1 THEN '{\"k\": ' || p_partkey || ' // key' || chr(10) || '}' WHEN 2 THEN '{\"k\": ' ELSE '{\"k\": ' || p_partkey || '}' END"


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE p_partkey END AS k FROM part")
def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.get_json_object(classify.loose_json(F.expr(_LOOSE)), "$.k").cast("long").alias("k"))


# Statistics ------------------------------------------------------------------------------------------------------------


@query(upto("hybrid", "SELECT doc_id, type, count(*) AS chunks, round(avg(confidence), 9) AS average_confidence FROM hybrid GROUP BY doc_id, type"))
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_distribution(_hybrid(spark, sf_dir), "doc_id").withColumn("average_confidence", F.round("average_confidence", 9))


@query(upto("hybrid", "SELECT doc_id, count(*) AS total_chunks, round(avg(confidence), 9) AS overall_avg_confidence, 0::BIGINT AS needs_review FROM hybrid GROUP BY doc_id"))
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(_hybrid(spark, sf_dir), "doc_id").withColumn("overall_avg_confidence", F.round("overall_avg_confidence", 9))


@query(upto("hybrid", "SELECT doc_id, type AS dominant_type FROM (SELECT doc_id, type, count(*) AS n, min(chunk_no) AS first FROM hybrid GROUP BY doc_id, type) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1"))
def dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dominant_type(_hybrid(spark, sf_dir), "doc_id")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.queue(_hybrid(spark, sf_dir))


_QUEUE = upto("hybrid", ", queue AS (SELECT doc_id, chunk_no::INTEGER AS chunk_no, title, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS content, t1_type, t2_type FROM hybrid WHERE needs_review)").replace("\n, queue AS", ", queue AS")
_LABELS = "SELECT 'part-' || p_brand AS doc_id, cast(p_size % 5 + 1 AS int) AS chunk_no, CASE WHEN p_partkey % 3 = 0 THEN 'Nonsense' WHEN p_partkey % 2 = 0 THEN 'Task' ELSE 'Reference' END AS human_label, p_partkey AS seq FROM part WHERE p_size < 30"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.register(spark, sf_dir, "part")
    return stats.labelled(_queue(spark, sf_dir), spark.sql(_LABELS), ["doc_id", "chunk_no"], "seq")


_JOINED = _QUEUE + f", valid AS (SELECT doc_id, chunk_no, arg_max(human_label, seq) AS human_label FROM ({_LABELS}) WHERE human_label IN ('Task', 'Concept', 'Reference') GROUP BY ALL), items AS (SELECT q.*, v.human_label, CASE WHEN v.human_label IS NULL THEN 'pending' ELSE 'reviewed' END AS status FROM queue q LEFT JOIN valid v USING (doc_id, chunk_no))"


@query(_QUEUE + " SELECT doc_id, chunk_no, title, content, t1_type, t2_type, 'pending' AS status FROM queue")
def needs_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select("doc_id", "chunk_no", "title", "content", "t1_type", "t2_type", "status")


@query(_JOINED + " SELECT doc_id, chunk_no, human_label, status FROM items")
def human_label_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", "chunk_no", "human_label", "status")


@query(_JOINED + " SELECT doc_id, chunk_no, title, content, human_label AS label, t1_type, t2_type FROM items WHERE status = 'reviewed'")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.training_set(_labelled(spark, sf_dir)).select("doc_id", "chunk_no", "title", "content", "label", "t1_type", "t2_type")


@query(_JOINED + " SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'reviewed') AS reviewed, count(*) FILTER (status = 'reviewed') AS training_size FROM items")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.review_stats(_labelled(spark, sf_dir))


@query(upto("chunks", "SELECT doc_id, chunk_no, 'needs_review' AS type, 0.0::DOUBLE AS confidence, 0.33::DOUBLE AS task FROM chunks"))
def mark_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.marked_for_review(_chunks(spark, sf_dir)).select("doc_id", "chunk_no", "type", "confidence", "task")


# Records ---------------------------------------------------------------------------------------------------------------


@query(upto("chunks", f"SELECT doc_id, chunk_no, {slug('title')} AS slug, {slug('title')} || '_2' AS record_id FROM chunks"))
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", text.slug(F.col("title")).alias("slug"), structure.root_id(F.col("title")).alias("record_id"))


@query(upto("records", f"SELECT doc_id, chunk_no, i::INTEGER AS section_no, {oracle.section_id('i')} AS section_id FROM (SELECT doc_id, chunk_no, title, unnest(range(1, len(sections) + 1)) AS i FROM records WHERE type = 'Concept')"))
def unique_section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("type = 'Concept'").select("doc_id", "chunk_no", F.posexplode("sections").alias("p", "s"))
    return rows.select("doc_id", "chunk_no", (F.col("p") + 1).alias("section_no"), F.col("s.id").alias("section_id"))


@query(upto("records", "SELECT doc_id, chunk_no, i::INTEGER AS step_no, steps[i] AS cmd FROM (SELECT doc_id, chunk_no, steps, unnest(range(1, len(steps) + 1)) AS i FROM records WHERE type = 'Task')"))
def task_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("type = 'Task'").select("doc_id", "chunk_no", F.posexplode("steps").alias("p", "cmd"))
    return rows.select("doc_id", "chunk_no", (F.col("p") + 1).alias("step_no"), "cmd")


@query(upto("records", "SELECT doc_id, chunk_no, introduction, array_to_string(sections, '|') AS sections FROM records WHERE type = 'Concept'"))
def concept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("type = 'Concept'").select("doc_id", "chunk_no", "introduction", _joined(F.transform("sections", lambda s: s["content"])).alias("sections"))


@query(upto("records", "SELECT doc_id, chunk_no, array_to_string(columns, '|') AS columns, len(rows)::INTEGER AS n_rows, array_to_string(list_transform(rows, lambda r: array_to_string(r, ',')), '|') AS rows FROM records WHERE type = 'Reference'"))
def reference_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("type = 'Reference'")
    return rows.select("doc_id", "chunk_no", _joined(F.col("columns")).alias("columns"), F.size("rows").alias("n_rows"), _joined(F.transform("rows", lambda r: _joined(r, ","))).alias("rows"))


@query(
    upto(
        "records",
        f"""SELECT doc_id, chunk_no, concat_ws('|', '{messages.MISSING_ELEMENT}' || CASE type WHEN 'Task' THEN 'taskbody' WHEN 'Concept' THEN 'conbody' ELSE 'refbody' END,
  CASE WHEN type = 'Task' AND len(steps) = 0 THEN '{messages.FEW_STEPS.replace('%d', '1', 1).replace('%d', '0', 1)}' END, CASE WHEN type = 'Concept' AND introduction = '' AND len(sections) = 0 THEN '{messages.EMPTY_CONCEPT}' END) AS errors FROM records""",
    )
)
def constraint_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", "chunk_no", _joined(structure.constraint_errors(F.col("type"))).alias("errors"))


@query(upto("rendered", "SELECT type, count(*) AS n, count(*) FILTER (steps = ['Complete the task']) AS filled_steps, count(*) FILTER (type = 'Reference' AND columns IS NULL) AS filled_sections FROM rendered GROUP BY type"))
def structure_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.fix(_records(spark, sf_dir))
    filled = F.count(F.when(F.col("steps") == F.array(F.lit("Complete the task")), 1)).alias("filled_steps")
    info = F.count(F.when((F.col("type") == "Reference") & (F.get("sections", F.lit(0))["content"] == "Reference information"), 1)).alias("filled_sections")
    return rows.groupBy("type").agg(F.count("*").alias("n"), filled, info)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer of a model for each order: a step for each line, without a command where the line is open."""
    line = F.struct("l_linenumber", "l_linestatus", F.when(F.col("l_linestatus") != "O", F.col("l_returnflag")).alias("cmd"))
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    steps = F.transform("lines", lambda x: F.struct(x["cmd"].alias("cmd"), x["l_linenumber"].cast("string").alias("info")))
    return rows.select("l_orderkey", F.lit("Task").alias("type"), F.to_json(F.struct(F.lit("task").alias("title"), steps.alias("steps"))).alias("answer"))


@query(
    f"""WITH n AS (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus) AS i FROM lineitem)
SELECT l_orderkey, concat_ws('|', '{messages.MISSING_ELEMENT}taskbody', string_agg(replace('{messages.STEP_CMD}', '%d', i::VARCHAR), '|' ORDER BY i) FILTER (l_linestatus = 'O')) AS errors,
  count(*)::INTEGER AS steps, count(*) FILTER (l_linestatus = 'O')::INTEGER AS filled FROM n GROUP BY l_orderkey"""
)
def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modelrecords.fix(modelrecords.parse(_answers(spark, sf_dir)))
    filled = F.size(F.filter("model_steps", lambda s: s["cmd"] == "Perform action")).alias("filled")
    return rows.select("l_orderkey", _joined(F.col("model_errors")).alias("errors"), F.size("model_steps").alias("steps"), filled)


def _lacks(body: str) -> str:
    return f"{messages.MISSING_ELEMENT}{body}"


@query(
    f"""WITH n AS (SELECT l_orderkey, 's' || l_partkey % 4 AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
again AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY i) AS nth FROM n)
SELECT l_orderkey, concat_ws('|', '{_lacks('conbody')}', CASE WHEN l_orderkey % 5 = 0 AND l_orderkey % 3 = 0 THEN '{messages.EMPTY_CONCEPT}' END,
  string_agg('{messages.SECTION_ID}' || id, '|' ORDER BY i) FILTER (nth > 1 AND l_orderkey % 5 <> 0)) AS errors,
  CASE WHEN l_orderkey % 3 <> 0 THEN 'About it' WHEN l_orderkey % 5 = 0 THEN 'This is a concept description.' ELSE '' END AS introduction, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) END::INTEGER AS sections FROM again GROUP BY l_orderkey"""
)
def model_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept for each order, a section for each line; some without an introduction, some without sections."""
    k = F.col("l_orderkey")
    line = F.struct("l_linenumber", "l_partkey")
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    sections = F.transform("lines", lambda x: F.struct(F.concat(F.lit("s"), (x["l_partkey"] % 4).cast("string")).alias("id"), F.lit("Part").alias("title")))
    record = F.struct(F.lit("x").alias("title"), F.when(k % 3 != 0, "About it").otherwise("").alias("introduction"), F.when(k % 5 != 0, sections).alias("sections"))
    out = modelrecords.fix(modelrecords.parse(rows.select("l_orderkey", F.lit("Concept").alias("type"), F.to_json(record).alias("answer"))))
    return out.select("l_orderkey", _joined(F.col("model_errors")).alias("errors"), F.col("model_introduction").alias("introduction"), F.size("model_sections").alias("sections"))


@query(
    f"""SELECT o_orderkey, concat_ws('|', '{_lacks('refbody')}', CASE o_orderkey % 6 WHEN 0 THEN '{messages.EMPTY_REFERENCE}' WHEN 2 THEN '{messages.TABLE_FORMAT}' WHEN 3 THEN '{messages.TABLE_FIELDS}' WHEN 5 THEN '{messages.EMPTY_REFERENCE}' END) AS errors,
  CASE WHEN o_orderkey % 6 IN (0, 1, 5) THEN 'Reference information' END AS filled FROM orders"""
)
def model_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each order, with one of six contents: nothing but names, another key, two broken tables, properties, nothing at all."""
    k = F.col("o_orderkey")
    bodies = ['"reference_id":"r","title":"t","shortdesc":"s"', '"title":"t","note":"n"', '"title":"t","table":"text"', '"title":"t","table":{"columns":["a"]}', '"properties":[{"name":"p","value":"v"}]', '"reference_id":"r"']
    body = F.get(F.array(*map(F.lit, bodies)), (k % 6).cast("int"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.lit("Reference").alias("type"), F.concat(F.lit("{"), body, F.lit("}")).alias("answer"))
    out = modelrecords.fix(modelrecords.parse(rows))
    return out.select("o_orderkey", _joined(F.col("model_errors")).alias("errors"), F.get("model_sections", F.lit(0))["content"].alias("filled"))


# Topics ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {escape('html')} AS escaped FROM pages")
def escape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.escape_xml(F.col("html")).alias("escaped"))


def _of(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = _hybrid(spark, sf_dir).where(F.col("type") == kind)  # the type is settled: no record of another one is made
        return analysis.convert(chosen).select("doc_id", "chunk_no", "record_id", "xml")

    run.__name__ = f"render_{kind.lower()}"
    return run


for _kind in classify.TYPES:
    query(upto("rendered", f"SELECT doc_id, chunk_no, record_id, xml FROM rendered WHERE type = '{_kind}'"))(_of(_kind))


@query(upto("hybrid", r"SELECT doc_id, chunk_no, lpad(chunk_no::VARCHAR, 3, '0') || '_' || type || '_' || substr(regexp_replace(title, '[^\p{L}\p{N}]', '_', 'g'), 1, 50) || '.dita' AS file_name FROM hybrid"))
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("doc_id", "chunk_no", render.file_name(F.col("chunk_no"), F.col("type"), F.col("title")).alias("file_name"))


@query(upto("hybrid", "SELECT type, count(*) AS total, count(*) AS success, 0::BIGINT AS failed, 1.0::DOUBLE AS success_rate FROM hybrid GROUP BY type"))
def conversion_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.batch(_rendered(spark, sf_dir), "type")


@query(upto("rendered", "SELECT doc_id, chunk_no, length(xml)::INTEGER AS xml_length, CASE WHEN length(xml) > 500 THEN substr(xml, 1, 500) || '...' ELSE xml END AS xml_preview FROM rendered"))
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.conversion_report(_rendered(spark, sf_dir)).select("doc_id", "chunk_no", "xml_length", "xml_preview")


@query(upto("hybrid", "SELECT type, CASE type WHEN 'Task' THEN 'task.xml.j2' WHEN 'Concept' THEN 'concept.xml.j2' ELSE 'reference.xml.j2' END AS template, count(*) AS n FROM hybrid GROUP BY ALL"))
def template_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).groupBy("type", render.template(F.col("type")).alias("template")).agg(F.count("*").alias("n"))


# Trees -----------------------------------------------------------------------------------------------------------------

_TOPICS = f"WITH topics AS ({oracle.topics_sql()})"


@query(
    upto(
        "rendered",
        r"""SELECT doc_id, chunk_no, len(regexp_extract_all(xml, '<[a-z]'))::INTEGER AS elements, len(regexp_extract_all(xml, '<step>'))::INTEGER AS steps, len(regexp_extract_all(xml, '<entry>'))::INTEGER AS entries,
  CASE type WHEN 'Task' THEN 4 WHEN 'Concept' THEN CASE WHEN len(sections) > 0 THEN 3 ELSE 2 END ELSE CASE WHEN columns IS NULL THEN 3 ELSE 7 END END::INTEGER AS depth FROM rendered""",
    )
)
def xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("nodes")
    of = lambda t: F.size(xmlnodes.tagged(n, t))
    rows = xmlnodes.parse(_rendered(spark, sf_dir).select("doc_id", "chunk_no", "xml")).where(n.isNotNull())
    return rows.select("doc_id", "chunk_no", F.size(n).alias("elements"), of("step").alias("steps"), of("entry").alias("entries"), xmlnodes.depth(n).alias("depth"))


@query("SELECT doc_id, v <> 8 AS well_formed FROM (" + oracle.topics_sql() + ")")
def xml_wellformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmlnodes.parse(_topics(spark, sf_dir)).select("doc_id", F.col("nodes").isNotNull().alias("well_formed"))


@query(
    _TOPICS
    + r""" SELECT doc_id, length(xml)::INTEGER AS xml_size, (length(xml) - length(replace(xml, chr(10), '')))::INTEGER AS line_count, CASE WHEN v = 8 THEN 0 ELSE len(regexp_extract_all(xml, '<[a-z]')) END::INTEGER AS element_count,
  CASE WHEN v = 8 THEN NULL ELSE len(regexp_extract_all(xml, '<step[ >]')) END::INTEGER AS steps, CASE WHEN v = 8 THEN NULL ELSE len(regexp_extract_all(xml, '<p>')) END::INTEGER AS paragraphs,
  CASE v WHEN 0 THEN 16 + 3 * 8 WHEN 1 THEN 7 WHEN 2 THEN 16 + 13 WHEN 3 THEN 16 + 8 WHEN 4 THEN 16 + 8 + 9 + 5 WHEN 5 THEN 4 + 28 + 10 WHEN 6 THEN 17 WHEN 7 THEN 16 WHEN 8 THEN 0 ELSE 16 END::INTEGER AS text_content_length,
  CASE v WHEN 0 THEN 9 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 8 WHEN 5 THEN 9 WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 8 THEN NULL ELSE 3 END::INTEGER AS word_count FROM topics"""
)
def xml_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmlnodes.statistics(xmlnodes.parse(_topics(spark, sf_dir)), "doc_id").select("doc_id", "xml_size", "line_count", "element_count", "steps", "paragraphs", "text_content_length", "word_count")


@query("SELECT s_suppkey AS doc_id, CASE cast(s_suppkey % 10 AS int) WHEN 1 THEN 4 WHEN 5 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 7 WHEN 8 THEN NULL WHEN 9 THEN 2 ELSE 4 END::INTEGER AS depth FROM supplier")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmlnodes.parse(_topics(spark, sf_dir)).select("doc_id", xmlnodes.depth(F.col("nodes")).alias("depth"))


# Validation and repair ---------------------------------------------------------------------------------------------------


def _expected(rows: str, columns: str) -> str:
    return f"SELECT s_suppkey AS doc_id, {columns} FROM supplier JOIN (VALUES {rows}) AS e(v, issue_no, type, element, id) ON s_suppkey % 10 = e.v"


_L4_ERRORS = """(1, 0, 'MissingRequiredElement', 'title', NULL), (2, 0, 'MissingRequiredElement', 'step[2]/cmd', NULL), (3, 0, 'InvalidIDFormat', NULL, 'my bad id '), (4, 0, 'DuplicateID', NULL, 'a'), (4, 1, 'DuplicateID', NULL, 'a'),
  (6, 0, 'ElementOrderError', 'conbody', NULL), (8, 0, 'XMLSyntaxError', NULL, NULL), (9, 0, 'EmptyElement', 'steps', NULL)"""
_L3_ERRORS = """(1, 0, 'MissingRequiredElement', 'title', NULL), (2, 0, 'MissingRequiredElement', 'step[2]/cmd', NULL), (3, 0, 'InvalidIDFormat', NULL, 'my bad id '), (4, 0, 'DuplicateID', NULL, 'a'), (8, 0, 'XMLSyntaxError', NULL, NULL), (9, 0, 'EmptySteps', 'steps', NULL)"""
_ISSUE = "issue_no::INTEGER AS issue_no, type, element, CASE WHEN e.v = 3 THEN e.id || s_suppkey ELSE e.id END AS id"


@query(_expected(_L3_ERRORS, _ISSUE))
def validate_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_rows(validate.converter_issues(xmlnodes.parse(_topics(spark, sf_dir))), "l3_errors", "doc_id")


@query(
    """SELECT s_suppkey AS doc_id, w.type, w.element FROM supplier JOIN (VALUES (0, 'MissingDoctype', NULL), (1, 'MissingDoctype', NULL), (2, 'MissingDoctype', NULL), (3, 'MissingDoctype', NULL), (4, 'MissingDoctype', NULL), (5, 'MissingDoctype', NULL), (6, 'MissingDoctype', NULL),
  (7, 'MissingDoctype', NULL), (8, 'MissingDoctype', NULL), (9, 'MissingDoctype', NULL), (8, 'MissingDeclaration', NULL), (5, 'EmptyElement', 'image'), (9, 'EmptyElement', 'steps')) AS w(v, type, element) ON s_suppkey % 10 = w.v"""
)
def warnings_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_rows(validate.converter_issues(xmlnodes.parse(_topics(spark, sf_dir))), "l3_warnings", "doc_id").select("doc_id", "type", "element")


@query(_expected(_L4_ERRORS, _ISSUE))
def validate_l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_rows(validate.quality_issues(xmlnodes.parse(_topics(spark, sf_dir))), "l4_errors", "doc_id")


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 = 5 THEN 'image' ELSE 'steps' END AS element FROM supplier WHERE s_suppkey % 10 IN (5, 9)")
def warnings_l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_rows(validate.quality_issues(xmlnodes.parse(_topics(spark, sf_dir))), "l4_warnings", "doc_id").select("doc_id", "element")


@query("SELECT s_suppkey AS doc_id, 'conbody' AS element FROM supplier WHERE s_suppkey % 10 = 6")
def element_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = xmlnodes.parse(_topics(spark, sf_dir)).withColumn("issues", validate.order_issues(F.col("nodes"), xmlnodes.root(F.col("nodes")), validate.root_order("conbody")))
    return validate.issue_rows(parsed, "issues", "doc_id").select("doc_id", "element")


@query("SELECT s_suppkey AS doc_id, n FROM supplier JOIN (VALUES (4, 'each', 2), (4, 'once', 1)) AS e(v, how, k) ON s_suppkey % 10 = e.v CROSS JOIN (SELECT 1) CROSS JOIN LATERAL (SELECT how || ':' || k AS n)")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("nodes")
    rows = xmlnodes.parse(_topics(spark, sf_dir)).select("doc_id", F.explode(F.array(F.concat(F.lit("each:"), F.size(validate.each_repeated_id(n)).cast("string")), F.concat(F.lit("once:"), F.size(validate.repeated_ids(n)).cast("string")))).alias("n"))
    return rows.where("n not like '%:0' and n not like '%:-1'")


@query("SELECT s_suppkey AS doc_id, 'my bad id ' || s_suppkey AS id FROM supplier WHERE s_suppkey % 10 = 3")
def id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmlnodes.parse(_topics(spark, sf_dir)).select("doc_id", F.explode(validate.bad_ids(F.col("nodes"))).alias("i")).select("doc_id", "i.id")


#: The topics after one repair: empty steps gone, identifiers cleaned, and the second and third of equal ones numbered.
_REPAIRED = """replace(replace(replace(replace(xml, '<taskbody><steps></steps></taskbody>', '<taskbody />'), 'id="my bad id ' || doc_id || '"', 'id="my_bad_id_' || doc_id || '"'), '<step id="a"><cmd>Close', '<step id="a_2"><cmd>Close'), '<step id="a"><cmd>Stop', '<step id="a_3"><cmd>Stop')"""


@query(_TOPICS + f" SELECT doc_id, v, {_REPAIRED} AS repaired FROM topics")
def repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.quality_issues(xmlnodes.parse(_topics(spark, sf_dir)))
    return repair.repair(checked).select("doc_id", "v", F.col("repaired_xml").alias("repaired"))


@query(
    "SELECT s_suppkey AS doc_id, CASE s_suppkey % 10 WHEN 3 THEN 'my_bad_id_' || s_suppkey WHEN 4 THEN 'good_' || s_suppkey || ',a,a_2,a_3' WHEN 5 THEN 'c' || s_suppkey WHEN 6 THEN 'c' || s_suppkey"
    " WHEN 7 THEN 'r' || s_suppkey WHEN 8 THEN NULL ELSE 'good_' || s_suppkey END AS ids FROM supplier"
)
def repair_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.quality_issues(xmlnodes.parse(_topics(spark, sf_dir)))
    again = xmlnodes.parse(repair.repair(checked).select("doc_id", F.col("repaired_xml").alias("xml")))
    return again.select("doc_id", F.array_join(F.transform("nodes", lambda n: n["id_attr"]), ",").alias("ids"))


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 = 3 THEN 2 ELSE 1 END::INTEGER AS passes_used, s_suppkey % 10 NOT IN (1, 2, 4, 8, 9) AS valid FROM supplier")
def converter_fix_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.converter_fix(_topics(spark, sf_dir)).select("doc_id", "passes_used", F.col("l3_valid").alias("valid"))


@query(
    "SELECT s_suppkey AS doc_id, CASE cast(s_suppkey % 10 AS int) WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 9 THEN 2 ELSE 1 END::INTEGER AS iterations, s_suppkey % 10 NOT IN (1, 2, 6, 8, 9) AS success, CASE cast(s_suppkey % 10 AS int) WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 9 THEN 1 ELSE 0 END::INTEGER AS repairs, CASE WHEN s_suppkey % 10 IN (1, 2, 6, 8, 9) THEN 1 ELSE 0 END::INTEGER AS errors FROM supplier"
)
def validation_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.loop(_topics(spark, sf_dir))
    return out.select("doc_id", "iterations", F.col("loop_success").alias("success"), F.col("repairs_applied").alias("repairs"), F.size("l4_errors").alias("errors"))


@query(linetopics.L3)
def line_topics_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_rows(validate.converter_issues(xmlnodes.parse(linetopics.topics(spark, sf_dir), whole=False)), "l3_errors", "topic")


@query(linetopics.L4)
def line_topics_l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_rows(validate.quality_issues(xmlnodes.parse(linetopics.topics(spark, sf_dir), whole=False)), "l4_errors", "topic")


@query(linetopics.L4_MESSAGES)
def line_topics_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.described(validate.quality_issues(xmlnodes.parse(linetopics.topics(spark, sf_dir))), "l4_errors", kind="content_type")
    return checked.select("topic", F.posexplode("l4_errors").alias("issue_no", "i")).where("i.type <> 'XMLSyntaxError'").select("topic", "issue_no", "i.line", "i.message", "i.suggestion")


@query(
    """WITH line AS (SELECT doc_id, length(xml) AS size, v FROM (""" + oracle.topics_sql() + """))
SELECT doc_id, size::INTEGER AS xml_size, CASE v WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 8 THEN NULL ELSE 0 END::INTEGER AS steps FROM line"""
)
def report_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _assured(spark, sf_dir).withColumn("first_xml", F.col("xml"))
    return quality.report(checked, "doc_id", xml="first_xml").select("doc_id", "statistics.xml_size", "statistics.elements.steps")


@query(linetopics.L4_WARNINGS)
def line_topics_l4_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.issue_rows(validate.quality_issues(xmlnodes.parse(linetopics.topics(spark, sf_dir), whole=False)), "l4_warnings", "topic")
    return rows.groupBy("topic", "element").agg(F.count("*").alias("n"))


@query(linetopics.LOOP)
def line_topics_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.loop(linetopics.topics(spark, sf_dir), whole=False)
    return out.select("topic", "iterations", F.col("loop_success").alias("success"), F.col("repairs_applied").alias("repairs"), F.size("l4_errors").alias("errors"))


@query(
    """SELECT client_id::VARCHAR AS chunk_id, CASE WHEN last.label IS NULL THEN 'queued' ELSE 'labelled' END AS status, last.label AS label, last.reviewer AS reviewer, last.at AS at, last.event_id AS event_id FROM (
  SELECT client_id, arg_max({'at': valid_at, 'label': segment, 'reviewer': source, 'event_id': printf('%020d', change_id)}, {'a': valid_at, 'b': segment IS NOT NULL, 'c': printf('%020d', change_id), 'd': coalesce(segment, ''), 'e': coalesce(source, '')}) AS last
  FROM client_changes WHERE client_id IS NOT NULL AND change_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY client_id)"""
)
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of clients as events that label them, many of them late or repeated."""
    events = _table(spark, sf_dir, "client_changes").select(F.lpad(F.col("change_id").cast("string"), 20, "0").alias("event_id"), F.col("client_id").cast("string").alias("chunk_id"), F.col("valid_at").cast("timestamp").alias("at"), F.col("segment").alias("label"), F.col("source").alias("reviewer"))
    return reviewlog.state(events).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT s_suppkey, i::INTEGER AS issue_no, '/tmp/t' || s_suppkey || '.dita' AS file, (15 + i)::INTEGER AS line, 8::INTEGER AS col, 'bad ' || s_name AS message FROM supplier CROSS JOIN range(0, 2) AS r(i)")
def toolkit_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    line = lambda n: F.concat(F.lit("[ERROR] /tmp/t"), k, F.lit(f".dita:{n}:8: bad "), F.col("s_name"))
    log = F.concat(F.lit("[INFO] start\n"), line(15), F.lit("\n[WARN] x:1:2: y\n"), line(16))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(validate.toolkit_log(log)).alias("issue_no", "e"))
    return rows.select("s_suppkey", "issue_no", "e.file", "e.line", F.col("e.column").alias("col"), "e.message")


# Rules and quality -------------------------------------------------------------------------------------------------------


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = rules.Registry()
    registry.add(rules.image_references())
    return registry.summary(registry.run(xmlnodes.parse(_topics(spark, sf_dir))))


#: Rule issues of the faulty topics: v, rule, severity, detail.
_FOUND = """(5, 'title_length', 'warning', 'short'), (7, 'nesting_depth', 'warning', '7'), (9, 'step_count', 'error', '0'), (5, 'terminology_consistency', 'info', 'in order to'), (5, 'terminology_consistency', 'info', 'utilize'),
  (5, 'code_block_format', 'warning', NULL), (5, 'image_references', 'error', NULL), (8, 'xml_parse', 'error', NULL)"""


def _rule(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _ruled(spark, sf_dir).select("doc_id", F.explode("rule_issues").alias("i")).select("doc_id", "i.rule", "i.severity", "i.detail")
        return rows.where(F.col("rule") == name)

    run.__name__ = f"rule_{name}"
    return run


for _name in ("title_length", "nesting_depth", "step_count", "terminology_consistency", "code_block_format", "image_references"):
    query(f"SELECT s_suppkey AS doc_id, rule, severity, detail FROM supplier JOIN (VALUES {_FOUND}) AS e(v, rule, severity, detail) ON s_suppkey % 10 = e.v WHERE rule = '{_name}'")(_rule(_name))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the conversations and the benchmark as a glossary, each to be written in capitals."""
    words = lambda name: _table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), 0)).alias("term"))
    rows = words("conversations").union(words("benchmark")).distinct()
    return rows.select("term", F.upper("term").alias("use"))


@query(
    """WITH words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{7,}'))) AS term FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark))
SELECT doc_id, term, upper(term) AS use, ((length(low) - length(replace(low, term, ''))) // length(term))::INTEGER AS times FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN words ON contains(low, term)"""
)
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the glossary that a document holds, and how often."""
    return glossary.occurrences(_table(spark, sf_dir, "documents"), _terms(spark, sf_dir), "doc_id")


@query("SELECT page_id, CASE WHEN length(html) > 150 THEN 'warning' END AS severity, CASE WHEN length(html) > 150 THEN length(html)::VARCHAR END AS detail FROM pages")
def rule_shortdesc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.concat(F.lit("<concept><title>A title</title><shortdesc>"), text.escape_xml(F.col("html")), F.lit("</shortdesc><conbody/></concept>"))
    parsed = xmlnodes.parse(_table(spark, sf_dir, "pages").select("page_id", topic.alias("xml")))
    issue = F.get(rules.shortdesc_length(rules.Style()).check(F.col("nodes")), F.lit(0))
    return parsed.select("page_id", issue["severity"].alias("severity"), issue["detail"].alias("detail"))


@query("SELECT s_suppkey AS doc_id, 'img_' || s_suppkey || '.png' AS href FROM supplier WHERE s_suppkey % 3 <> 0")
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    topic = F.concat(F.lit('<concept><conbody><image href="img_'), k, F.lit('.png"/><image href="http://x/'), k, F.lit('.png"/><image href=""/></conbody></concept>'))
    suppliers = _table(spark, sf_dir, "supplier")
    known = suppliers.where("s_suppkey % 3 = 0").select(F.concat(F.lit("img_"), k, F.lit(".png")).alias("href"))
    return rules.missing_images(xmlnodes.parse(suppliers.select(F.col("s_suppkey").alias("doc_id"), topic.alias("xml"))), known, "doc_id")


_COUNTS = f"""found AS (SELECT v, count(*) FILTER (rule <> 'xml_parse') AS total, count(DISTINCT rule) AS failed, count(*) FILTER (severity = 'error' AND rule <> 'xml_parse') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i FROM (VALUES {_FOUND}) AS x(v, rule, severity, detail) GROUP BY v)"""


@query(
    f"WITH {_COUNTS} SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 = 8 THEN 0 ELSE 7 - coalesce(failed, 0) END::INTEGER AS passed_rules, coalesce(failed, 0)::INTEGER AS failed_rules, coalesce(total, 0)::INTEGER AS total_issues, coalesce(e, 0)::INTEGER AS rule_errors, coalesce(w, 0)::INTEGER AS rule_warnings, coalesce(i, 0)::INTEGER AS rule_infos FROM supplier LEFT JOIN found ON s_suppkey % 10 = v"
)
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).select("doc_id", "passed_rules", "failed_rules", "total_issues", "rule_errors", "rule_warnings", "rule_infos")


@query(
    f"SELECT rule, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM supplier JOIN (VALUES {_FOUND}) AS e(v, rule, severity, detail) ON s_suppkey % 10 = e.v GROUP BY rule"
)
def issue_severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.severity_pivot(_ruled(spark, sf_dir))


#: What the six standing rules find after the loop: no rule on images, and for v = 9 the empty steps are gone.
_AFTER = """(0, true, 0, true, 1, 0, 0, 0, 0), (1, false, 1, false, 1, 0, 0, 0, 0), (2, false, 1, false, 1, 0, 0, 0, 0), (3, true, 0, true, 2, 0, 0, 0, 0), (4, true, 0, true, 2, 0, 0, 0, 0), (5, true, 0, true, 1, 0, 2, 2, 1),
  (6, false, 1, false, 1, 0, 0, 0, 0), (7, true, 0, true, 1, 0, 1, 0, 0), (8, false, 1, false, 1, 0, 0, 0, 0), (9, false, 1, false, 2, 0, 0, 0, 0)"""
_SCORED = f"""WITH after AS (SELECT s_suppkey AS doc_id, a.* FROM supplier JOIN (VALUES {_AFTER}) AS a(v, valid, n_errors, success, iterations, e, w, i, warnings) ON s_suppkey % 10 = a.v),
parts AS (SELECT *, CASE WHEN valid THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - n_errors * 0.1::DOUBLE) END AS dita_compliance, CASE WHEN success THEN 1.0::DOUBLE - (iterations - 1) * 0.1::DOUBLE ELSE 0.5::DOUBLE END AS structure_quality,
  greatest(0.0::DOUBLE, 1.0::DOUBLE - (e * 0.2::DOUBLE + w * 0.1::DOUBLE + i * 0.05::DOUBLE)) AS content_completeness FROM after),
scored AS (SELECT *, 0.4::DOUBLE * dita_compliance + 0.3::DOUBLE * structure_quality + 0.3::DOUBLE * content_completeness AS overall_quality FROM parts)"""


def _assured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.assure(_topics(spark, sf_dir))


_SCORES = ["dita_compliance", "structure_quality", "content_completeness", "overall_quality"]


@query(_SCORED + f" SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in _SCORES)} FROM scored")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assured(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(c) for c in _SCORES])


@query(_SCORED + " SELECT doc_id, CASE WHEN NOT valid OR v = 8 THEN 'failed' WHEN w > 0 OR warnings > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS overall_status FROM scored")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assured(spark, sf_dir).select("doc_id", "overall_status")


@query(_SCORED + " SELECT doc_id, valid AND overall_quality >= 0.7 AS qa_success FROM scored")
def qa_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assured(spark, sf_dir).select("doc_id", "qa_success")


@query(
    _SCORED
    + f""" SELECT doc_id, CASE WHEN v IN (1, 2) THEN '{messages.ADVICE_MISSING}' WHEN v IN (3, 4) THEN '{messages.ADVICE_LOOP}' WHEN v = 5 THEN '{messages.ADVICE_TITLE}{messages.TITLE_SHORT}' WHEN v = 6 THEN '{messages.ADVICE_ORDER}'
  WHEN v = 7 THEN '{messages.ADVICE_DEPTH}' WHEN v = 9 THEN '{messages.ADVICE_MISSING}|{messages.ADVICE_LOOP}' ELSE '{messages.ADVICE_NONE}' END AS recommendations FROM scored"""
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assured(spark, sf_dir).select("doc_id", _joined(F.col("recommendations")).alias("recommendations"))


@query(
    _SCORED
    + " SELECT content_type, count(*) AS total, count(*) FILTER (valid AND overall_quality >= 0.7) AS success, round(avg(overall_quality), 6) AS avg_overall_quality, round(avg(iterations), 6) AS avg_iterations, sum(n_errors)::BIGINT AS total_errors, sum(e + w + i)::BIGINT AS total_issues, round(sum(e + w + i) / count(*), 6) AS avg_issues_per_doc FROM scored JOIN ("
    + oracle.topics_sql()
    + ") t USING (doc_id) GROUP BY content_type"
)
def qa_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.batch_summary(_assured(spark, sf_dir), "content_type")
    return out.select("content_type", "total", "success", *[F.round(c, 6).alias(c) for c in ("avg_overall_quality", "avg_iterations")], "total_errors", "total_issues", F.round("avg_issues_per_doc", 6).alias("avg_issues_per_doc"))


@query(
    _SCORED
    + f""", bodies AS (SELECT s.doc_id, t.content_type, regexp_extract(replace(replace(t.xml, '<step id="a"><cmd>Close', '<step id="a_2"><cmd>Close'), '<step id="a"><cmd>Stop', '<step id="a_3"><cmd>Stop'), '(?s)<(?:con|ref|task)body>(.*?)</(?:con|ref|task)body>', 1) AS body
  FROM scored s JOIN ({oracle.topics_sql()}) t USING (doc_id) WHERE valid AND overall_quality >= 0.7),
numbered AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY doc_id) AS i FROM bodies)
SELECT content_type, count(*)::INTEGER AS merged_docs, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE concept PUBLIC "-//OASIS//DTD DITA Concept//EN" "concept.dtd">' || chr(10) || '<concept id="merged_complete_document">' || chr(10) || '  <title>{messages.MERGED_TITLE}</title>' || chr(10) || '  <conbody>' || chr(10) || '    '
  || string_agg('<section id="Section_' || i || '"><title>Section_' || i || '</title>' || body || '</section>', chr(10) || '    ' ORDER BY i) || chr(10) || '  </conbody>' || chr(10) || '</concept>' AS merged_xml FROM numbered GROUP BY content_type"""
)
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _assured(spark, sf_dir)
    return quality.merge(docs, "content_type", "doc_id").select("content_type", "merged_docs", "merged_xml")


@query("SELECT s_suppkey % 10 AS v, CASE WHEN s_suppkey % 10 IN (1, 2, 6, 8, 9) THEN '1 errors left' ELSE 'valid' END || ' after ' || CASE WHEN s_suppkey % 10 IN (3, 4, 9) THEN '2' ELSE '1' END || ' of 3 passes, ' || CASE s_suppkey % 10 WHEN 3 THEN '1' WHEN 4 THEN '2' WHEN 9 THEN '1' ELSE '0' END || ' repairs' AS loop_summary, count(*) AS n FROM supplier GROUP BY ALL")
def loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    looped = repair.summary(repair.loop(_topics(spark, sf_dir)))
    return looped.groupBy(F.col("v").cast("long").alias("v"), "loop_summary").agg(F.count("*").alias("n"))


@query(
    f"""WITH numbered AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM orders)
SELECT o_orderstatus, 1::BIGINT AS line_no, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE concept PUBLIC "-//OASIS//DTD DITA Concept//EN" "concept.dtd">' || chr(10) || '<concept id="merged_complete_document">' || chr(10) || '  <title>{messages.MERGED_TITLE}</title>' || chr(10) || '  <conbody>' AS line FROM numbered GROUP BY o_orderstatus
UNION ALL SELECT o_orderstatus, i + 1, '    <section id="Section_' || i || '"><title>Section_' || i || '</title><p>' || o_orderkey || '</p></section>' FROM numbered
UNION ALL SELECT o_orderstatus, max(i) + 2, '  </conbody>' || chr(10) || '</concept>' FROM numbered GROUP BY o_orderstatus"""
)
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of thousands of sections each."""
    xml = F.concat(F.lit("<concept><conbody><p>"), F.col("o_orderkey").cast("string"), F.lit("</p></conbody></concept>"))
    docs = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", xml.alias("xml"), F.lit(True).alias("good"))
    return quality.merged_rows(docs, "o_orderstatus", "o_orderkey", "xml", "good")


#: Merged topics are valid. Those of v = 4 bring the same identifiers, which a second pass repairs; long titles, depth and wording of 5 and 7 stay warnings.
@query(
    f"SELECT content_type, count(*)::INTEGER AS merged_docs, true AS valid, (CASE WHEN count(*) FILTER (v = 4) > 1 THEN 2 ELSE 1 END)::INTEGER AS iterations,"
    f" CASE WHEN content_type = 'Task' THEN 'passed' ELSE 'passed_with_warnings' END AS status FROM ({oracle.topics_sql()}) WHERE v IN (0, 3, 4, 5, 7) GROUP BY content_type"
)
def merged_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _assured(spark, sf_dir)
    merged = quality.merge(docs, "content_type", "doc_id").select(F.col("content_type").alias("key"), "merged_docs", F.col("merged_xml").alias("xml"), F.lit("Concept").alias("content_type"))
    return analysis.assure(merged).select(F.col("key").alias("content_type"), "merged_docs", F.col("l4_valid").alias("valid"), "iterations", F.col("overall_status").alias("status"))


@query(upto("chunks", ", bare AS (SELECT doc_id, markdown FROM md WHERE doc_id NOT IN (SELECT doc_id FROM chunks)) SELECT 'chunk' AS kind, count(*) AS n FROM chunks UNION ALL SELECT 'single_chunk', count(*) FROM bare HAVING count(*) > 0").replace("\n, bare AS", ", bare AS"))
def single_chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.markdown(spark, sf_dir)
    rows = chunking.with_fallback(docs, chunking.chunk(docs, how="headings"), "doc_id")
    return rows.groupBy(F.when(F.col("id") == "single_chunk", F.col("id")).otherwise(F.lit("chunk")).alias("kind")).agg(F.count("*").alias("n"))


@query(upto("records", f"SELECT type, '{messages.SUGGEST_ELEMENT}' || CASE WHEN type = 'Task' AND len(steps) = 0 THEN '|{messages.SUGGEST_STEP}' WHEN type = 'Concept' AND introduction = '' AND len(sections) = 0 THEN '|{messages.SUGGEST_CONCEPT}' ELSE '' END AS suggestions, count(*) AS n FROM records GROUP BY ALL"))
def fix_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("type", _joined(structure.suggestions(structure.constraint_errors(F.col("type")))).alias("suggestions"))
    return rows.groupBy("type", "suggestions").agg(F.count("*").alias("n"))


@query(_SCORED + " SELECT doc_id, CASE WHEN NOT valid THEN 'failed' WHEN w > 0 OR warnings > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status, n_errors::INTEGER AS shown FROM scored")
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = quality.html(_assured(spark, sf_dir), "doc_id")
    return pages.select("doc_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("status"), F.regexp_count(F.regexp_extract("html", "<ul>(.*?)</ul>", 1), F.lit("<li>")).alias("shown"))


@query(_SCORED + " SELECT doc_id, valid AS is_valid, n_errors::INTEGER AS errors, iterations::INTEGER AS iterations, (CASE WHEN v = 8 THEN 1 ELSE 6 END)::INTEGER AS total_rules FROM scored")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality.report(_assured(spark, sf_dir), "doc_id")
    return r.select("doc_id", "validation_summary.is_valid", "validation_summary.errors", F.col("validation_summary.iterations_required").alias("iterations"), "custom_checks_summary.total_rules")


@query(
    upto(
        "rendered",
        """, size AS (SELECT type, count(*) AS topics, count(*) FILTER (NOT (type = 'Reference' AND columns IS NOT NULL) AND length(""" + escape("title") + """) >= 0) AS shallow FROM rendered GROUP BY type) SELECT type, topics, topics AS valid FROM size""",
    ).replace("\n, size AS", ", size AS")
)
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.end_to_end(corpus.markdown(spark, sf_dir))
    return out.groupBy("type").agg(F.count("*").alias("topics"), F.count(F.when(F.col("l4_valid"), 1)).alias("valid"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, features, types and their statistics."""
    analysed = analysis.analyse(corpus.markdown(spark, sf_dir))
    return analysed.groupBy("type").agg(F.count("*").alias("chunks"), F.round(F.avg("confidence"), 6).alias("average_confidence"), F.count(F.when(F.col("needs_review"), 1)).alias("needs_review"))
