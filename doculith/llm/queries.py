"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.llm import decontaminate, jaccard_join, lang_id, lexical_search, mixing, nn_descent, pii, snapshot_diff, substring_dedup, suffix_dedup, toxicity, url_filter, warc
from doculith.llm.common import table

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
#: Target weights of sources; every other source weighs 1.
WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 3.0, "src3": 0.25}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lang_id.held_out("doc_id", 4, 2)
    found = lang_id.predict(docs, lang_id.fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), 200)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), 3, 90)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lang_id.held_out("doc_id", 3, 1)
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "source", "text", F.col("mix_copies").alias("n_copies"), F.col("mix_copy").alias("copy_no"), F.col("mix_key").alias("shuffle_key"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"), 13)


def op12_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("text", "lang", "source")
    found = snapshot_diff.difference(docs, snapshot_diff.later_snapshot(docs), "doc_id", columns, {"row_sha256": snapshot_diff.row_sha256(*columns)})
    return found.withColumn("changed", F.array_join("changed", ","))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_mix_sources": op9_mix_sources,
    "op10_near_vectors": op10_near_vectors,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_snapshot_diff": op12_snapshot_diff,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op4_jaccard_join": r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM split),
entries AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS k FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
half AS (SELECT x, y FROM shared WHERE 100 * k >= 90 * (n + m - k)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM sets LEFT JOIN least ON doc_id = x""",
    "op5_warc": r"""
WITH page AS (SELECT page_id, url AS uri, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(hex, (k // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, uri FROM page""",
    "op10_near_vectors": r"""
WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
found AS (SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = v.vec_id), v.vec_id)) AS component_id FROM embeddings v)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found""",
    "op9_mix_sources": r"""
WITH size AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
weighed AS (SELECT *, CASE WHEN chars = 0 THEN 0.0::DOUBLE WHEN source = 'src0' THEN 2.0::DOUBLE WHEN source = 'src1' THEN 0.5::DOUBLE
  WHEN source = 'src2' THEN 3.0::DOUBLE WHEN source = 'src3' THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM size),
rated AS (SELECT source, CASE WHEN weight > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(chars) FROM weighed)::DOUBLE / chars::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM weighed),
spans AS (SELECT source, rate, CASE WHEN floor(rate - 12 * sqrt(rate) - 30) >= 100 THEN floor(rate - 12 * sqrt(rate) - 30)::BIGINT ELSE 0::BIGINT END AS low,
  ceil(rate + 12 * sqrt(rate) + 30)::BIGINT AS last FROM rated WHERE rate > 0),
steps AS (SELECT source, rate, low, CASE WHEN low = 0 THEN -rate ELSE low * ln(rate) - rate - lgamma(low + 1) END AS begun, unnest(range(low, last + 1)) AS k FROM spans),
terms AS (SELECT source, k, low, exp(begun + sum(CASE WHEN k = low THEN 0.0::DOUBLE ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM steps),
cdf AS (SELECT source, k, low, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, source, text, (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, (SELECT coalesce(min(low), 0) + count(*) FILTER (WHERE cdf.c < d.u) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source)::BIGINT AS n_copies FROM drawn d),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted WHERE n_copies > 0)
SELECT doc_id, source, text, n_copies, copy_no::BIGINT AS copy_no,
  md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy_no::VARCHAR) AS shuffle_key FROM copies""",
    "op11_substring_dedup": r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM starts),
firsts AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w),
lost AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (w) WHERE low < doc_id) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda w, k: NOT coalesce(list_contains(places, k), false)), ' ')) AS kept_sha256
FROM split LEFT JOIN lost USING (doc_id)""",
    "op12_snapshot_diff": r"""
WITH folded AS (SELECT doc_id, text, lang, source, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 10 AS k FROM documents),
later AS (SELECT unnest(CASE WHEN k IN (3, 4) THEN [-1 - doc_id] WHEN k = 5 THEN [doc_id, -1 - doc_id] ELSE [doc_id] END) AS doc_id,
  CASE WHEN k = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN k = 2 THEN source ELSE lang END AS lang,
  CASE WHEN k = 2 THEN lang WHEN k = 4 THEN NULL ELSE source END AS source FROM folded WHERE k <> 0),
digested AS (SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS sha FROM later),
met AS (SELECT a.doc_id AS a_id, a.text AS a_text, a.lang AS a_lang, a.source AS a_source, b.* FROM documents a FULL JOIN digested b ON a.doc_id = b.doc_id),
gone AS (SELECT a_id, a_text, a_lang, a_source, row_number() OVER (PARTITION BY a_text, a_lang, a_source ORDER BY a_id) AS place FROM met WHERE doc_id IS NULL),
come AS (SELECT doc_id, text, lang, source, sha, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id DESC) AS place FROM met WHERE a_id IS NULL),
paired AS (SELECT doc_id AS key, a_id AS old_key, sha AS row_sha256, concat_ws(',', CASE WHEN a_text IS DISTINCT FROM text THEN 'text' END, CASE WHEN a_lang IS DISTINCT FROM lang THEN 'lang' END,
  CASE WHEN a_source IS DISTINCT FROM source THEN 'source' END) AS changed FROM met WHERE a_id IS NOT NULL AND doc_id IS NOT NULL)
SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, row_sha256 FROM paired
UNION ALL SELECT coalesce(c.doc_id, g.a_id), g.a_id, CASE WHEN g.a_id IS NULL THEN 'insert' WHEN c.doc_id IS NULL THEN 'delete' ELSE 'rekey' END, '', c.sha
FROM gone g FULL JOIN come c ON g.place = c.place AND g.a_text IS NOT DISTINCT FROM c.text AND g.a_lang IS NOT DISTINCT FROM c.lang AND g.a_source IS NOT DISTINCT FROM c.source""",
    "op13_lexical_search": r"""
WITH listed AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
sized AS (SELECT doc_id, count(*) AS n FROM listed GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sized),
post AS (SELECT doc_id, term, count(*) AS tf FROM listed SEMI JOIN asked USING (term) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, whole GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN post USING (term) JOIN weight USING (term) JOIN sized USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""",
}
