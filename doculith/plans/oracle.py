"""Common table expressions in DuckDB's SQL that restate the operators independently, for the oracles of the catalogue."""

from __future__ import annotations

from doculith.functions import text
from doculith.plans.corpus import markdown_sql


def strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def escape(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;')"""


def slug(x: str) -> str:
    joined = rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s_-]', '', 'g'), '\s+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(CASE WHEN {joined} = '' THEN 'unnamed' WHEN regexp_matches({joined}, '^[a-z]') THEN {joined} ELSE 'id_' || {joined} END)"


MD = f"md AS ({markdown_sql('duckdb')})"

HEADINGS = rf"""
lines AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM md),
marked AS (SELECT *, regexp_matches(line, '^#{{2,3}}\s+.+$') AS head FROM lines),
numbered AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM marked),
sections AS (SELECT doc_id, grp, max(CASE WHEN head THEN line END) AS head_line, coalesce(string_agg(CASE WHEN NOT head THEN line || chr(10) END, '' ORDER BY pos), '') AS content FROM numbered WHERE grp > 0 GROUP BY doc_id, grp),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS no FROM sections WHERE regexp_matches(content, '\S')),
chunks AS (SELECT doc_id, no::INTEGER AS chunk_no, 'chunk_' || no AS id, {strip(r"regexp_extract(head_line, '^#{2,3}\s+(.+)$', 1)")} AS title, length(regexp_extract(head_line, '^(#{{2,3}})\s', 1))::INTEGER AS level, content FROM kept)"""

_SPEC = text.TITLE_WORDS


def _says(kind: str) -> str:
    return "(" + " OR ".join(f"contains(lower(title), '{w}')" for w in _SPEC[kind]) + ")"


_DEFINED = " OR ".join(f"regexp_matches(lower(content), '{p}')" for p in text.DEFINITIONS)
_TOKEN, _ENTITY = text.TOKEN.replace("'", "''"), text.ENTITY.replace("'", "''")

FEATURES = rf"""
split AS (SELECT *, regexp_extract_all(lower(content), '{_TOKEN}') AS words, list_filter(regexp_extract_all(content, '{text.SENTENCE}'), lambda s: regexp_matches(s, '\p{{L}}')) AS sents FROM chunks),
counted AS (SELECT *,
  len(words)::INTEGER AS word_count, len(sents)::INTEGER AS sentence_count,
  CASE WHEN len(sents) > 0 THEN len(words)::DOUBLE / len(sents)::DOUBLE ELSE 0.0::DOUBLE END AS avg_sentence_length,
  len(list_filter(words, lambda w: w IN ({strings(text.ACTION_FORMS)})))::INTEGER AS action_verbs,
  len(list_filter(sents, lambda s: regexp_extract(lower(s), '^[^\p{{L}}\p{{N}}_]*({_TOKEN})', 1) IN ({strings(text.ACTION_VERBS)}) AND NOT contains(s, '?')))::INTEGER AS imperative_verbs,
  len(list_filter(sents, lambda s: len(list_filter(regexp_extract_all(lower(s), '{_TOKEN}'), lambda w: w IN ({strings(text.BE_FORMS)}))) > 0))::INTEGER AS is_statements,
  ({_DEFINED}) AS has_definition,
  coalesce(list_sum(list_transform(sents, lambda s: len(regexp_extract_all(s, '{_ENTITY}')))), 0)::INTEGER AS named_entities,
  len(list_filter(words, lambda w: w IN ({strings(text.BE_FORMS)})))::INTEGER AS being,
  len(list_filter(words, lambda w: w IN ({strings(text.STOP_WORDS)})))::INTEGER AS stops,
  regexp_matches(content, '(?m)^\d+\.') AS has_numbered_list, regexp_matches(content, '(?m)^[-*+]\s') AS has_bullet_list,
  len(regexp_extract_all(content, '(?m)^(\d+\.|\*|-|\+)\s'))::INTEGER AS list_items,
  (contains(content, '|') AND contains(content, '---')) AS has_table,
  ((length(content) - length(replace(content, '|---', ''))) // 4)::INTEGER AS table_count,
  contains(content, '```') AS has_code_block, ((length(content) - length(replace(content, '```', ''))) // 6)::INTEGER AS code_blocks,
  (contains(content, '`') AND NOT contains(content, '```')) AS has_inline_code,
  len(regexp_extract_all(content, '(?m)^(#{{1,6}})\s'))::INTEGER AS heading_count,
  coalesce(list_max(list_transform(regexp_extract_all(content, '(?m)^(#{{1,6}})\s', 1), lambda h: length(h))), 0)::INTEGER AS max_heading_level,
  regexp_matches(content, '\[.*?\]\(.*?\)') AS has_links, regexp_matches(content, '!\[.*?\]\(.*?\)') AS has_images,
  len(regexp_extract_all(content, '!\[.*?\]\(.*?\)'))::INTEGER AS image_count,
  length(content)::INTEGER AS char_count, len(string_split(content, chr(10)))::INTEGER AS line_count FROM split),
features AS (SELECT *, (action_verbs + being)::INTEGER AS verb_count, greatest(0, word_count - action_verbs - being - stops)::INTEGER AS noun_count FROM counted)"""

STRUCTURAL = ["has_numbered_list", "has_bullet_list", "list_items", "has_table", "table_count", "has_code_block", "code_blocks", "has_inline_code", "heading_count", "max_heading_level", "has_links", "has_images", "image_count", "char_count", "line_count"]
LEXICAL = ["word_count", "sentence_count", "avg_sentence_length", "action_verbs", "imperative_verbs", "is_statements", "has_definition", "named_entities", "verb_count", "noun_count"]

#: (name, type, weight, condition), once more in SQL.
RULES = [
    ("strong_task_numbered_imperatives", "Task", "0.50", "has_numbered_list AND imperative_verbs >= 5"),
    ("numbered_list_with_actions", "Task", "0.40", "has_numbered_list AND action_verbs >= 5"),
    ("bullet_list_with_actions", "Task", "0.30", "has_bullet_list AND action_verbs >= 4"),
    ("high_imperative_verbs", "Task", "0.25", "imperative_verbs >= 3"),
    ("task_title_keyword", "Task", "0.20", _says("Task")),
    ("high_action_verb_density", "Task", "0.15", "action_verbs >= 7"),
    ("strong_reference_multiple_tables", "Reference", "0.50", "table_count >= 2"),
    ("table_low_text", "Reference", "0.40", "has_table AND word_count < 200"),
    ("reference_title_keyword", "Reference", "0.35", _says("Reference")),
    ("code_heavy_low_text", "Reference", "0.30", "code_blocks >= 3 AND word_count < 300"),
    ("has_table", "Reference", "0.20", "has_table"),
    ("high_named_entities", "Reference", "0.15", "named_entities >= 5"),
    ("strong_concept_definition_statements", "Concept", "0.50", "has_definition AND is_statements >= 4"),
    ("has_definition_pattern", "Concept", "0.35", "has_definition"),
    ("high_is_statements", "Concept", "0.30", "is_statements >= 3"),
    ("concept_title_keyword", "Concept", "0.30", _says("Concept")),
    ("descriptive_language", "Concept", "0.25", "action_verbs < 2 AND noun_count > verb_count"),
    ("moderate_named_entities", "Concept", "0.15", "named_entities BETWEEN 3 AND 5"),
    ("pure_text_no_structure", "Concept", "0.10", "NOT has_numbered_list AND NOT has_bullet_list AND NOT has_table"),
]


def _sum(kind: str) -> str:
    return "0.0::DOUBLE" + "".join(f" + CASE WHEN {cond} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for _, k, w, cond in RULES if k == kind)


def winner(p: str) -> str:
    return f"CASE WHEN {p}task = greatest({p}task, {p}concept, {p}reference) THEN 'Task' WHEN {p}concept = greatest({p}task, {p}concept, {p}reference) THEN 'Concept' ELSE 'Reference' END"


RULED = f"""
raw AS (SELECT *, {_sum('Task')} AS r1, {_sum('Concept')} AS r2, {_sum('Reference')} AS r3, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, _, _, c in RULES)}) AS names FROM features),
shares AS (SELECT *, CASE WHEN r1 + r2 + r3 > 0 THEN names ELSE 'default_concept' END AS t1_rules,
  CASE WHEN r1 + r2 + r3 > 0 THEN r1 / (r1 + r2 + r3) ELSE 0.0::DOUBLE END AS t1_task,
  CASE WHEN r1 + r2 + r3 > 0 THEN r2 / (r1 + r2 + r3) ELSE 1.0::DOUBLE END AS t1_concept,
  CASE WHEN r1 + r2 + r3 > 0 THEN r3 / (r1 + r2 + r3) ELSE 0.0::DOUBLE END AS t1_reference FROM raw),
tier1 AS (SELECT *, {winner('t1_')} AS t1_type, greatest(t1_task, t1_concept, t1_reference) AS t1_confidence FROM shares)"""


def fused(source: str) -> str:
    """fused AS (...): from a relation with t1_ and t2_ columns."""
    f = lambda c: f"(0.3::DOUBLE * t1_{c} + 0.7::DOUBLE * t2_{c})"
    case = "CASE WHEN t1_type = t2_type AND t2_type = type THEN 'Strong agreement: Both classifiers predict ' || type || ' (Rules: ' || format('{:.2f}', t1_confidence) || ', LLM: ' || format('{:.2f}', t2_confidence) || ')'"
    case += " WHEN t1_type = type AND t1_confidence > 0.8::DOUBLE THEN 'Rule-based classifier dominates: ' || type || ' with high confidence (' || format('{:.2f}', t1_confidence) || '), LLM suggested ' || t2_type || ' (' || format('{:.2f}', t2_confidence) || ')'"
    case += " WHEN t2_type = type AND t2_confidence > 0.8::DOUBLE THEN 'LLM classifier dominates: ' || type || ' with high confidence (' || format('{:.2f}', t2_confidence) || '), Rules suggested ' || t1_type || ' (' || format('{:.2f}', t1_confidence) || ')'"
    case += " WHEN t1_type <> t2_type THEN 'Fusion resolved conflict: Rules=' || t1_type || '(' || format('{:.2f}', t1_confidence) || '), LLM=' || t2_type || '(' || format('{:.2f}', t2_confidence) || '), Final=' || type || '(' || format('{:.2f}', confidence) || ')'"
    case += " ELSE 'Weighted fusion result: ' || type || ' (confidence: ' || format('{:.2f}', confidence) || ')' END"
    return f"""
mixed AS (SELECT *, {f('task')} AS f1, {f('concept')} AS f2, {f('reference')} AS f3 FROM {source}),
scaled AS (SELECT *, CASE WHEN f1 + f2 + f3 > 0 THEN f1 / (f1 + f2 + f3) ELSE f1 END AS task, CASE WHEN f1 + f2 + f3 > 0 THEN f2 / (f1 + f2 + f3) ELSE f2 END AS concept, CASE WHEN f1 + f2 + f3 > 0 THEN f3 / (f1 + f2 + f3) ELSE f3 END AS reference FROM mixed),
typed AS (SELECT *, {winner('')} AS type, greatest(task, concept, reference) AS confidence FROM scaled),
fused AS (SELECT *, confidence < 0.6::DOUBLE AS needs_review, {case} AS reasoning FROM typed)"""


HYBRID = (
    "asked AS (SELECT *, 'Concept' AS t2_type, 0.3::DOUBLE AS t2_confidence, 0.33::DOUBLE AS t2_task, 0.34::DOUBLE AS t2_concept, 0.33::DOUBLE AS t2_reference FROM tier1),"
    + fused("asked")
    + """,
hybrid AS (SELECT * EXCLUDE (type, confidence, task, concept, reference, needs_review, reasoning), CASE WHEN t1_confidence >= 0.9::DOUBLE THEN t1_type ELSE type END AS type, CASE WHEN t1_confidence >= 0.9::DOUBLE THEN t1_confidence ELSE confidence END AS confidence,
  CASE WHEN t1_confidence >= 0.9::DOUBLE THEN t1_task ELSE task END AS task, CASE WHEN t1_confidence >= 0.9::DOUBLE THEN t1_concept ELSE concept END AS concept, CASE WHEN t1_confidence >= 0.9::DOUBLE THEN t1_reference ELSE reference END AS reference,
  t1_confidence < 0.9::DOUBLE AND needs_review AS needs_review, CASE WHEN t1_confidence < 0.9::DOUBLE THEN reasoning END AS reasoning FROM fused)"""
)

_LINES = "string_split(content, chr(10))"
_SEP = r"regexp_matches(line, '^\s*\|[\s\-:]+\|')"
_CELLS = f"list_transform(list_slice(string_split(line, '|'), 2, len(string_split(line, '|')) - 1), lambda c: {strip('c')})"

RECORDS = rf"""
lists AS (SELECT *, list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '^\s*\d+\.\s*(.+)$')), lambda l: {strip(r"regexp_extract(l, '^\s*\d+\.\s*(.+)$', 1)")}) AS nums,
  list_transform(list_filter({_LINES}, lambda l: regexp_matches(l, '^\s*[-*]\s*(.+)$')), lambda l: {strip(r"regexp_extract(l, '^\s*[-*]\s*(.+)$', 1)")}) AS bullets,
  list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '') AS paras FROM hybrid),
rows_of AS (SELECT doc_id, chunk_no, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM hybrid WHERE type = 'Reference'),
seps AS (SELECT doc_id, chunk_no, min(pos) AS sep FROM rows_of WHERE pos > 1 AND {_SEP} GROUP BY ALL),
after AS (SELECT r.doc_id, r.chunk_no, min(r.pos) AS stop FROM rows_of r JOIN seps s USING (doc_id, chunk_no) WHERE r.pos > s.sep AND (NOT regexp_matches(line, '\S') OR NOT contains(line, '|')) GROUP BY ALL),
heads AS (SELECT r.doc_id, r.chunk_no, {_CELLS} AS columns FROM rows_of r JOIN seps s USING (doc_id, chunk_no) WHERE r.pos = s.sep - 1),
bodies AS (SELECT r.doc_id, r.chunk_no, list({_CELLS} ORDER BY r.pos) FILTER (len(string_split(line, '|')) > 2) AS rows FROM rows_of r JOIN seps s USING (doc_id, chunk_no) LEFT JOIN after a USING (doc_id, chunk_no) WHERE r.pos > s.sep AND r.pos < coalesce(a.stop, 2000000000) GROUP BY ALL),
records AS (SELECT l.*, {slug('title')} || '_2' AS record_id, CASE WHEN type = 'Task' THEN CASE WHEN len(nums) > 0 THEN nums ELSE bullets END END AS steps,
  CASE WHEN type = 'Concept' THEN coalesce(paras[1], '') END AS introduction, CASE WHEN type = 'Concept' THEN list_slice(paras, 2, len(paras)) END AS sections, h.columns, CASE WHEN h.columns IS NOT NULL THEN coalesce(b.rows, []) END AS rows
  FROM lists l LEFT JOIN heads h USING (doc_id, chunk_no) LEFT JOIN bodies b USING (doc_id, chunk_no))"""


def section_id(i: str) -> str:
    name = f"'section_' || ({i} + 1)"
    base = slug("title")
    return f"(CASE WHEN {base} = {name} THEN {name} || '_3' WHEN {base} || '_2' = {name} OR {base} || '_1' = {name} THEN {name} || '_1' ELSE {name} END)"


def _frame(root: str, body_tag: str, name: str, body: str) -> str:
    head = f"""'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE {root} PUBLIC "-//OASIS//DTD {name}//EN" "{root}.dtd">' || chr(10) || '<{root} id="' || {escape('record_id')} || '">' || chr(10) || '  <title>' || {escape('title')} || '</title>' || chr(10) || chr(10) || '  <{body_tag}>' || chr(10)"""
    xml = f"{head} || {body} || '  </{body_tag}>' || chr(10) || '</{root}>'"
    return rf"regexp_replace(regexp_replace({xml}, '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '[^\S\n]+(\n|\z)', '\1', 'g')"


_STEP = f"'      <step>' || chr(10) || CASE WHEN s <> '' THEN '        <cmd>' || {escape('s')} || '</cmd>' || chr(10) ELSE '' END || '      </step>' || chr(10)"
_SECTION = f"""'    <section id="' || {section_id('i')} || '">' || chr(10) || '      <p>' || {escape('s')} || '</p>' || chr(10) || chr(10) || '    </section>' || chr(10)"""
_ENTRY = f"'              <entry>' || {escape('c')} || '</entry>' || chr(10)"


def _row(r: str) -> str:
    return f"'            <row>' || chr(10) || array_to_string(list_transform({r}, lambda c: {_ENTRY}), '') || '            </row>' || chr(10)"


_TASK = f"chr(10) || '    <steps>' || chr(10) || array_to_string(list_transform(steps, lambda s: {_STEP}), '') || '    </steps>' || chr(10) || chr(10)"
_CONCEPT = f"CASE WHEN introduction <> '' THEN '    <p>' || {escape('introduction')} || '</p>' || chr(10) ELSE '' END || repeat(chr(10), 3) || array_to_string(list_transform(sections, lambda s, i: {_SECTION}), '') || chr(10)"
_TABLE = f"""'    <section>' || chr(10) || '      <table>' || chr(10) || '        <tgroup cols="' || len(columns) || '">' || chr(10) || '          <thead>' || chr(10) || {_row('columns')} || '          </thead>' || chr(10) || '          <tbody>' || chr(10) || array_to_string(list_transform(rows, lambda r: {_row('r')}), '') || '          </tbody>' || chr(10) || '        </tgroup>' || chr(10) || '      </table>' || chr(10) || '    </section>' || chr(10) || chr(10)"""
_REFERENCE = f"repeat(chr(10), 3) || CASE WHEN columns IS NOT NULL THEN {_TABLE} ELSE '    <section>' || chr(10) || '      <p>Reference information</p>' || chr(10) || '    </section>' || chr(10) END"

RENDERED = f"""
fixed AS (SELECT * EXCLUDE (steps, introduction), CASE WHEN type = 'Task' AND len(steps) = 0 THEN ['Complete the task'] ELSE steps END AS steps,
  CASE WHEN type = 'Concept' AND introduction = '' AND len(sections) = 0 THEN 'This is a concept description.' ELSE introduction END AS introduction FROM records),
rendered AS (SELECT *, CASE type WHEN 'Task' THEN {_frame('task', 'taskbody', 'DITA Task', _TASK)} WHEN 'Concept' THEN {_frame('concept', 'conbody', 'DITA Concept', _CONCEPT)} ELSE {_frame('reference', 'refbody', 'DITA Reference', _REFERENCE)} END AS xml FROM fixed)"""

_ORDERED = [MD, HEADINGS, FEATURES, RULED, HYBRID, RECORDS, RENDERED]


def upto(last: str, select: str) -> str:
    """WITH ... SELECT over the chain up to one of chunks, features, tier1, hybrid, records, rendered."""
    n = {"md": 1, "chunks": 2, "features": 3, "tier1": 4, "hybrid": 5, "records": 6, "rendered": 7}[last]
    return "WITH " + ",\n".join(_ORDERED[:n]) + "\n" + select


#: Topics with planted faults, one per supplier, that both engines build from one text.
FAULTS = 10


def topics_sql() -> str:
    """SELECT doc_id, v, content_type, xml: by v a good task, then one fault each, concepts, references and a text that is no XML."""
    k = "cast(s_suppkey AS varchar(20))"
    head = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10)"""
    t = lambda ident, title, body: f"""{head} || '<task id="' || {ident} || '">{title}<taskbody>{body}</taskbody></task>'"""
    title = "<title>Install the part</title>"
    step = "<step><cmd>Open it</cmd></step>"
    ok = f"'good_' || {k}"
    cases = [
        t(ok, title, f"<steps>{step}{step}{step}</steps>"),
        t(ok, "", f"<steps>{step}</steps>"),
        t(ok, title, f"<steps>{step}<step><info>Then</info></step></steps>"),
        t(f"'my bad id ' || {k}", title, f"<steps>{step}</steps>"),
        t(ok, title, '<steps><step id="a"><cmd>Open it</cmd></step><step id="a"><cmd>Close it</cmd></step><step id="a"><cmd>Stop</cmd></step></steps>'),
        f"""{head} || '<concept id="c' || {k} || '"><title>Good</title><conbody><p>In order to Utilize it, see</p><image href=""/><p>import os</p></conbody></concept>'""",
        f"""{head} || '<concept id="c' || {k} || '"><conbody><p>Text</p></conbody><title>A late title</title></concept>'""",
        f"""{head} || '<reference id="r' || {k} || '"><title>Good reference</title><refbody><section><table><tgroup cols="1"><thead><row><entry>a</entry></row></thead></tgroup></table></section></refbody></reference>'""",
        "'<task><title>x</task>'",
        t(ok, title, "<steps></steps>"),
    ]
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    kinds = "CASE WHEN s_suppkey % 10 IN (5, 6) THEN 'Concept' WHEN s_suppkey % 10 = 7 THEN 'Reference' ELSE 'Task' END"
    return f"SELECT s_suppkey AS doc_id, cast(s_suppkey % 10 AS int) AS v, {kinds} AS content_type, CASE cast(s_suppkey % 10 AS int) {whens} END AS xml FROM supplier"
