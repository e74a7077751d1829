"""Two validators over node arrays: the converter's own, and the one of quality assurance. Issues are arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions import messages
from doculith.functions.text import blank, let
from doculith.operators.xmlnodes import at_place, below, child, child_of_root, children, root

#: node is the place of the node that an issue is about; null where the issue is that something is missing at all.
ISSUE = "array<struct<type:string,element:string,id:string,node:int>>"
ID = r"^[a-zA-Z][a-zA-Z0-9_\-.]*$"
# The order of children that quality assurance asks for, and the body of a root.
BODY = {"task": "taskbody", "concept": "conbody", "reference": "refbody"}
TASKBODY_ORDER = ["prereq", "context", "steps", "result", "example", "postreq"]


def root_order(body: str) -> list[str]:
    return ["title", "shortdesc", "prolog", body, "related-links"]


def issue(kind: str, element: Column | str | None = None, ident: Column | None = None, node: Column | None = None) -> Column:
    element = F.lit(element) if element is None or isinstance(element, str) else element
    none = lambda c: F.lit(None) if c is None else c
    return F.struct(F.lit(kind).alias("type"), element.cast("string").alias("element"), none(ident).cast("string").alias("id"), none(node).cast("int").alias("node"))


def _if(cond: Column, one: Column) -> Column:
    return F.when(cond, F.array(one)).otherwise(F.array().cast(ISSUE))


def repeated_ids(nodes: Column) -> Column:
    """One issue for each identifier that occurs more than once, at its first place."""
    return F.transform(F.filter(nodes, lambda n: (n["id_nth"] == 1) & (n["id_count"] > 1)), lambda n: issue("DuplicateID", ident=n["id_attr"], node=n["node_id"]))


def each_repeated_id(nodes: Column) -> Column:
    """One issue for each further occurrence of an identifier, in document order."""
    return F.transform(F.filter(nodes, lambda n: n["id_nth"] > 1), lambda n: issue("DuplicateID", ident=n["id_attr"], node=n["node_id"]))


def bad_ids(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: ~n["id_attr"].rlike(ID)), lambda n: issue("InvalidIDFormat", ident=n["id_attr"], node=n["node_id"]))


def _bare_steps(nodes: Column, steps: Column) -> Column:
    """The steps without a command, in order: those that their first command does not follow among the steps and commands."""
    of = lambda x: F.filter(x["in"], lambda n: ((n["tag"] == "step") & (n["depth"] == x["d"] + 1)) | ((n["tag"] == "cmd") & (n["depth"] == x["d"] + 2)))
    served = lambda f, n, i: F.coalesce(F.get(f, i + 1)["parent_id"] == n["node_id"], F.lit(False))
    bare = lambda f: F.filter(f, lambda n, i: (n["tag"] == "step") & ~served(f, n, i))
    return let(F.struct(below(nodes, steps).alias("in"), steps["depth"].alias("d")), lambda x: let(of(x), bare))


def _steps_issues(nodes: Column, no_step: str) -> Column:
    """Of a task: what its body, its steps and each step lack."""

    def of_steps(steps: Column) -> Column:
        bare = _bare_steps(nodes, steps)
        return F.concat(
            _if(steps.isNull(), issue("MissingRequiredElement", "steps")),
            _if(steps.isNotNull() & (F.size(children(nodes, steps, "step")) == 0), issue(no_step, "steps", node=steps["node_id"])),
            F.transform(bare, lambda s: issue("MissingRequiredElement", F.concat(F.lit("step["), s["nth"].cast("string"), F.lit("]/cmd")), node=s["node_id"])),
        )

    def of_body(body: Column) -> Column:
        missing = F.array(issue("MissingRequiredElement", "taskbody"))
        return F.when(body.isNull(), missing).otherwise(let(child(nodes, body, "steps"), of_steps))

    return let(child_of_root(nodes, "taskbody"), of_body)


def order_issues(nodes: Column, parent: Column, expected: list[str]) -> Column:
    """An issue for each expected child of a node whose first place is before that of the expected child found last."""
    heads = let(
        F.struct(below(nodes, parent).alias("n"), parent["node_id"].alias("p")),
        lambda x: F.filter(x["n"], lambda n: (n["parent_id"] == x["p"]) & (n["nth"] == 1) & n["tag"].isin(*expected)),
    )
    named = lambda h, tag: F.get(F.filter(h, lambda n: n["tag"] == tag), F.lit(0))

    def judged(h: Column) -> Column:
        found = F.filter(F.transform(F.array(*map(F.lit, expected)), lambda tag: named(h, tag)), lambda n: n.isNotNull())
        early = lambda f: F.filter(f, lambda n, i: n["pos"] < F.get(f, i - 1)["pos"])
        return let(found, early)

    return F.transform(let(heads, judged), lambda n: issue("ElementOrderError", n["tag"], node=n["node_id"]))


def before_parsing(xml: Column) -> Column:
    """Warnings about the declaration, its encoding and the document type."""
    first = F.split(xml, "\n", 2)[0]
    return F.concat(
        _if(~xml.rlike(r"^\s*<\?xml"), issue("MissingDeclaration")),
        _if(xml.contains("<?xml") & ~first.contains("encoding"), issue("MissingEncoding")),
        _if(~xml.contains("<!DOCTYPE"), issue("MissingDoctype")),
    )


def converter_issues(parsed: DataFrame, xml: str = "xml", where: Column | None = None) -> DataFrame:
    """Adds l3_errors, l3_warnings and l3_valid: well-formedness, identifiers, required elements; empty elements only warn.

    With `where`, rows that it does not hold for keep the columns they have.
    """
    n, tag = F.col("nodes"), root(F.col("nodes"))["tag"]
    empty = F.filter(n, lambda m: ~m["tag"].isin("shortdesc", "note", "info", "br", "hr", "img") & blank(F.coalesce(m["text"], F.lit(""))) & (m["n_children"] == 0) & blank(F.coalesce(m["tail"], F.lit(""))))
    missing = lambda t: _if(child_of_root(n, t).isNull(), issue("MissingRequiredElement", t))
    by_root = F.when(tag == "task", F.concat(missing("title"), _steps_issues(n, "EmptySteps")))
    for name in ("concept", "reference"):
        by_root = by_root.when(tag == name, F.concat(missing("title"), missing(BODY[name])))
    errors = F.concat(repeated_ids(n), bad_ids(n), by_root.otherwise(F.array().cast(ISSUE)))
    whole = n.isNotNull()
    errors = F.when(whole, errors).otherwise(F.array(issue("XMLSyntaxError")))
    warnings = F.concat(before_parsing(F.col(xml)), F.when(whole, F.transform(empty, lambda m: issue("EmptyElement", m["tag"], node=m["node_id"]))).otherwise(F.array().cast(ISSUE)))
    if where is not None:
        errors, warnings = F.when(where, errors).otherwise(F.col("l3_errors")), F.when(where, warnings).otherwise(F.col("l3_warnings"))
    return parsed.withColumns({"l3_errors": errors, "l3_warnings": warnings}).withColumn("l3_valid", F.size("l3_errors") == 0)


def quality_columns(parsed: DataFrame, kind: str | None = "content_type") -> tuple[Column, Column]:
    """(errors, warnings) of quality assurance. The checks follow the given type or the root, the task first; without a type any other root is an error."""
    n, tag = F.col("nodes"), root(F.col("nodes"))["tag"]
    given = F.col(kind) if kind is not None else F.lit(None).cast("string")
    typed = F.coalesce(given, F.when(tag.isin("task", "concept", "reference"), F.concat(F.upper(F.substring(tag, 1, 1)), F.substring(tag, 2, 100))).otherwise(F.lit("Unknown")))
    missing = lambda t: _if(child_of_root(n, t).isNull(), issue("MissingRequiredElement", t))
    ordered = let(child_of_root(n, "taskbody"), lambda body: F.when(body.isNotNull(), order_issues(n, body, TASKBODY_ORDER)).otherwise(F.array().cast(ISSUE)))
    by_type = F.when((typed == "Task") | (tag == "task"), F.concat(missing("title"), ordered, _steps_issues(n, "EmptyElement"), order_issues(n, root(n), root_order("taskbody"))))
    for name, title in (("concept", "Concept"), ("reference", "Reference")):
        by_type = by_type.when((typed == title) | (tag == name), F.concat(missing("title"), missing(BODY[name]), order_issues(n, root(n), root_order(BODY[name]))))
    bad_root = _if(given.isNull() & ~tag.isin("task", "concept", "reference"), issue("InvalidRootElement", tag))
    errors = F.concat(bad_root, by_type.otherwise(F.array().cast(ISSUE)), each_repeated_id(n), bad_ids(n))
    empty = F.filter(n, lambda m: ~m["tag"].isin("shortdesc", "note", "info", "stepresult") & (F.coalesce(m["text"], F.lit("")) == "") & (m["n_children"] == 0))
    whole = n.isNotNull()
    return F.when(whole, errors).otherwise(F.array(issue("XMLSyntaxError"))), F.when(whole, F.transform(empty, lambda m: issue("EmptyElement", m["tag"], node=m["node_id"]))).otherwise(F.array().cast(ISSUE))


def quality_issues(parsed: DataFrame, kind: str | None = "content_type", prefix: str = "l4") -> DataFrame:
    """Adds {prefix}_errors, _warnings and _valid of quality assurance."""
    errors, warnings = quality_columns(parsed, kind)
    return parsed.withColumns({f"{prefix}_errors": errors, f"{prefix}_warnings": warnings}).withColumn(f"{prefix}_valid", F.size(f"{prefix}_errors") == 0)


def described(checked: DataFrame, column: str, level: str = "l4", kind: str | None = None) -> DataFrame:
    """`checked` with the issues of a column, each with line, col, message and suggestion.

    Lines and columns count from 1 in the text; an issue about something missing has those of no node, a syntax error
    those of its message. `level` is l3 or l4; `kind` names the column of the type that messages speak of, else the root's tag.
    """
    texts = messages.ISSUE_MESSAGES[level]
    n = F.col("nodes")
    tag = root(n)["tag"] if kind is None else F.coalesce(F.lower(F.col(kind)), root(n)["tag"])

    def one(e: Column, x: Column) -> Column:
        node = at_place(x["n"], e["node"])
        step = F.regexp_extract(e["element"], r"^step\[(\d+)\]", 1)
        sort = F.when((e["type"] == "MissingRequiredElement") & (step != ""), "MissingCommand").when((e["type"] == "MissingRequiredElement") & (e["element"] == "steps"), "MissingSteps")
        sort = sort.when((e["type"] == "EmptyElement") & F.lit(column.endswith("errors")), "EmptySteps").otherwise(e["type"])
        text = x["error"]
        for name, form in texts.items():
            text = F.when(sort == name, F.lit(form)).otherwise(text)
        for slot, value in (("root", x["tag"]), ("element", e["element"]), ("id", e["id"]), ("step", step), ("count", node["id_count"].cast("string"))):
            text = F.replace(text, F.lit("{" + slot + "}"), F.coalesce(value, F.lit("")))
        hint = F.lit(None).cast("string")
        for name, form in messages.ISSUE_SUGGESTIONS.items():
            hint = F.when(sort == name, F.lit(form)).otherwise(hint)
        at = lambda word: F.when(e["type"] == "XMLSyntaxError", F.regexp_extract(x["error"], word + r" (\d+)", 1).try_cast("int"))
        return F.struct(e["type"].alias("type"), e["element"].alias("element"), e["id"].alias("id"), F.coalesce(node["line"], at("line")).alias("line"), F.coalesce(node["col"], at("column")).alias("col"), text.alias("message"), hint.alias("suggestion"))

    held = F.struct(n.alias("n"), tag.alias("tag"), F.col("parse_error").alias("error"))
    return checked.withColumn(column, let(F.struct(F.col(column).alias("e"), held.alias("x")), lambda y: F.transform(y["e"], lambda e: one(e, y["x"]))))


def issue_rows(checked: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row per issue, numbered in order."""
    return checked.select(*keys, F.posexplode(column).alias("issue_no", "i")).select(*keys, "issue_no", "i.type", "i.element", "i.id")


def toolkit_log(log: Column) -> Column:
    """The errors of an external toolkit's log: (file, line, column, message) of lines [ERROR] file:line:column: message."""
    pattern = r"\[ERROR\]\s+(.+?):(\d+):(\d+):\s+(.+)"
    rows = F.regexp_extract_all(log, F.lit(pattern), 0)
    part = lambda r, i: F.regexp_extract(r, pattern, i)
    return F.transform(rows, lambda r: F.struct(part(r, 1).alias("file"), part(r, 2).cast("int").alias("line"), part(r, 3).cast("int").alias("column"), part(r, 4).alias("message")))
