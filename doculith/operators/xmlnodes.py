"""XML documents parsed once into an array of nodes per row, on which all checks work without another parse.

A node knows its place: its parent, the last node of its subtree, which of its parent's children of one tag it is, and
how often its identifier occurs, before it and in all. So no check has to search the array for each of its elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions.text import let

#: node_id is the place in the array; nth is the place among the parent's children of the same tag, from 1; id_nth and
#: id_count are the occurrence of the identifier, from 1, and the number of its occurrences, null without one.
NODE = (
    "struct<node_id:int,parent_id:int,pos:int,depth:int,tag:string,id_attr:string,href:string,text:string,tail:string,"
    "n_children:int,last:int,nth:int,id_nth:int,id_count:int,line:int,col:int>"
)
_KINDS = {"int": pa.int32(), "string": pa.string()}
_FIELDS = [tuple(f.split(":")) for f in NODE[len("struct<") : -1].split(",")]
_NODE = pa.struct([(name, _KINDS[kind]) for name, kind in _FIELDS])
PARSED = f"struct<nodes:array<{NODE}>,error:string>"
#: Documents, and characters of them, whose nodes are Python objects at a time; what they give leaves the task before the next ones.
BATCH, BATCH_CHARS = 512, 1_000_000
#: The fields that a document's end settles, or that its own end or text does, by place in a node.
_TEXT, _TAIL, _CHILDREN, _LAST, _COUNT = (([name for name, _ in _FIELDS]).index(k) for k in ("text", "tail", "n_children", "last", "id_count"))
#: Identifiers that no check remarks on.
ID = re.compile(r"[a-zA-Z][a-zA-Z0-9_\-.]*\Z")


_HEAD = re.compile(r"\s*<\?xml[^>]*\?>")


def _read(xml: str) -> list[list]:
    """The nodes of a document as lists of their fields, in document order, from expat's events."""
    nodes: list[list] = []
    stack: list[tuple[list, dict[str, int]]] = []  # the open nodes, each with the number of its children by tag
    seen: dict[str, int] = {}
    into, at = None, 0  # the node that takes the text at hand, and the field
    parser = expat.ParserCreate(None, "}")

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal into, at
        if "}" in name:
            name = "{" + name
        own = len(nodes)
        parent, pos, number = None, 0, 1
        if stack:
            above, tags = stack[-1]
            parent, pos = above[0], above[_CHILDREN]
            above[_CHILDREN] = pos + 1
            tags[name] = number = tags.get(name, 0) + 1
        ident = href = nth = None
        if attributes:
            ident, href = attributes.get("id"), attributes.get("href")
            if ident is not None:
                seen[ident] = nth = seen.get(ident, 0) + 1
        into = [own, parent, pos, len(stack), name, ident, href, None, None, 0, own, number, nth, None, parser.CurrentLineNumber, parser.CurrentColumnNumber + 1]
        at = _TEXT
        nodes.append(into)
        stack.append((into, {}))

    def end(_: str) -> None:
        nonlocal into, at
        into, at = stack.pop()[0], _TAIL
        into[_LAST] = len(nodes) - 1

    def data(text: str) -> None:
        if stack:
            into[at] = text if into[at] is None else into[at] + text

    def refuse(*_: object) -> None:
        raise ValueError("entity declarations are refused")

    def unknown(name: str, is_parameter: bool) -> None:
        if not is_parameter:
            raise ValueError(f"undefined entity &{name};: line {parser.CurrentLineNumber}, column {parser.CurrentColumnNumber}")

    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.EntityDeclHandler, parser.SkippedEntityHandler = refuse, unknown
    try:
        parser.Parse(xml, True)
    finally:  # the parser and its handlers refer to each other
        parser.StartElementHandler = parser.EndElementHandler = parser.CharacterDataHandler = parser.EntityDeclHandler = parser.SkippedEntityHandler = None
    for node in nodes:
        if node[5] is not None:
            node[_COUNT] = seen[node[5]]
    return nodes


def _remarkable(nodes: list[list]) -> list[list]:
    """The nodes that a check of `validate` may remark on or has to look at, each as it is; the others change no issue.

    These are the first of each tag down to the children of a body, nodes without children or text, identifiers that are
    ill-formed or repeated, and steps without a command. A first step, and each step kept, keeps its first command.
    """
    served = {n[1] for n in nodes if n[4] == "cmd"}
    kept: list[list] = []
    steps: set[int] = set()
    for n in nodes:
        own, parent, _, depth, tag, ident, _, text, _, n_children, _, nth, _, count, _, _ = n
        first = nth == 1
        if (
            (first and (depth <= 2 or tag == "step" or (tag == "cmd" and parent in steps)))
            or (n_children == 0 and (text is None or not text.strip()))
            or (ident is not None and (count > 1 or ID.match(ident) is None))
            or (tag == "step" and own not in served)
        ):
            kept.append(n)
            if tag == "step":
                steps.add(own)
    return kept


def rows_of(xml: str | None) -> tuple[list[list] | None, str | None]:
    """The nodes in document order, each a list of its fields, or null and the parser's message. Comments are left out; entities cannot be declared.

    Lines and columns count from 1; those in a message count from behind the declaration.
    """
    if xml is None:
        return None, "no document"
    head = _HEAD.match(xml)
    try:
        nodes = _read(xml[head.end() :] if head else xml)
        if head and (above := head[0].count("\n")):
            for n in nodes:
                n[-2] += above
        return nodes, None
    except (expat.ExpatError, ValueError) as e:
        return None, str(e)


def nodes_of(xml: str | None) -> tuple[list[dict] | None, str | None]:
    """The same as one dictionary a node."""
    nodes, error = rows_of(xml)
    if nodes is None:
        return None, error
    return [dict(zip((name for name, _ in _FIELDS), n, strict=True)) for n in nodes], None


def parsed_array(texts: list[str | None], whole: bool = True) -> pa.Array:
    """The nodes and errors of some texts as PARSED; without `whole` only the nodes that checks look at."""
    flat: list[list] = []
    ends: list[int | None] = []
    errors: list[str | None] = []
    for xml in texts:
        nodes, error = rows_of(xml)
        ends.append(None if nodes is None else len(flat))
        errors.append(error)
        if nodes is not None:
            flat += nodes if whole else _remarkable(nodes)
    columns = list(zip(*flat, strict=True)) or [()] * len(_FIELDS)
    nodes = pa.StructArray.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], fields=list(_NODE))
    lists = pa.ListArray.from_arrays(pa.array([*ends, len(flat)], pa.int32()), nodes)
    return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], names=["nodes", "error"])


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, length) of consecutive texts of BATCH rows and BATCH_CHARS characters at most, but for a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= BATCH or total + n > BATCH_CHARS):
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start


def parsed(xml: Column, whole: bool = True) -> Column:
    """(nodes, error) of a text; only the text goes through Python. A null text has the error "no document"."""

    @F.arrow_udf(PARSED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start, n in pieces(texts):
                yield parsed_array(texts.slice(start, n).to_pylist(), whole)

    # It counts as not deterministic, so that no filter or projection makes it run twice.
    return run.asNondeterministic()(xml)


def parse(docs: DataFrame, xml: str = "xml", whole: bool = True) -> DataFrame:
    """Adds nodes (null if the text is no well-formed document) and parse_error.

    Without `whole` the nodes are only those that the checks of `validate` look at, with the places they have in the
    document: the issues are the same, and a topic of many steps sends few of its nodes from Python to Spark.
    """
    out = docs.withColumn("_parsed", parsed(F.col(xml), whole))
    return out.withColumns({"nodes": F.col("_parsed.nodes"), "parse_error": F.col("_parsed.error")}).drop("_parsed")


def exploded(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per node."""
    return parsed.select(*keys, F.explode("nodes").alias("n")).select(*keys, "n.*")


def tagged(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def below(nodes: Column, node: Column) -> Column:
    """The nodes of the subtree of a node, without itself; none for a null."""
    # An array that lacks nodes is searched by their places; a whole one is cut.
    inside = lambda x: F.filter(x["n"], lambda n: (n["node_id"] > x["from"]) & (n["node_id"] <= x["to"]))
    whole = F.size(nodes) == F.get(nodes, F.lit(0))["last"] + 1
    cut = F.slice(nodes, node["node_id"] + 2, node["last"] - node["node_id"])
    found = F.when(whole, cut).otherwise(let(F.struct(nodes.alias("n"), node["node_id"].alias("from"), node["last"].alias("to")), inside))
    return F.coalesce(found, F.slice(nodes, 1, 0))


def at_place(nodes: Column, place: Column) -> Column:
    """The node of a place in the document; null for a null or where the array lacks it."""
    there = F.get(nodes, place)
    return F.when(there["node_id"] == place, there).otherwise(let(place, lambda p: F.get(F.filter(nodes, lambda n: n["node_id"] == p), F.lit(0))))


def children(nodes: Column, parent: Column, tag: str) -> Column:
    """The direct children of a node with a tag, in order."""
    deep = parent["depth"] + 1
    return let(F.struct(below(nodes, parent).alias("n"), deep.alias("d")), lambda x: F.filter(x["n"], lambda n: (n["depth"] == x["d"]) & (n["tag"] == tag)))


def child(nodes: Column, parent: Column, tag: str) -> Column:
    """The first child of a node with a tag; null without one."""
    return F.get(children(nodes, parent, tag), F.lit(0))


def root(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def child_of_root(nodes: Column, tag: str) -> Column:
    """The first child of the root with a tag; null without one."""
    return F.get(F.filter(nodes, lambda n: (n["parent_id"] == 0) & (n["nth"] == 1) & (n["tag"] == tag)), F.lit(0))


def texts(nodes: Column) -> Column:
    """All text nodes in document order, joined by a space: each node's text, then its children, then its tail."""
    # A tail stands behind the whole subtree of its node; of tails behind one node the deepest comes first.
    def pieces(n: Column) -> Column:
        return F.array(
            F.struct(n["node_id"].alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("up"), n["text"].alias("text")),
            F.struct(n["last"].alias("at"), F.lit(2).alias("kind"), (-n["depth"]).alias("up"), n["tail"].alias("text")),
        )

    ordered = F.array_sort(F.filter(F.flatten(F.transform(nodes, pieces)), lambda p: p["text"].isNotNull()))
    return F.array_join(F.transform(ordered, lambda p: p["text"]), " ")


def sizes(n: Column, x: Column) -> dict[str, Column]:
    """Characters, line ends, elements, characters of text and words of a topic, from its nodes and its XML."""
    text = texts(n)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return {
        "xml_size": F.length(x),
        "line_count": F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))),
        "element_count": F.coalesce(F.when(n.isNotNull(), F.size(n)), F.lit(0)),
        "text_content_length": F.coalesce(F.when(n.isNotNull(), F.length(text)), F.lit(0)),
        "word_count": F.when(n.isNotNull(), words),
    }


# What is counted below the root, by tags.
COUNTED = {"steps": ["step"], "sections": ["section"], "paragraphs": ["p"], "lists": ["ul", "ol"], "tables": ["table"], "images": ["image"], "notes": ["note"], "codeblocks": ["codeblock"]}


def counts(n: Column) -> dict[str, Column]:
    """The elements below the root by what they are; null without nodes."""
    below_root = lambda tags: F.when(n.isNotNull(), F.size(F.filter(n, lambda m: m["tag"].isin(*tags) & (m["node_id"] > 0))))
    return {name: below_root(tags) for name, tags in COUNTED.items()}


def statistics(parsed: DataFrame, *keys: str, xml: str = "xml") -> DataFrame:
    """Sizes and counts of each document; a document that does not parse has only its size and lines."""
    n = F.col("nodes")
    return parsed.select(*keys, *[c.alias(name) for name, c in {**sizes(n, F.col(xml)), **counts(n)}.items()])


def depth(nodes: Column) -> Column:
    """Edges on the longest way from the root to a leaf."""
    return F.array_max(F.transform(nodes, lambda n: n["depth"]))
