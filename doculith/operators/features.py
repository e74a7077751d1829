"""Feature columns of chunks, and operators on image links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.functions.text import counts, structural, words
from doculith.operators.xmlnodes import pieces


def extract(chunks: DataFrame, content: str = "content", only: str | None = None) -> DataFrame:
    """The chunks with their lexical and structural features; `only` names one of the two families."""
    out = chunks
    if only != "structural":
        out = out.withColumn("_words", words(F.col(content)))
        out = out.withColumns(counts(F.col(content), F.col("_words"))).drop("_words")
    return out.withColumns(structural(F.col(content))) if only != "lexical" else out


_LINK = re.compile(r'!\[([^\]]*)\]\(|<img\s+src="')
_REST = re.compile(r"[^\n]*?>")


class _Paths:
    """The entries of a map in their order: what becomes of a link's target when they are applied one after another."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.place = {name: i for i, (name, _) in enumerate(entries)}
        self.path = [path for _, path in entries]
        # A name may hold the character that ends a target.
        self.ends = {c: 1 + max((name.count(c) for name, _ in entries), default=0) for c in ')"'}

    def next(self, target: str, after: int, bare: bool) -> int | None:
        named = [target[:-4]] if target.endswith(".png") else []
        places = [self.place.get(n) for n in ([*named, target] if bare else named)]
        return min((p for p in places if p is not None and p > after), default=None)

    def follow(self, text: str, at: int, end: str, bare: bool) -> tuple[str, int] | None:
        """The last path of the target at a place that an `end` closes, and where the target ends; None if no entry names it."""
        stop, found = at, None
        for _ in range(self.ends[end]):
            stop = text.find(end, stop)
            if stop < 0:
                break
            place = self.next(text[at:stop], -1, bare)
            if place is not None and (found is None or place < found[0]):
                found = (place, stop)
            stop += 1
        if found is None:
            return None
        place, stop = found
        while (then := self.next(self.path[place], place, bare)) is not None:
            place = then
        return self.path[place], stop


def _rewritten(text: str, paths: _Paths) -> str:
    out, at, done = [], 0, 0
    while m := _LINK.search(text, at):
        at = m.start() + 2
        markdown = m[1] is not None
        found = paths.follow(text, m.end(), ")" if markdown else '"', markdown)
        if found is None:
            continue
        path, stop = found
        rest = _REST.match(text, stop + 1) if not markdown else None
        if not markdown and rest is None:
            continue
        out.append(text[done : m.start()])
        out.append(f"![{_rewritten(m[1], paths)}]({path})" if markdown else f'<img src="{path}">')
        at = done = stop + 1 if markdown else rest.end()
    return "".join([*out, text[done:]]) if out else text


def rewrite_image_links(md: Column, mapping: Column) -> Column:
    """Markdown whose links to the images of a map (name -> path) point to the path: with or without .png, and as HTML.

    The result is that of the map's entries applied one after another, in their order, so that a path which is another,
    later entry's name goes on to that entry's path. Each text is read once, and each link is looked up by its target.
    A null text or map gives null, an entry with a null path changes nothing, paths are not searched for links, and those
    that hold ) or a quote do not go on.
    """

    def rewritten(texts: pa.Array, entries: pa.Array) -> pa.Array:
        out, last, paths = [], None, None
        for text, own in zip(texts.to_pylist(), entries.to_pylist(), strict=True):
            if text is None or own is None:
                out.append(None)
                continue
            if own != last:
                last, paths = own, _Paths([(e["key"], e["value"]) for e in own if e["value"] is not None])
            out.append(_rewritten(text, paths))
        return pa.array(out, pa.string())

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, entries in batches:
            for start, n in pieces(texts):
                yield rewritten(texts.slice(start, n), entries.slice(start, n))

    return run(md, F.map_entries(mapping))


def image_names(images: DataFrame, key: str = "image_key", index: str = "image_index") -> DataFrame:
    """(name, file, path): a key that ends in .png names its file; any other is a page number, 0 if it is none."""
    named = F.col(key).endswith(".png")
    base = F.regexp_replace(F.col(key), r"\.[^.]*$", "")
    by_file = F.when(F.col(index) > 0, F.concat(base, F.lit("_"), F.col(index).cast("string"))).otherwise(base)
    page = F.when(F.col(key).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.col(key)).try_cast("int")).otherwise(F.lit(0))
    name = F.when(named, by_file).otherwise(F.concat(page.cast("string"), F.lit("_image_"), F.col(index).cast("string")))
    return images.withColumn("image_name", name).withColumn("image_file", F.concat("image_name", F.lit(".png"))).withColumn("image_path", F.concat(F.lit("../images/"), "image_file"))


def images_by_page(images: DataFrame, key: str, name: str = "image_name") -> DataFrame:
    """(key, page, images): the images of each page of a document; those whose name tells no page are left out."""
    page = F.when(F.col(name).contains("_image_"), F.split(F.col(name), "_image_")[0])
    return images.withColumn("page", page).where("page is not null").groupBy(key, "page").agg(F.count("*").alias("images"))


def image_stats(images: DataFrame, key: str, name: str = "image_name") -> DataFrame:
    """Of each document: its images, and the pages that have some."""
    page = F.when(F.col(name).contains("_image_"), F.split(F.col(name), "_image_")[0])
    return images.groupBy(key).agg(F.count("*").alias("total_images"), F.countDistinct(page).alias("pages_with_images"))
