"""The images of Word packages: relationships and image bytes as rows, and the section that closes a document with images."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doculith.operators.features import image_names

# Names of the package format, and the heading of the closing section.
_RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_INLINE = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}inline"
SECTION = "## 文档图片"
#: What a file that cannot be read raises.
BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, OSError)


def _relations(package: zipfile.ZipFile) -> list[dict]:
    """The relationships of the document part, in order; a target is the name of a part, or a URL if it is external."""
    if "word/_rels/document.xml.rels" not in package.namelist():
        return []
    out = []
    for r in ElementTree.fromstring(package.read("word/_rels/document.xml.rels")).iter(_RELATION):
        external = r.get("TargetMode") == "External"
        target = r.get("Target") or ""
        part = target if external else posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"word/{target}")
        out.append({"rel_id": r.get("Id"), "kind": (r.get("Type") or "").rpartition("/")[2], "target": part, "external": external})
    return out


def _shape(files: DataFrame, keys: tuple[str, ...], more: str) -> str:
    return ", ".join([*(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys), more])


def _per_file(files: DataFrame, content: str, keys: tuple[str, ...], more: str, kind: pa.Schema, read) -> DataFrame:
    """One batch for each row that `read` yields of a file; a file that cannot be read gives one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own = [b.column(k).slice(i, 1) for k in range(len(keys))]

                def row(r: dict, own=own) -> pa.RecordBatch:
                    part = pa.RecordBatch.from_pylist([r], kind)
                    return pa.RecordBatch.from_arrays([*own, *part.columns], names=[*keys, *kind.names])

                try:
                    with zipfile.ZipFile(io.BytesIO(b.column(len(keys))[i].as_py() or b"")) as package:
                        for r in read(package):
                            yield row(r)
                except BROKEN as e:
                    yield row({"error": f"{type(e).__name__}: {e}"})

    return files.select(*keys, content).mapInArrow(run, _shape(files, keys, more))


def relationships(files: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """(keys, rel_id, kind, target, external, error): the relationships of each .docx file's document. A file that is none has one row with an error."""
    kind = pa.schema([("rel_id", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("external", pa.bool_()), ("error", pa.string())])
    return _per_file(files, content, keys, "rel_id string, kind string, target string, external boolean, error string", kind, _relations)


def word_images(files: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """(keys, image_index, rel_id, part, image, error, image_name, image_file, image_path) of each inline image, in document order.

    An image that is placed twice comes twice. What cannot be read, such as a linked image or a missing part, has a null
    image and index and an error, and does not end its file; the others are numbered without it. Word knows no pages:
    all are named as images of page 0.
    """

    def read(package: zipfile.ZipFile) -> Iterator[dict]:
        known = {r["rel_id"]: r for r in _relations(package)}
        number = 0
        for inline in ElementTree.fromstring(package.read("word/document.xml")).iter(_INLINE):
            blip = inline.find(f".//{_A}blip")
            if blip is None:
                continue
            ident = blip.get(f"{_R}embed") or blip.get(f"{_R}link")
            relation = known.get(ident)
            row = {"rel_id": ident, "part": relation and relation["target"]}
            if relation is None or relation["external"]:
                yield row | {"error": "no relationship" if relation is None else "the image is not in the package"}
                continue
            try:
                data = package.read(relation["target"])
            except BROKEN as e:
                yield row | {"error": f"{type(e).__name__}: {e}"}
                continue
            yield row | {"image_index": number, "image": data}
            number += 1

    kind = pa.schema([("image_index", pa.int32()), ("rel_id", pa.string()), ("part", pa.string()), ("image", pa.binary()), ("error", pa.string())])
    rows = _per_file(files, content, keys, "image_index int, rel_id string, part string, image binary, error string", kind, read)
    named = image_names(rows.withColumn("_page", F.lit("0")), "_page", "image_index").drop("_page")
    return named.withColumns({c: F.when(F.col("image_index").isNotNull(), F.col(c)) for c in ("image_name", "image_file", "image_path")})


def with_image_section(docs: DataFrame, images: DataFrame, *keys: str, markdown: str = "markdown") -> DataFrame:
    """The documents with a closing section that shows their images, in order; documents without an image stay as they are.

    Only names go through the shuffle, and a document's names meet in its row.
    """
    link = F.struct("image_index", F.concat(F.lit("!["), "image_name", F.lit("]("), "image_path", F.lit(")")).alias("link"))
    lists = images.where("image_index is not null").select(*keys, link.alias("l")).groupBy(*keys).agg(F.array_sort(F.collect_list("l")).alias("_links"))
    shown = F.concat_ws("\n\n", F.col(markdown), F.lit(SECTION), F.array_join(F.transform("_links", lambda x: x["link"]), "\n\n"))
    return docs.join(lists, list(keys), "left").withColumn(markdown, F.when(F.col("_links").isNotNull(), shown).otherwise(F.col(markdown))).drop("_links")
