"""Files: routing by suffix, choosing the best extraction, pages, Word documents, readers of rules and review logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.functions.text import blank, strip

# Which processor a suffix has, and fonts that mark code.
PROCESSORS = {".pdf": "pdf", ".docx": "word", ".doc": "word", ".png": "ocr", ".jpg": "ocr", ".jpeg": "ocr", ".tiff": "ocr", ".bmp": "ocr"}
MONOSPACED = ["Courier New", "Consolas", "Courier"]


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a file name with its dot; '' without one. A leading dot is no suffix."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))


def route(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ext, processor and error: the processor of a suffix, or the message that the format is not supported. A null path is not found."""
    spark = files.sparkSession
    dim = spark.createDataFrame(sorted(PROCESSORS.items()), "ext string, processor string")
    keyed = files.withColumn("ext", suffix(F.coalesce(F.col(path), F.lit(""))))
    error = F.when(F.col(path).isNull(), F.lit("File not found")).when(F.col("processor").isNull(), F.concat(F.lit("Unsupported file format: "), F.col("ext")))
    return keyed.join(F.broadcast(dim), "ext", "left").withColumn("error", error)  # eight rows


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def pages(docs: DataFrame, text: str = "markdown", *keys: str) -> DataFrame:
    """(keys, page, text, has_text): an extractor's output split at its page marks, from page 0."""
    rows = docs.select(*keys, F.posexplode(F.split(F.col(text), "\n---\n")).alias("page", "text"))
    return rows.withColumn("has_text", ~blank(F.col("text")))


def best_extraction(extracted: DataFrame, key: str, text: str = "text", rank: str = "method_rank") -> DataFrame:
    """Of each document the longest text, of equally long ones the method of the lowest rank. A null text only stays if there is no other."""
    names = [c for c in extracted.columns if c != key]
    size = F.coalesce(F.length(text), F.lit(-1))
    picked = extracted.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(size, -F.col(rank))).alias("r"))
    return picked.select(key, "r.*")


def needs_ocr(pages_: DataFrame, key: str, text: str = "text", least: int = 100, method: str | None = None) -> DataFrame:
    """(key, pages, avg_chars, needs_ocr): whether the pages have under `least` characters on average.

    With a column `method`, a document that the layout model `marker` has read needs none, whatever it has found.
    """
    marked = F.lit(False) if method is None else F.coalesce(F.max(F.col(method) == "marker"), F.lit(False))
    rows = pages_.groupBy(key).agg(F.count("*").alias("pages"), F.avg(F.length(text)).alias("avg_chars"), marked.alias("_marked"))
    return rows.withColumn("needs_ocr", (F.col("avg_chars") < least) & ~F.col("_marked")).drop("_marked")


def inline(runs: Column) -> Column:
    """Runs (text, bold, italic, font) as Markdown: bold inside italic inside code, without separators."""

    def one(r: Column) -> Column:
        t = F.when(r["bold"], F.concat(F.lit("**"), r["text"], F.lit("**"))).otherwise(r["text"])
        t = F.when(r["italic"], F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t)
        return F.when(r["font"].isin(*MONOSPACED), F.concat(F.lit("`"), t, F.lit("`"))).otherwise(t)

    return F.array_join(F.transform(F.filter(runs, lambda r: F.coalesce(r["text"], F.lit("")) != ""), one), "")


def paragraph(style: Column, runs: Column) -> Column:
    """A Word paragraph as Markdown: headings, list items, code by its first font, else inline formats; '' if it is blank."""
    text = strip(F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), ""))
    level = F.regexp_extract(style, r"(\d+)\s*$", 1).try_cast("int")
    style = F.coalesce(style, F.lit(""))
    return (
        F.when(text == "", F.lit(""))
        .when(style.startswith("Heading") & level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(style.startswith("List") & style.contains("Bullet"), F.concat(F.lit("- "), text))
        .when(style.startswith("List") & style.contains("Number"), F.concat(F.lit("1. "), text))
        .when(F.get(runs, F.lit(0))["font"].isin(*MONOSPACED), F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .otherwise(inline(runs))
    )


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table, the first as its header; '' without rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    head = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise(F.lit(""))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RUN = "struct<text:string,bold:boolean,italic:boolean,font:string>"
WORD = f"paragraphs array<struct<style:string,runs:array<{RUN}>>>, tables array<array<array<string>>>, images bigint, error string"


def _runs(node) -> list[dict]:
    out = []
    for r in node.iter(f"{_W}r"):
        props = r.find(f"{_W}rPr")
        on = lambda tag, props=props: props is not None and (x := props.find(f"{_W}{tag}")) is not None and x.get(f"{_W}val", "1") not in ("0", "false")
        fonts = props.find(f"{_W}rFonts") if props is not None else None
        out.append({"text": "".join(t.text or "" for t in r.iter(f"{_W}t")), "bold": on("b"), "italic": on("i"), "font": fonts.get(f"{_W}ascii") if fonts is not None else None})
    return out


def word_parts(content: bytes) -> dict:
    """Paragraphs outside of tables, then tables, of a .docx file; heading styles are named by their names."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else s.get(f"{_W}styleId")
        images = sum(n.startswith("word/media/") for n in z.namelist())
    found = []
    for p in body.findall(f"{_W}p"):
        props = p.find(f"{_W}pPr")
        style = props.find(f"{_W}pStyle") if props is not None else None
        ident = style.get(f"{_W}val") if style is not None else "Normal"
        name = names.get(ident, ident)
        found.append({"style": name[:1].upper() + name[1:], "runs": _runs(p)})
    tables = [[["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return {"paragraphs": found, "tables": tables, "images": images, "error": None}


def read_word(files: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """(keys, markdown, paragraphs, tables, images, headings, error) of .docx files: all paragraphs, then all tables. A file that is none has an error."""
    shape = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    kind = pa.schema([("paragraphs", pa.list_(pa.struct([("style", pa.string()), ("runs", pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("font", pa.string())])))]))), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("images", pa.int64()), ("error", pa.string())])

    def safe(data: bytes | None) -> dict:
        try:
            return word_parts(data or b"")
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
            return {"paragraphs": [], "tables": [], "images": 0, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):  # a file may be large
                part = pa.RecordBatch.from_pylist([safe(b.column(len(keys))[i].as_py())], kind)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in range(len(keys))), *part.columns], names=[*keys, *kind.names])

    parts = files.select(*keys, content).mapInArrow(run, f"{shape}, {WORD}")
    texts = F.filter(F.concat(F.transform("paragraphs", lambda p: paragraph(p["style"], p["runs"])), F.transform("tables", table_markdown)), lambda t: t != "")
    level = lambda n: F.size(F.filter("paragraphs", lambda p: p["style"] == f"Heading {n}"))
    headings = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f"h{n}") for n in range(1, 7)]), F.array(*[level(n) for n in range(1, 7)])), lambda _, v: v > 0)
    return parts.select(*keys, F.array_join(texts, "\n\n").alias("markdown"), F.size("paragraphs").alias("paragraphs"), F.size("tables").alias("tables"), "images", headings.alias("headings"), "error")


#: Takes rows with binary content and returns them with text; a hook for optical recognition or layout extraction.
Extractor = Callable[[DataFrame], DataFrame]


def without_extractor(files: DataFrame) -> DataFrame:
    """The answer where no extractor is installed: no text, and an error that says so."""
    return files.withColumn("text", F.lit("")).withColumn("error", F.lit("no extractor is installed"))


def read_review_log(spark: SparkSession, path: str) -> DataFrame:
    """A queue or training log as JSON lines."""
    return spark.read.json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A style configuration as one JSON document."""
    return spark.read.option("multiLine", True).json(path)
