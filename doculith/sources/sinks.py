"""Sinks: tables and lines; files by name where they are asked for."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doculith.operators import quality
from doculith.operators.render import conversion_report


def write_topics(topics: DataFrame, path: str, key: str, file: str = "file_name", xml: str = "xml") -> None:
    """Topics as a Parquet table (doc, file, xml); rows without a topic are left out."""
    topics.where(F.col(xml).isNotNull()).select(F.col(key).cast("string").alias("doc"), F.col(file).alias("file"), F.col(xml).alias("xml")).write.mode("overwrite").parquet(path)


def write_markdown(docs: DataFrame, path: str, key: str, text: str = "markdown") -> None:
    """Texts as a Parquet table (doc, markdown); a null text is empty."""
    docs.select(F.col(key).cast("string").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("markdown")).write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines: analyses, reports, the review queue; `append` for logs."""
    rows.write.mode(mode).json(path)


def write_json_array(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Rows as JSON arrays, one whole array in each file; `files` is how many, else one a partition. Without rows there is one empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            lines = b.column(0).to_pylist()
            if lines:
                out = ["[" if held is None else held + ",", *(x + "," for x in lines[:-1])]
                held = lines[-1]
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[", "]"] if held is None else [held, "]"])], names=["value"])  # a partition without rows is an empty array

    if rows.isEmpty():
        rows.sparkSession.range(1).select(F.lit("[]").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    text = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))
    (text.coalesce(files) if files else text).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_conversion_report(converted: DataFrame, path: str) -> None:
    write_json(conversion_report(converted), path)


def export_files(rows: DataFrame, name: str, content: str, store, log: str | None = None) -> int:
    """Calls store(name, content) for each row, on the executors; returns how many calls succeeded.

    `store` must reach a shared place and overwrite, as a lost task runs again. With `log`, (name, error) of each
    row is written there as JSON lines, and the count is taken from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors: list[str | None] = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    store(n, c)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string())], names=["name", "error"])

    done = rows.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, error string")
    if log is not None:
        done.write.mode("overwrite").json(log)
        done = rows.sparkSession.read.schema("name string, error string").json(log)
    return done.agg(F.count(F.when(F.col("error").isNull(), 1))).first()[0]


def commit_files(rows: DataFrame, name: str, content: str, folder: str, log: str | None = None) -> DataFrame:
    """(name, bytes, error): writes each row's content (text or binary) as a file of a folder that all executors and the driver mount.

    Files are written under other names first, and Spark commits the list of those names with the attempts of tasks
    that succeeded. Only files of that list get their own names, each by one rename; a rename that was done before is
    no error. So a task that fails, runs again or runs twice leaves each file once and whole, and a job that fails
    before the renames leaves no file. Names may hold folders, but not lead out of `folder`; such a name, one that
    occurs twice and a null content give an error and no file. What was done is a Parquet table in `log`, by default
    beside the files; leftovers are removed at the end.
    """
    spark = rows.sparkSession
    stage, log = f"{folder}/_staged-{uuid.uuid4().hex}", log or f"{folder}/_log-{uuid.uuid4().hex}"
    kind = pa.schema([("name", pa.string()), ("staged", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])
    shape = "name string, staged string, bytes bigint, error string"

    def refused(own: str | None, data: bytes | None) -> str | None:
        if not own or own.endswith("/"):
            return "no name"
        if own.startswith("/") or ".." in own.split("/"):
            return "the name leads out of the folder"
        return "no content" if data is None else None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own, data = (b.column(k)[i].as_py() for k in (0, 1))
                row = {"name": own, "error": refused(own, data)}
                if row["error"] is None:
                    os.makedirs(stage, exist_ok=True)
                    row |= {"staged": f"{stage}/{uuid.uuid4().hex}", "bytes": len(data)}
                    with open(row["staged"], "wb") as f:
                        f.write(data)
                yield pa.RecordBatch.from_pylist([row], kind)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, staged, size, errors = (b.column(k).to_pylist() for k in range(4))
            for i, (name_, path, several) in enumerate(zip(own, staged, b.column(4).to_pylist(), strict=True)):
                if path is None:
                    continue
                target = f"{folder}/{name_}"
                try:
                    if several:
                        raise ValueError("the name occurs twice")
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.replace(path, target)
                except (OSError, ValueError) as e:
                    if not (isinstance(e, FileNotFoundError) and os.path.exists(target)):  # an earlier attempt renamed it
                        errors[i], size[i] = str(e), None
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(errors, pa.string())], names=["name", "bytes", "error"])

    try:
        asked = rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
        asked.mapInArrow(write, shape).write.parquet(f"{stage}/list")
        listed = spark.read.parquet(f"{stage}/list").withColumn("several", F.count("*").over(Window.partitionBy("name")) > 1)
        listed.mapInArrow(rename, "name string, bytes bigint, error string").write.parquet(log)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return spark.read.parquet(log)


def write_results(scored: DataFrame, key: str, store, formats: tuple[str, ...] = quality.FORMATS, embed: bool = True, log: str | None = None) -> int:
    """The files of checked topics in the formats asked for, by `store`; returns how many were stored."""
    return export_files(quality.outputs(scored, key, formats, embed), "name", "content", store, log)


def write_batch(scored: DataFrame, key: str, store, formats: tuple[str, ...] = quality.FORMATS, log: str | None = None) -> int:
    """As write_results, for the successful topics of a batch alone."""
    return write_results(scored.where("qa_success"), key, store, formats, log=log)
