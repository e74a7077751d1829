"""Calls of a costly backend, such as a language model: each different question once, kept for later runs, failures as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Takes some questions and returns their answers, as many; what it raises fails the whole call.
Call = Callable[[list[str]], list[str]]
_CACHE = "key string, answer string"


def known(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of a cache; none if nothing was kept there yet. Where two runs kept one question, the least answer counts."""
    try:
        rows = spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)
    return rows.groupBy("key").agg(F.min("answer").alias("answer"))


def called(questions: DataFrame, call: Call, batch: int = 16, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """(key, answer, error) for rows (key, question): calls with at most `batch` questions, repeated up to `retries` times.

    If a call still fails, its questions are asked one by one, so that one bad question does not take others with it; a
    question that fails has a null answer and an error. `wait` seconds pass before a repetition, twice as many each time.
    """

    def attempt(asked: list[str]) -> tuple[list[str | None], str | None]:
        error = None
        for i in range(retries + 1):
            if i and wait:
                time.sleep(wait * 2 ** (i - 1))
            try:
                found = call(asked)
                if len(found) == len(asked):
                    return list(found), None
                error = f"{len(found)} answers to {len(asked)} questions"
            except Exception as e:  # noqa: BLE001  whatever a backend raises ends its own questions alone
                error = f"{type(e).__name__}: {e}"
        return [None] * len(asked), error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.slice(i, batch)
                asked = part.column(1).to_pylist()
                found, error = attempt(asked)
                errors = [error] * len(asked)
                if error is not None and len(asked) > 1:
                    single = [attempt([q]) for q in asked]
                    found, errors = [a[0] for a, _ in single], [e for _, e in single]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(errors, pa.string())], names=["key", "answer", "error"])

    return questions.select("key", "question").mapInArrow(run, "key string, answer string, error string")


def ask(rows: DataFrame, question: str, call: Call, cache: str, batch: int = 16, retries: int = 2, wait: float = 0.0, parallel: int | None = None) -> DataFrame:
    """The rows with `answer` and `error`: what the backend says to the text in `question`.

    Each different question that the cache lacks is asked once, however many rows have it; answers are added to the
    cache (a Parquet folder that all executors share), failures are not, so that a later run asks again. At most
    `parallel` calls run at a time. A null question is not asked and has neither answer nor error. The calls are made
    here, not when the result is read, and a result that is read again asks nothing.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.col(question), 256))
    different = keyed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.first(question).alias("question"))
    asked = different.join(known(spark, cache).select("key"), "key", "left_anti")
    run = f"{cache}/_runs/{time.time_ns()}"  # hidden from readers of the cache by its name
    said = called(asked.repartition(parallel) if parallel else asked, call, batch, retries, wait)
    said.write.parquet(run)
    made = spark.read.parquet(run)
    made.where("error is null").select("key", "answer").write.mode("append").parquet(cache)
    failed = made.where("error is not null").select(F.col("key").alias("_key"), "error")
    answers = known(spark, cache).select(F.col("key").alias("_key"), "answer")
    return keyed.join(answers, "_key", "left").join(failed, "_key", "left").drop("_key")
