"""A training corpus from `documents`: toxic texts go, near copies and benchmark leaks go, personal data is masked,
sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet into the cluster's shared
folder and hands what it reads back to the next stage. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from doculith.llm.common import remove_folder, shared_folder, table
from doculith.llm.queries import WEIGHTS

#: Near copies share at least this many of a hundred shingles of so many words.
SHINGLE, PERCENT = 5, 80
#: The scores from which a text is toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled rows among them, scores under TOXIC; empty and null texts stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest id, each row judged by its own text. Rows without a word stay."""
    return jaccard_join.keep_first(docs, SHINGLE, PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; each span of personal data is replaced by its kind, and n_chars follows the text."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target weight asks, in a hashed order; mix_copies, mix_copy and mix_key are added."""
    return mixing.mix(docs, WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("mix_sources", mix_sources),
]

#: The classifier of the first stage is fitted, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that STAGES make of `documents`. A stage's rows are deleted when the next has been written; the last stay."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
        if number:
            remove_folder(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
