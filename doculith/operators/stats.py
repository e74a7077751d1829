"""Statistics of classified chunks, the review queue and human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doculith.operators.classify import TYPES


def type_distribution(chunks: DataFrame, key: str) -> DataFrame:
    """(key, type, chunks, average_confidence): counts, and means that leave out rows still under review."""
    known = F.when(F.col("type") != "needs_review", F.col("confidence"))
    return chunks.groupBy(key, "type").agg(F.count("*").alias("chunks"), F.avg(known).alias("average_confidence"))


def summary(chunks: DataFrame, key: str) -> DataFrame:
    """One row per document: chunks, mean confidence (0.0 if none is known) and rows of type needs_review."""
    known = F.when(F.col("type") != "needs_review", F.col("confidence"))
    review = F.count(F.when(F.col("type") == "needs_review", 1))
    return chunks.groupBy(key).agg(F.count("*").alias("total_chunks"), F.coalesce(F.avg(known), F.lit(0.0)).alias("overall_avg_confidence"), review.alias("needs_review"))


def dominant_type(chunks: DataFrame, key: str) -> DataFrame:
    """(key, dominant_type): the commonest type, of equally common ones that of the earliest chunk."""
    counted = chunks.groupBy(key, "type").agg(F.count("*").alias("n"), F.min("chunk_no").alias("first"))
    return counted.groupBy(key).agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("dominant_type"))


def queue(chunks: DataFrame) -> DataFrame:
    """The chunks that need a human: content cut to 500 characters, what the two classifiers said, status pending."""
    short = F.when(F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))).otherwise(F.col("content"))
    keep = [c for c in ("doc_id", "chunk_no", "id", "title") if c in chunks.columns]
    said = [F.col(c) for c in ("t1_type", "t1_confidence", "t2_type", "t2_confidence") if c in chunks.columns]
    return chunks.where("needs_review").select(*keep, short.alias("content"), *said, F.lit("pending").alias("status"))


def marked_for_review(chunks: DataFrame) -> DataFrame:
    """The chunks with the answer that stands until a human decides: type needs_review, confidence 0 and even scores."""
    # The scores of a chunk under review.
    return chunks.withColumns({"type": F.lit("needs_review"), "confidence": F.lit(0.0), **{t.lower(): F.lit(0.33) for t in TYPES}})


def labelled(items: DataFrame, labels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The queue with human_label and status reviewed where a valid label exists; of several the last by `order` counts.

    `labels` has the keys, human_label and `order`.
    """
    valid = labels.where(F.col("human_label").isin(*TYPES)).groupBy(*keys).agg(F.max_by("human_label", order).alias("human_label"))
    joined = items.drop("human_label").join(valid, keys, "left")
    return joined.withColumn("status", F.when(F.col("human_label").isNotNull(), F.lit("reviewed")).otherwise(F.col("status")))


def training_set(items: DataFrame) -> DataFrame:
    """The reviewed rows as training examples."""
    keep = [c for c in ("t1_type", "t1_confidence", "t2_type", "t2_confidence") if c in items.columns]
    keys = [c for c in ("doc_id", "chunk_no") if c in items.columns]
    return items.where("status = 'reviewed'").select(*keys, "title", "content", F.col("human_label").alias("label"), *keep)


def review_stats(items: DataFrame) -> DataFrame:
    """One row: items, pending, reviewed and training examples."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return items.agg(F.count("*").alias("total"), of("pending").alias("pending"), of("reviewed").alias("reviewed"), of("reviewed").alias("training_size"))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key of an append-only log."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
