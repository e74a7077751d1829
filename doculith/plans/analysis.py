"""The stages put together: documents to chunks and types, chunks to topics, topics to scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doculith.operators import chunking, classify, features, quality, render, repair, structure
from doculith.operators.rules import Registry, load_style
from doculith.plans.progress import Progress


@dataclass(frozen=True)
class Options:
    """Settings of a run: characters of a chunk, a style configuration, files of a topic, and those of the classifiers and the loop."""

    chunk_size: int = chunking.SIZE
    rules: str | None = None
    formats: tuple[str, ...] = quality.FORMATS
    #: The weight of the rules, that of the model is the rest; the confidence from which the rules decide alone, and under which a chunk is reviewed.
    rule_weight: float = 0.3
    sure: float = 0.9
    review_below: float = 0.6
    #: Checks of a topic at most.
    passes: int = 3

    @classmethod
    def of(cls, spark: SparkSession) -> Options:
        """The session's doculith.chunkSize, .rules, .formats (separated by commas), .ruleWeight, .sure, .reviewBelow and .passes, or the defaults."""
        said = lambda k: spark.conf.get(f"doculith.{k}", None)
        number = lambda k, kind, default: default if said(k) is None else kind(said(k))
        formats = tuple(f.strip() for f in said("formats").split(",") if f.strip()) if said("formats") is not None else cls.formats
        out = cls(
            number("chunkSize", int, cls.chunk_size), said("rules"), formats,
            number("ruleWeight", float, cls.rule_weight), number("sure", float, cls.sure), number("reviewBelow", float, cls.review_below), number("passes", int, cls.passes),
        )
        wrong = [
            ("chunkSize must be positive", out.chunk_size < 1),
            (f"unknown formats in {said('formats')}", not set(formats) <= set(quality.FORMATS)),
            ("ruleWeight, sure and reviewBelow lie between 0 and 1", not all(0 <= x <= 1 for x in (out.rule_weight, out.sure, out.review_below))),
            ("passes must be positive", out.passes < 1),
        ]
        if any(bad for _, bad in wrong):
            raise ValueError("; ".join(text for text, bad in wrong if bad))
        return out


def analyse(docs: DataFrame, text: str = "markdown", backend: classify.Backend | None = None, size: int = chunking.SIZE, options: Options | None = None) -> DataFrame:
    """Chunks with features and their type; `options` name the classifiers' settings."""
    o = options or Options(chunk_size=size)
    return classify.hybrid(features.extract(chunking.chunk(docs, text, size)), backend, o.sure, o.rule_weight, o.review_below)


def convert(chunks: DataFrame) -> DataFrame:
    """Chunks with their record and topic. A chunk that cannot be converted has a null topic and an error; none ends the others."""
    recorded = structure.records(chunks)
    return render.render(structure.fix(recorded.withColumn("constraint_errors", structure.constraint_errors(F.col("type")))))


def assure(topics: DataFrame, xml: str = "xml", kind: str | None = "content_type", registry: Registry | None = None, passes: int = 3) -> DataFrame:
    """Topics with the outcome of the loop, of the style rules, scores, status and advice."""
    rules = registry or Registry()
    looped = repair.loop(topics, xml, kind, passes)
    return quality.recommendations(quality.status(quality.scores(rules.summary(rules.run(looped)))))


def end_to_end(docs: DataFrame, text: str = "markdown", options: Options | None = None, progress: Progress | None = None) -> DataFrame:
    """From documents to scored topics in one lazy plan; no file lies between the stages.

    With `progress`, the rows of each stage are counted while the plan runs: documents (failed: no text), chunks,
    topics (failed: no topic could be made), scored topics (failed: those that quality assurance does not pass).
    """
    o = options or Options()
    watch = progress.watch if progress is not None else lambda _, df, failed=None: df
    chunks = watch("chunks", analyse(watch("documents", docs, F.col(text).isNull()), text, size=o.chunk_size, options=o))
    topics = watch("topics", convert(chunks), F.col("xml").isNull()).withColumn("content_type", F.col("type"))
    scored = assure(topics.where(F.col("xml").isNotNull()), registry=Registry(load_style(docs.sparkSession, o.rules)), passes=o.passes)
    return watch("scored", scored, ~F.col("qa_success"))
