"""Texts for a model backend, as columns: only what a backend is plugged in for is ever built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a chunk, of a document and of an error list that a prompt shows.
CHUNK, DOCUMENT, ERRORS = 1500, 5000, 1000
SHOWN = ("imperative_verbs", "action_verbs", "has_numbered_list", "has_bullet_list", "has_table", "has_definition", "is_statements", "word_count", "code_blocks")
_SHAPE = '{"type": "Task|Concept|Reference", "confidence": 0..1, "scores": {"Task": 0..1, "Concept": 0..1, "Reference": 0..1}, "reasoning": "..."}'
_FIELDS = {"Task": "title, steps (each with cmd)", "Concept": "title, introduction, sections (each with id and content)", "Reference": "title, properties or table (columns, rows) or sections"}


def classification(title: Column, content: Column | None = None) -> Column:
    """Asks for a chunk's type; shows its features and the first CHUNK characters."""
    content = F.col("content") if content is None else content
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), F.col(name).cast("string")) for name in SHOWN])
    return F.concat(F.lit("Decide whether this text instructs (Task), explains (Concept) or lists facts to look up (Reference).\n\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(content, 1, CHUNK), F.lit("\n\nMeasured:\n"), facts, F.lit(f"\n\nAnswer with this JSON alone: {_SHAPE}"))


def structuring(kind: Column, title: Column, content: Column) -> Column:
    """Asks for a typed record of a chunk as JSON."""
    fields = F.lit("title")
    for name, text in _FIELDS.items():
        fields = F.when(kind == name, F.lit(text)).otherwise(fields)
    return F.concat(F.lit("Turn this text into one JSON object with the fields "), fields, F.lit(".\n\nTitle: "), title, F.lit("\n\n"), F.substring(content, 1, DOCUMENT))


def repairing(xml: Column, errors: Column) -> Column:
    """Asks for a repaired topic; lists its errors."""
    listed = F.substring(F.array_join(F.transform(errors, lambda e: F.concat_ws(" ", e["type"], e["element"], e["id"])), "\n"), 1, ERRORS)
    return F.concat(F.lit("Repair this topic so that these errors vanish, and answer with the XML alone.\n\n"), listed, F.lit("\n\n"), F.substring(xml, 1, DOCUMENT))
