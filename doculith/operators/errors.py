"""Collected errors of the stages as columns: each an (component, code, message, is_warning) struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "array<struct<component:string,code:string,message:string,is_warning:boolean>>"


def error(component: str, code: str, message: Column, warning: bool = False) -> Column:
    return F.struct(F.lit(component).alias("component"), F.lit(code).alias("code"), message.cast("string").alias("message"), F.lit(warning).alias("is_warning"))


def from_texts(messages: Column) -> Column:
    """Plain messages as errors of no known component."""
    return F.transform(messages, lambda m: error("converter", "LEGACY_ERROR", m))


def collected(rows: DataFrame, column: str = "errors") -> DataFrame:
    """Adds error_count, warning_count, has_errors and has_warnings."""
    found = F.coalesce(F.col(column), F.array().cast(ERROR))
    warnings = F.size(F.filter(found, lambda e: e["is_warning"]))
    return rows.withColumns({"error_count": F.size(found) - warnings, "warning_count": warnings, "has_errors": F.size(found) > warnings, "has_warnings": warnings > 0})
