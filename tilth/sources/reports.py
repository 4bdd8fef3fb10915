"""Result tables and nested documents as CSV, JSON or one JSON text per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.functions.columns import col


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Write a (possibly nested) result table; CSV keeps nested values as JSON text."""
    if fmt == "csv":
        nested = [
            f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")
        ]
        flat = df.select(
            *[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in df.columns]
        )
        flat.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
    return path


def as_document(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text, NULL fields kept."""
    packed = F.struct(*[col(c) for c in df.columns])
    return df.select(F.to_json(packed, {"ignoreNullFields": "false"}).alias(name))


def write_document(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    as_document(df, "value").write.mode(mode).text(path)
    return path
