"""Reading and writing tables with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tilth.functions.columns import col

CORRUPT = "_corrupt_record"


def require_columns(df: DataFrame, required: Sequence[str], origin: str = "table") -> DataFrame:
    """Fail before any job runs, naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{origin} lacks the columns {missing}")
    return df


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    required: Sequence[str] | None = None,
    fmt: str | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV (with header), JSON lines, ORC or parquet; text formats need a declared schema.

    A CSV is checked by its own header line, so a renamed or absent column is reported
    instead of being read as NULLs; columns are then taken by name.  In a folder every
    file's header is compared with the first one's, and reading a file of other columns or
    another order fails.
    """
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith("." + f)), "parquet")
    if fmt in ("parquet", "orc"):
        df = spark.read.format(fmt).load(path)
        return require_columns(df, required or [], path)
    if schema is None:
        raise ValueError(f"{fmt} needs a declared schema")
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("mode", "PERMISSIVE")
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        absent = [f.name for f in declared if f.name not in header]
        lost = [c for c in (required or []) if c not in header]
        if absent or lost:
            raise ValueError(f"{path} lacks the columns {sorted(set(absent + lost))}")
        by_name = {f.name: f for f in declared}
        in_file_order = [by_name.get(c, T.StructField(c, T.StringType())) for c in header]
        reader = reader.option("header", True).option("enforceSchema", False)
    else:
        in_file_order = list(declared.fields)
    names = declared.fieldNames()
    if keep_corrupt:
        in_file_order = [*in_file_order, T.StructField(CORRUPT, T.StringType())]
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        names = [*names, CORRUPT]
    df = reader.schema(T.StructType(in_file_order)).format(fmt).load(path)
    return require_columns(df.select(*[col(c) for c in names]), required or [], path)


def write_table(
    df: DataFrame,
    path: str,
    cols: Sequence[str] | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> str:
    """Projected table to files; a split or year column makes a prunable partitioning."""
    out = df.select(*[col(c) for c in cols]) if cols else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
