"""Forward and reverse merge of a field table and a country panel through a name map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.operators import aggregates, clean, joins


def forward_merge(
    parcels: DataFrame, panel: DataFrame, mapping: Mapping, crop: str, item: str,
    means: Mapping[str, str], median: str, median_into: str, factor: float = 10_000,
) -> DataFrame:
    """Every field row with the reference profile of its crop; rows without a counterpart
    keep NULLs, and no row is added or lost."""
    profile = aggregates.reference_profile(panel, item, means, median, median_into, factor)
    profile = clean.rename_columns(profile, {item: "crop_harmonized"})
    mapped = clean.map_values(parcels, crop, mapping, "crop_harmonized")
    return joins.enrich_left(mapped, profile, "crop_harmonized")


def reverse_merge(
    panel: DataFrame, parcels: DataFrame, mapping: Mapping, crop: str, item: str,
    means: Mapping[str, str], target: str, into: str, factor: float = 10_000,
) -> DataFrame:
    """Every distinct panel row with the field profile of its item and its target in the
    field table's unit."""
    distinct = clean.drop_exact_duplicates(panel)
    mapped = clean.map_values(parcels, crop, mapping, "_item")
    profile = clean.rename_columns(aggregates.parcel_profile(mapped, "_item", means), {"_item": item})
    return clean.scale_unit(joins.enrich_left(distinct, profile, item), target, factor, into)


def enrichment_coverage(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    overall = joins.coverage(df, column).withColumns({k: F.lit(None).cast("string") for k in by})
    return joins.stack_results([overall, joins.coverage(df, column, by)])
