"""Checking records against closed vocabularies, inclusive bounds and field types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.functions.columns import col

WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Contract:
    """What a valid record looks like.  Every field named here is required."""

    vocabularies: dict[str, tuple[str, ...]] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    booleans: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys([*self.vocabularies, *self.bounds, *self.booleans, *self.integers]))

    def without(self, name: str) -> Contract:
        """The same contract for records that need not carry a field."""
        return Contract(
            {k: v for k, v in self.vocabularies.items() if k != name},
            {k: v for k, v in self.bounds.items() if k != name},
            tuple(b for b in self.booleans if b != name),
            tuple(i for i in self.integers if i != name),
        )

    def schema(self) -> T.StructType:
        """Declared schema of a record, for reading text sources."""
        kinds = {}
        for name in self.fields:
            if name in self.booleans:
                kinds[name] = T.BooleanType()
            elif name in self.integers:
                kinds[name] = T.IntegerType()
            elif name in self.bounds:
                kinds[name] = T.DoubleType()
            else:
                kinds[name] = T.StringType()
        return T.StructType([T.StructField(n, t) for n, t in kinds.items()])

    @staticmethod
    def from_bounds(document: dict, booleans=(), integers=()) -> Contract:
        """Contract from a collected bounds profile (true minimum and maximum)."""
        return Contract(
            {c: tuple(v) for c, v in document["categorical"].items()},
            {n: (r["valid_min"], r["valid_max"]) for n, r in document["numeric"].items()},
            tuple(booleans), tuple(integers),
        )


def reasons(df: DataFrame, contract: Contract) -> Column:
    """All violations of a row, as texts ``field:problem`` in field order."""
    kinds = dict(df.dtypes)
    found: list[Column] = []

    def note(condition: Column, text: str) -> None:
        found.append(F.when(condition, F.lit(text)))

    for name in contract.fields:
        if name not in kinds:
            found.append(F.lit(f"{name}:missing"))
            continue
        v, kind = col(name), kinds[name]
        note(v.isNull(), f"{name}:missing")
        if name in contract.vocabularies:
            known = v.cast("string").isin(list(contract.vocabularies[name]))
            note(v.isNotNull() & ~known, f"{name}:unknown value")
        if name in contract.booleans and kind != "boolean":
            note(v.isNotNull(), f"{name}:not a boolean")
        number = v if kind in (*WHOLE, "float", "double") or kind.startswith("decimal") else v.try_cast("double")
        if name in contract.bounds or name in contract.integers:
            note(v.isNotNull() & (number.isNull() | F.isnan(number.cast("double"))), f"{name}:not a number")
        if name in contract.integers and kind not in WHOLE:
            note(F.floor(number) != number, f"{name}:not a whole number")
        if name in contract.bounds:
            low, high = contract.bounds[name]
            note(number < F.lit(low), f"{name}:below {low}")
            note(~F.isnan(number.cast("double")) & (number > F.lit(high)), f"{name}:above {high}")
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def checked(df: DataFrame, contract: Contract) -> DataFrame:
    """All rows with the array ``reasons``, empty for valid ones: one pass, to be split on writing."""
    return df.withColumn("reasons", reasons(df, contract))


def validate(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with all their reasons); each runs the plan of ``df``, so stage
    what is dear, or take ``checked``."""
    every = checked(df, contract)
    return every.where(F.size("reasons") == 0).drop("reasons"), every.where(F.size("reasons") > 0)
