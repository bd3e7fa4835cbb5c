"""Audits as DataFrames of violating rows: an empty result passes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcome and rain columns that must never be predictors.
FORBIDDEN_FEATURES = ("TS_AT", "USE_CNT", "avg_price", "Y", "heavy_rain", "rainfall")


def enforce(violations: DataFrame, message: str, examples: int = 5) -> None:
    """Raise with a few example rows when an audit is not empty."""
    found = violations.limit(examples).collect()
    if found:
        raise ValueError(f"{message}; examples={[r.asDict() for r in found]}")


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name}: missing columns {missing}; found {df.columns}")
    return df


def require_allowed_features(features: Iterable[str], columns: Iterable[str] | None = None) -> None:
    """Predictors must exist and must not carry the outcome."""
    features = list(features)
    forbidden = sorted(set(features) & set(FORBIDDEN_FEATURES))
    if forbidden:
        raise ValueError(f"forbidden features: {forbidden}")
    if columns is not None:
        absent = sorted(set(features) - set(columns))
        if absent:
            raise ValueError(f"features not in the table: {absent}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.where(missing)


def outside_domain(df: DataFrame, column: str, allowed: Sequence, null_allowed: bool) -> DataFrame:
    """Values outside the allowed set, with their row counts."""
    c = F.col(column)
    bad = (c.isNotNull() & ~c.isin(*allowed)) if null_allowed else (c.isNull() | ~c.isin(*allowed))
    return df.where(bad).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def mixed_station_files(df: DataFrame, file: str, station: str) -> DataFrame:
    """Files that hold more than one station, or rows without one."""
    return (
        df.groupBy(file)
        .agg(F.min(station).alias("first"), F.max(station).alias("last"), F.count_if(F.col(station).isNull()).alias("blank"))
        .where("first <> last or blank > 0")
    )


def unequal_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row when a join changed the number of rows."""
    counts = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return counts.agg(F.sum("b").alias("before"), F.sum("a").alias("after")).where(
        "coalesce(before, 0) <> coalesce(after, 0)"
    )


def varying_within(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups with more than one distinct non-null value: their minimum and maximum differ."""
    return (
        df.groupBy(*keys)
        .agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))
        .where("lowest < highest")
    )


def missing_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, missing) in one pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot("__rows", list(columns), "column", "missing").select(
        "column", F.col("__rows").alias("rows"), "missing"
    )


def count_rows_where(**conditions: Column) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]
