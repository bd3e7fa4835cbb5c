"""Daily aggregate joined with daily weather: the analysis panel and its coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.functions.parsing import clean_key
from panelshock.spec import DEFAULT, PanelSpec

MATCH = "weather_match"
# Columns of the joined panel, in order.
PANEL_COLUMNS = (
    "date", "MCT_SGG_CD", "MCT_RY_CD", "TS_AT", "USE_CNT", "avg_price",
    "heatwave", "heavy_rain", "cold_wave", "avg_temp", "min_temp", "max_temp", "rainfall",
    "rain_observation_hours", "rain_valid_hours", "rainfall_complete",
    "rain_3h_max_mm", "rain_3h_valid_windows",
)


def normalise_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys as trimmed text."""
    return df.withColumns({c: clean_key(c) for c in columns})


def join_weather(card: DataFrame, weather: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Left join of many card rows to one weather row, with a match indicator.

    The weather side is one row per date and region. No hint is given: the planner
    broadcasts it only when its size is under the session's threshold, and AQE splits hot
    (date, region) pairs otherwise."""
    return card.join(weather.withColumn(MATCH, F.lit(True)), [spec.date, spec.region], "left").withColumn(
        MATCH, F.coalesce(MATCH, F.lit(False))
    )


def panel_columns(joined: DataFrame) -> DataFrame:
    return joined.select(*PANEL_COLUMNS)


def unmatched_keys(card: DataFrame, weather: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Distinct (date, region) pairs of the card table without weather. Distinct first, so
    the join sees one row per pair."""
    pairs = card.select(spec.date, spec.region).distinct()
    return pairs.join(weather.select(spec.date, spec.region), [spec.date, spec.region], "left_anti")


def match_report(joined: DataFrame, flag: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per region, the NULL region included: rows, matched rows, match rate and event dates."""
    per_day = joined.groupBy(spec.region, spec.date).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(MATCH).alias("m"),
        F.max(F.when(F.col(flag) == 1, 1)).alias("event"),
    )
    return per_day.groupBy(spec.region).agg(
        F.sum("n").alias("rows"),
        F.sum("m").alias("matched_rows"),
        (F.sum("m") / F.sum("n")).alias("match_rate"),
        F.count("event").alias("event_dates"),
    )


def row_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, the NULL group included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def coverage_report(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row: dates, calendar length, series, series with missing dates, rows per date."""
    per_date = panel.groupBy(spec.date).agg(F.count(F.lit(1)).alias("n"))
    dates = per_date.agg(
        F.min(spec.date).alias("min_date"),
        F.max(spec.date).alias("max_date"),
        F.count(F.lit(1)).alias("dates"),
        F.min("n").alias("min_rows_per_date"),
        F.max("n").alias("max_rows_per_date"),
    ).withColumn("calendar_days", F.datediff("max_date", "min_date") + 1)
    lengths = panel.groupBy(*spec.entity).agg(F.count(F.lit(1)).alias("n"))
    calendar = dates.select("calendar_days").scalar()
    series = lengths.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") < calendar).alias("short"))
    return dates.select(
        "*",
        series.select("all").scalar().alias("series"),
        series.select("short").scalar().alias("series_with_missing_dates"),
    )


def densify(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Every series on every day of the panel's calendar, NULL where no row exists."""
    bounds = panel.agg(F.min(spec.date).alias("lo"), F.max(spec.date).alias("hi")).select(
        F.sequence("lo", "hi").alias("days")
    )
    grid = panel.select(*spec.entity).distinct().select(*spec.entity, F.explode(bounds.scalar()).alias(spec.date))
    return grid.join(panel.select(*spec.key, spec.measure), list(spec.key), "left")
