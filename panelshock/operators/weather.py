"""Warnings and hourly observations to the daily weather table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.functions.parsing import clean_text, lookup, tolerant_double
from panelshock.functions.scalars import exposure_flag
from panelshock.operators.audits import duplicate_keys

# Column names and codes of the warning files, and the columns of the result.
DAY, STATION = "일시", "지점"
HEAT_FLAG, HEAT_STATUS, HEAT_FORECAST = "폭염여부(O/X)", "폭염특보(O/X)", "폭염영향예보(단계)"
HEAT_TEMPERATURES = {"avg_temp": "평균기온(°C)", "min_temp": "최저기온(°C)", "max_temp": "최고기온(°C)"}
COLD_STATUS, COLD_FORECAST = "한파특보(O/X)", "한파영향예보(단계)"
COLD_TEMPERATURES = {"avg_temp": "일평균기온(°C)", "min_temp": "일최저기온(°C)", "max_temp": "일최고기온(°C)"}
HEAT_COLUMNS = (DAY, STATION, HEAT_FLAG, HEAT_STATUS, HEAT_FORECAST, *HEAT_TEMPERATURES.values())
COLD_COLUMNS = (DAY, STATION, COLD_STATUS, COLD_FORECAST, *COLD_TEMPERATURES.values())
HEAT_FLAGS = {"O": 1, "X": 0}
COLD_LEVELS = {"X": 0, "주의보": 1, "경보": 1}
DAILY_COLUMNS = (
    "date", "MCT_SGG_CD", "heatwave", "heat_alert_status", "heat_impact_forecast", "heavy_rain",
    "cold_wave", "cold_alert_status", "cold_impact_forecast", "avg_temp", "min_temp", "max_temp",
    "rainfall", "rain_observation_hours", "rain_valid_hours", "rainfall_complete",
)
RAIN_THRESHOLD_MM = 60.0
RAIN_QUANTILES = {"q90": 0.90, "q95": 0.95, "q99": 0.99}


def at_stations(df: DataFrame, stations: dict[str, str], region: str = "MCT_SGG_CD") -> DataFrame:
    """Rows of the mapped station labels (trimmed), with their region. The mapping is a
    small literal, so no join is needed."""
    return df.withColumn(region, lookup(clean_text(F.col(STATION)), stations)).where(F.col(region).isNotNull())


def _mapped(value: Column, codes: dict[str, int], column: str, null_allowed: bool) -> Column:
    code = lookup(value, codes)
    bad = code.isNull() & value.isNotNull() if null_allowed else code.isNull()
    problem = F.concat(F.lit(f"unexpected value in {column}: "), F.coalesce(value, F.lit("NULL")))
    return F.when(bad, F.raise_error(problem).cast("int")).otherwise(code)


def heat_warnings(raw: DataFrame, stations: dict[str, str]) -> DataFrame:
    """Flag, status, forecast and temperatures per date and region. A flag other than O or X,
    a missing one included, fails the job."""
    return at_stations(raw, stations).select(
        F.to_date(DAY).alias("date"),
        "MCT_SGG_CD",
        _mapped(clean_text(HEAT_FLAG), HEAT_FLAGS, HEAT_FLAG, null_allowed=False).alias("heatwave"),
        clean_text(HEAT_STATUS).alias("heat_alert_status"),
        clean_text(HEAT_FORECAST).alias("heat_impact_forecast"),
        *[tolerant_double(c).alias(name) for name, c in HEAT_TEMPERATURES.items()],
    )


def cold_warnings(raw: DataFrame, stations: dict[str, str]) -> DataFrame:
    """As ``heat_warnings``; both alert levels count as 1 and a missing status stays missing."""
    return at_stations(raw, stations).select(
        F.to_date(DAY).alias("date"),
        "MCT_SGG_CD",
        _mapped(clean_text(COLD_STATUS), COLD_LEVELS, COLD_STATUS, null_allowed=True).alias("cold_wave"),
        clean_text(COLD_STATUS).alias("cold_alert_status"),
        clean_text(COLD_FORECAST).alias("cold_impact_forecast"),
        *[tolerant_double(c).alias(name) for name, c in COLD_TEMPERATURES.items()],
    )


def missing_stations(raw: DataFrame, stations: dict[str, str], file: str) -> DataFrame:
    """(file, region) pairs without a row: every file must cover every station."""
    regions = sorted(set(stations.values()))
    seen = raw.select(file, lookup(clean_text(F.col(STATION)), stations).alias("region"))
    found = seen.groupBy(file).agg(F.collect_set("region").alias("found"))
    wanted = F.array(*[F.lit(r) for r in regions])
    return found.select(file, F.explode(F.array_except(wanted, "found")).alias("region"))


def warnings_union(heat: DataFrame, cold: DataFrame) -> DataFrame:
    """Heat and cold rows in one table; columns of the other hazard are NULL."""
    return heat.unionByName(cold, allowMissingColumns=True)


def hourly_observations(
    raw: DataFrame, station: str, timestamp: str, rain: str, stations: dict[str, str]
) -> DataFrame:
    """(region, date, hour, rain): one row per station and hour. Unknown stations are skipped;
    blank rain stays missing."""
    ts = F.col(timestamp).cast("timestamp_ntz")
    return (
        raw.withColumn("region", lookup(clean_text(F.col(station).cast("string")), stations))
        .where(F.col("region").isNotNull())
        .select("region", F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), tolerant_double(rain).alias("rain"))
    )


def unknown_stations(raw: DataFrame, station: str, stations: dict[str, str]) -> DataFrame:
    """Station ids outside the mapping, with their rows."""
    known = lookup(clean_text(F.col(station).cast("string")), stations)
    return raw.where(known.isNull()).groupBy(station).agg(F.count(F.lit(1)).alias("rows"))


def regions_without_hours(hourly: DataFrame, regions: Sequence[str]) -> DataFrame:
    listed = hourly.sparkSession.createDataFrame([(r,) for r in regions], "region string")
    return listed.join(hourly.select("region").distinct(), "region", "left_anti")


def duplicate_hours(hourly: DataFrame) -> DataFrame:
    return duplicate_keys(hourly, ["region", "date", "hour"])


def daily_rain(hourly: DataFrame) -> DataFrame:
    """Daily rain, summed only when all 24 hours are there and valid."""
    observed = F.count(F.lit(1))
    valid = F.count("rain")
    hours_seen = F.bit_count(F.bit_or(F.expr("shiftleft(1, hour)")))
    complete = (observed == 24) & (valid == 24) & (hours_seen == 24)
    return hourly.groupBy("region", "date").agg(
        F.when(complete, F.sum("rain")).cast("double").alias("rainfall"),
        observed.cast("int").alias("rain_observation_hours"),
        valid.cast("int").alias("rain_valid_hours"),
        complete.cast("int").alias("rainfall_complete"),
    )


def rain_thresholds(daily: DataFrame, quantiles: dict[str, float] = RAIN_QUANTILES) -> DataFrame:
    """Quantiles of complete days per region and the days at or above each. A region has one
    row per calendar day, which bounds the group of ``percentile``."""
    complete = daily.where("rainfall_complete = 1")
    levels = complete.groupBy("region").agg(
        F.percentile("rainfall", [float(q) for q in quantiles.values()]).alias("levels")
    )
    named = levels.select("region", *[F.col("levels")[i].alias(n) for i, n in enumerate(quantiles)])
    return (
        complete.join(named, "region")
        .groupBy("region", *quantiles)
        .agg(
            F.count(F.lit(1)).alias("complete_days"),
            *[F.count_if(F.col("rainfall") >= F.col(n)).alias(f"days_from_{n}") for n in quantiles],
        )
    )


def rolling_exposure(hourly: DataFrame, threshold: float = RAIN_THRESHOLD_MM, hours: int = 3) -> DataFrame:
    """Daily exposure from sums over ``hours`` consecutive valid hours.

    A window belongs to the day of its last hour. The frame runs over an hour number, so a
    missing hour breaks it. Days without a row between the first and last day of a region
    appear with no valid window: each day unfolds over the gap to the next one. One exchange
    by region serves the frames, the daily fold and the gaps."""
    hour_number = F.unix_date("date") * 24 + F.col("hour")
    frame = W.partitionBy("region").orderBy("hour_number").rangeBetween(-(hours - 1), 0)
    windows = hourly.withColumn("hour_number", hour_number).select(
        "region",
        "date",
        "rain",
        F.when(F.count("rain").over(frame) == hours, F.sum("rain").over(frame)).alias("window_sum"),
    )
    days = windows.groupBy("region", "date").agg(
        F.max("window_sum").alias("rain_3h_max_mm"),
        F.count("window_sum").cast("int").alias("rain_3h_valid_windows"),
        F.count("rain").alias("valid_hours"),
    )
    following = F.lead("date").over(W.partitionBy("region").orderBy("date"))
    until = F.coalesce(F.date_sub(following, 1), F.col("date"))
    filled = days.withColumn("until", until).select(
        "*", F.explode(F.sequence("date", "until")).alias("day")
    )
    observed = F.col("day") == F.col("date")
    peak = F.when(observed, F.col("rain_3h_max_mm"))
    return filled.select(
        "region",
        F.col("day").alias("date"),
        exposure_flag(peak, threshold, observed & (F.col("valid_hours") == 24)).alias("heavy_rain"),
        peak.cast("double").alias("rain_3h_max_mm"),
        F.when(observed, F.col("rain_3h_valid_windows")).otherwise(0).alias("rain_3h_valid_windows"),
    )


def calendar_spine(df: DataFrame, date: str, regions: Sequence[str], region: str = "MCT_SGG_CD") -> DataFrame:
    """Every day from the first to the last date of ``df`` for every listed region.

    The calendar is a scalar, and each region unfolds it: the listed regions are spread over
    tasks and no join is needed."""
    calendar = df.agg(F.sequence(F.min(date), F.max(date)).alias("days")).scalar()
    listed = df.sparkSession.createDataFrame([(r,) for r in regions], f"{region} string")
    return listed.select(F.explode(calendar).alias("date"), region)


def daily_weather(
    heat: DataFrame, cold: DataFrame, hourly: DataFrame, regions: Sequence[str], region: str = "MCT_SGG_CD"
) -> DataFrame:
    """Daily weather per region: calendar spine, warnings with temperatures, daily rain.

    No official heavy-rain rule exists at this stage, so ``heavy_rain`` is all NULL. Join
    sides are one row per date and region; the planner broadcasts them only below its
    threshold."""
    warnings = warnings_union(heat, cold)
    rain = daily_rain(hourly).withColumnRenamed("region", region)
    joined = calendar_spine(hourly, "date", regions, region)
    joined = joined.join(warnings, ["date", region], "left").join(rain, ["date", region], "left")
    return joined.withColumn("heavy_rain", F.lit(None).cast("int")).select(
        *[region if c == "MCT_SGG_CD" else c for c in DAILY_COLUMNS]
    )


def attach_exposure(weather: DataFrame, exposure: DataFrame, region: str = "MCT_SGG_CD") -> DataFrame:
    """Daily weather with the rolling exposure in place of the empty ``heavy_rain``."""
    return weather.drop("heavy_rain").join(
        exposure.withColumnRenamed("region", region), ["date", region], "left"
    )
