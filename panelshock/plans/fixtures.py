"""The given tables in the roles of the engine's inputs.

Every role is an aggregate or a row-wise expression over whole tables. Where an input needs
dirt, gaps or events, they follow from integer rules on the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelshock.operators import baseline, calendar, episodes, splits, weather
from panelshock.operators.flow import FLOW_COLUMNS
from panelshock.session import staged
from panelshock.spec import DEFAULT

REGION_ORDER = {"A": 0, "N": 1, "R": 2}
STATION_REGIONS = {"click": "R1", "view": "R2", "purchase": "R3", "error": "R4", "signup": "R5"}
FLOW_PREFIXES = {f"{k:05d}": "ANR"[k % 3] for k in range(20)}
RAIN_THRESHOLD = 800.0
# model, feature set, weights of temperature, lag 1, lag 7 and the 7-day mean
SCORERS = [
    (model, feature_set, 0.5 + 0.25 * m, *[w * (1 + m) for w in weights])
    for m, model in enumerate(("Linear Regression", "Ridge", "Random Forest"))
    for feature_set, weights in (
        ("A_weather_region_industry", (0.0, 0.0, 0.0)),
        ("B_plus_past_sales", (0.125, 0.0625, 0.03125)),
        ("C_plus_flow_population", (0.25, 0.03125, 0.0625)),
    )
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as raw transaction text with blank keys, bad dates and bad numbers."""
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.when(part % 211 == 0, "20250230")
        .otherwise(F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd"))
        .alias("TA_YMD"),
        F.when(part % 223 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).alias("MCT_SGG_CD"),
        F.col("l_linestatus").alias("MCT_RY_CD"),
        F.when(part % 97 == 0, "")
        .when(part % 101 == 0, "abc")
        .when(part % 103 == 0, "NaN")
        .otherwise(F.concat(F.lit(" "), money("l_extendedprice").cast("string"), F.lit(" ")))
        .alias("TS_AT"),
        F.when(part % 107 == 0, "0")
        .when(part % 109 == 0, "")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("USE_CNT"),
    )


def hazard_flag(hazard: str, date: str = "date", region: str = "MCT_SGG_CD") -> Column:
    day = F.datediff(F.col(date), F.lit("1995-01-01").cast("date"))
    k = F.when(F.col(region) == "A", 0).when(F.col(region) == "N", 1).otherwise(2)
    month = F.month(date)
    if hazard == "heatwave":
        flag = ((day + 3 * k) % 17 < 4).cast("int")
        return F.when(month.isin(7, 8, 9), flag).when(month.isin(5, 6), 0)
    return F.when(month.isin(11, 12), ((day + 5 * k) % 23 < 3).cast("int"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` per ship date, return flag (region) and line status (industry), with
    temperatures from discounts and event flags from the calendar rule."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_returnflag").alias("MCT_SGG_CD"),
        F.col("l_linestatus").alias("MCT_RY_CD"),
        money("l_extendedprice").alias("sale"),
        F.col("l_quantity").cast("long").alias("unit"),
        F.round(F.col("l_discount") * 100).cast("int").alias("d"),
    )
    cells = rows.groupBy("date", "MCT_SGG_CD", "MCT_RY_CD").agg(
        F.sum("sale").alias("TS_AT"),
        F.sum("unit").alias("USE_CNT"),
        F.count(F.lit(1)).alias("n"),
        F.sum("d").alias("d"),
        F.min("d").alias("d_min"),
        F.max("d").alias("d_max"),
    )
    # a (date, region) holds one row per industry of the panel
    day = W.partitionBy("date", "MCT_SGG_CD")
    columns = cells.select(
        "date",
        "MCT_SGG_CD",
        "MCT_RY_CD",
        "TS_AT",
        "USE_CNT",
        hazard_flag("heatwave").alias("heatwave"),
        hazard_flag("cold_wave").alias("cold_wave"),
        (F.sum("d").over(day).cast("double") / F.sum("n").over(day)).alias("avg_temp"),
        F.min("d_min").over(day).cast("double").alias("min_temp"),
        F.max("d_max").over(day).cast("double").alias("max_temp"),
    )
    return staged(columns)


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` per date, customer nation and market segment."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return (
        orders.join(customer, "o_custkey")
        .groupBy(
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("c_nationkey").cast("string").alias("MCT_SGG_CD"),
            F.col("c_mktsegment").alias("MCT_RY_CD"),
        )
        .agg(F.sum(money("o_totalprice")).alias("TS_AT"))
    )


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` per date and customer: as many series as customers."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderdate").cast("date").alias("date"),
            (F.col("o_custkey") % 7).cast("string").alias("MCT_SGG_CD"),
            F.col("o_custkey").cast("string").alias("MCT_RY_CD"),
        )
        .agg(F.sum(money("o_totalprice")).alias("TS_AT"))
    )


def split_dates(source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(date table with an arithmetic split of components, episodes, flags)."""
    flags = staged(episodes.daily_flags(source))
    found = episodes.find_episodes(flags)
    dates = episodes.week_components(flags, found)
    slot = (3 * F.col("component_no")) % 7
    split = F.when(slot < 5, "train").when(slot == 5, "validation").otherwise("test")
    return staged(dates.withColumn("split", split)), found, flags


def featured_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(panel with split, targets and calendar features, episodes)."""
    source = panel(spark, sf_dir)
    dates, found, _ = split_dates(source)
    assigned = splits.attach_split(source, dates)
    return calendar.add_calendar_features(baseline.add_targets(assigned)), found


def event_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(one row per hazard event with its target, baseline and features, episodes)."""
    featured, found = featured_panel(spark, sf_dir)
    cases = F.array(
        *[
            F.struct(
                F.lit(h).alias("disaster_type"),
                F.when(F.col(h) == 1, F.col(f"Y1_{h}")).alias("actual_y1"),
                F.col(f"baseline_{h}").alias("base"),
            )
            for h in DEFAULT.hazards
        ]
    )
    rows = featured.select("*", F.inline(cases)).where("actual_y1 is not null")
    return staged(rows), found


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fixed linear scorers over the event rows, episodes)."""
    rows, found = event_rows(spark, sf_dir)
    scorers = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"), F.lit(s).alias("feature_set"),
                F.lit(w0).alias("w0"), F.lit(w1).alias("w1"), F.lit(w7).alias("w7"), F.lit(wr).alias("wr"),
            )
            for m, s, w0, w1, w7, wr in SCORERS
        ]
    )
    base = F.col("base")
    moved = (
        F.col("w1") * (F.coalesce("lag1", base) - base)
        + F.col("w7") * (F.coalesce("lag7", base) - base)
        + F.col("wr") * (F.coalesce("rolling7", base) - base)
    )
    scored = rows.select("*", F.inline(scorers)).select(
        "date",
        F.col("MCT_SGG_CD").alias("region"),
        F.col("MCT_RY_CD").alias("industry"),
        "disaster_type",
        "model",
        "feature_set",
        "split",
        "actual_y1",
        (F.col("w0") * (F.col("avg_temp") - 5) + 100 * moved / base).alias("predicted_y1"),
    )
    return scored, found


def saved_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of one run with their episodes."""
    scored, found = predictions(spark, sf_dir)
    chosen = scored.where("model = 'Ridge' and feature_set = 'B_plus_past_sales'")
    return staged(episodes.attach_episode(chosen, found))


def hourly_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw hourly rows: one per station (event type) and hour, some blank."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("station"),
            F.col("ts").cast("date").alias("day"),
            F.hour("ts").alias("hour"),
        )
        .agg(F.sum(money("value")).alias("v"), F.sum("event_id").alias("ids"))
        .select(
            "station",
            F.concat(F.col("day").cast("string"), F.lit(" "), F.format_string("%02d:00", "hour")).alias("ts"),
            F.when(F.col("ids") % 19 == 0, "").otherwise(F.col("v").cast("string")).alias("rain"),
        )
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(weather.hourly_observations(hourly_text(spark, sf_dir), "station", "ts", "rain", STATION_REGIONS))


def _station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("station"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(money("value")).alias("total"),
            F.min(money("value")).alias("lo"),
            F.max(money("value")).alias("hi"),
        )
        .withColumn("m", F.dayofmonth("day") + F.length("station"))
    )


def _warning_text(days: DataFrame, temperatures: dict[str, str], **texts: Column) -> DataFrame:
    mean = (F.col("total").cast("double") / F.col("n")).cast("string")
    values = {"avg_temp": mean, "min_temp": F.col("lo").cast("string"), "max_temp": F.col("hi").cast("string")}
    return days.select(
        F.col("day").cast("string").alias(weather.DAY),
        F.concat(F.lit(" "), "station", F.lit(" ")).alias(weather.STATION),
        *[c.alias(name) for name, c in texts.items()],
        *[F.when(F.col("n") % 10 == 0, "n/a").otherwise(values[k]).alias(name) for k, name in temperatures.items()],
    )


def heat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw heat warning rows for the first half of the month."""
    days = _station_days(spark, sf_dir).where(F.dayofmonth("day") <= 15)
    hot = F.col("m") % 3 == 0
    return _warning_text(
        days,
        weather.HEAT_TEMPERATURES,
        **{
            weather.HEAT_FLAG: F.when(hot, " O").otherwise("X "),
            weather.HEAT_STATUS: F.when(hot, "주의보 ").otherwise("X"),
            weather.HEAT_FORECAST: F.when(F.col("m") % 5 == 0, " 관심"),
        },
    )


def cold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cold warning rows for the second half: each station-day is in one of the two texts."""
    days = _station_days(spark, sf_dir).where(F.dayofmonth("day") > 15)
    slot = F.col("m") % 4
    return _warning_text(
        days,
        weather.COLD_TEMPERATURES,
        **{
            weather.COLD_STATUS: F.when(slot == 0, "X").when(slot == 1, "주의보").when(slot == 2, " 경보"),
            weather.COLD_FORECAST: F.when(F.col("m") % 5 == 0, "주의"),
        },
    )


def weather_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather over the calendar of ``orders`` for three regions; days without an order
    have flags only."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), money("o_totalprice").alias("price")
    )
    days = orders.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"), F.min("price").alias("lo"), F.max("price").alias("hi")
    )
    spine = weather.calendar_spine(days, "date", list(REGION_ORDER))
    k = F.when(F.col("MCT_SGG_CD") == "A", 0).when(F.col("MCT_SGG_CD") == "N", 1).otherwise(2)
    n = F.col("n")
    valid = (24 - (n + k) % 2).cast("int")
    return spine.join(days, "date", "left").select(
        "date",
        "MCT_SGG_CD",
        hazard_flag("heatwave").alias("heatwave"),
        hazard_flag("cold_wave").alias("cold_wave"),
        F.when((n + k) % 3 == 0, 1).when((n + k) % 3 == 1, 0).alias("heavy_rain"),
        (F.col("s").cast("double") / n / 10000).alias("avg_temp"),
        (F.col("lo").cast("double") / 10000).alias("min_temp"),
        (F.col("hi").cast("double") / 10000).alias("max_temp"),
        F.when((n + k) % 2 == 0, (n * (k + 1)).cast("double")).alias("rainfall"),
        F.when(n.isNotNull(), 24).alias("rain_observation_hours"),
        valid.alias("rain_valid_hours"),
        (valid == 24).cast("int").alias("rainfall_complete"),
        F.when(n > 0, (n * (k + 1)).cast("double") / 2).alias("rain_3h_max_mm"),
        F.when(n.isNotNull(), 22 - k).otherwise(0).cast("int").alias("rain_3h_valid_windows"),
    )


def flow_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as monthly weekday flow per block (customer nation and segment)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), money("o_totalprice").alias("price"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")

    return (
        orders.join(customer, "o_custkey")
        .groupBy(
            F.date_format("day", "yyyyMM").alias("STD_YM"),
            F.concat(F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lit("-"), "c_mktsegment").alias("BLOCK_CD"),
        )
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.weekday("day") == d, F.col("price"))), F.lit(0)).cast("string").alias(c)
                for c, d in FLOW_COLUMNS.items()
            ]
        )
    )
