"""Event episodes, the weeks they tie together, and the days they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.functions.scalars import day_number, week_start
from panelshock.operators.audits import duplicate_keys
from panelshock.spec import DEFAULT, PanelSpec


def daily_flags(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per (date, region): the flag its industry rows share, NULL when none has one."""
    return panel.groupBy(spec.date, spec.region).agg(*[F.max(h).alias(h) for h in spec.hazards])


def flag_conflicts(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(date, region) pairs whose industry rows disagree on a flag, from one aggregation."""
    per_day = panel.groupBy(spec.date, spec.region).agg(
        *[F.min(h).alias(f"{h}_lowest") for h in spec.hazards], *[F.max(h).alias(f"{h}_highest") for h in spec.hazards]
    )
    differs = F.lit(False)
    for h in spec.hazards:
        differs = differs | (F.coalesce(F.col(f"{h}_lowest") < F.col(f"{h}_highest"), F.lit(False)))
    return per_day.where(differs)


def find_episodes(flags: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Runs of consecutive flagged days per hazard and region.

    ``flags`` has one row per (date, region), so a partition holds at most one row per
    calendar day. A day without a row ends a run, as does a NULL flag."""
    days = (
        flags.unpivot([spec.date, spec.region], list(spec.hazards), "hazard", "flag")
        .where("flag = 1")
        .select("hazard", F.col(spec.region).alias("region"), F.col(spec.date).alias("date"))
    )
    in_order = W.partitionBy("hazard", "region").orderBy("date")
    runs = (
        days.withColumn("run", day_number("date") - F.row_number().over(in_order))
        .groupBy("hazard", "region", "run")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).cast("int").alias("days"))
    )
    number = F.row_number().over(W.partitionBy("hazard", "region").orderBy("start_date"))
    weeks = F.sequence(week_start("start_date"), week_start("end_date"), F.expr("interval 7 days"))
    return runs.select(
        F.concat_ws("|", "hazard", "region", F.date_format("start_date", "yyyyMMdd"), F.format_string("%02d", number)).alias(
            "episode_id"
        ),
        "hazard",
        "region",
        "start_date",
        "end_date",
        "days",
        weeks.alias("weeks"),
    )


def weeks_text(episodes: DataFrame) -> DataFrame:
    """The exchange form: weeks as ``|``-joined dates."""
    text = F.array_join(F.transform("weeks", lambda w: F.date_format(w, "yyyy-MM-dd")), "|")
    return episodes.withColumn("weeks", text)


def week_components(dates: DataFrame, episodes: DataFrame, date: str = "date") -> DataFrame:
    """(date, week, component_no, component): weeks that must stay together.

    An episode covers consecutive weeks, so components are merged intervals: a week starts a
    new one unless an episode links it to the week before. The running count is ordered over
    weeks only, one row per calendar week."""
    calendar = dates.select(F.col(date).alias("date")).distinct().withColumn("week", week_start("date"))
    linked = (
        episodes.where(F.size("weeks") > 1)
        .select(F.explode(F.slice("weeks", F.lit(2), F.size("weeks"))).alias("week"))
        .distinct()
        .withColumn("linked", F.lit(1))
    )
    weeks = calendar.select("week").distinct().join(linked, "week", "left")
    number = F.sum(F.when(F.col("linked").isNull(), 1).otherwise(0)).over(W.orderBy("week")).cast("int")
    numbered = weeks.select("week", number.alias("component_no"))
    return calendar.join(numbered, "week").select(
        "date", "week", "component_no", F.format_string("G%02d", "component_no").alias("component")
    )


def component_stats(date_table: DataFrame, flags: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per component: weeks, dates and flagged dates per hazard. A date counts once however
    many regions are flagged; a component without a flag has 0."""
    per_date = flags.groupBy(F.col(spec.date).alias("date")).agg(*[F.max(h).alias(h) for h in spec.hazards])
    return (
        date_table.join(per_date, "date", "left")
        .groupBy("component_no", "component")
        .agg(
            F.count_distinct("week").alias("weeks"),
            F.count(F.lit(1)).alias("dates"),
            *[F.coalesce(F.sum(h), F.lit(0)).cast("long").alias(h) for h in spec.hazards],
        )
    )


def episode_days(episodes: DataFrame) -> DataFrame:
    """One row per (hazard, region, date) inside an episode."""
    return episodes.select(
        "hazard", "region", "episode_id", F.explode(F.sequence("start_date", "end_date")).alias("date")
    )


def overlapping_episodes(episodes: DataFrame) -> DataFrame:
    return duplicate_keys(episode_days(episodes), ["hazard", "region", "date"])


def attach_episode(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episode of each event row by (disaster_type, region, date); NULL when there is none.

    An equi join on days, not a range join. No hint: the planner and AQE broadcast the day
    table only below the session's threshold and split hot days otherwise."""
    days = episode_days(episodes).withColumnRenamed("hazard", "disaster_type")
    return events.join(days, ["disaster_type", "region", "date"], "left")
