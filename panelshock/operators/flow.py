"""Monthly weekday population profile and its join to the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.functions.parsing import lookup, tolerant_double
from panelshock.functions.scalars import month_of, weekday_of
from panelshock.operators.audits import duplicate_keys
from panelshock.spec import DEFAULT, PanelSpec

# The seven weekday columns, Monday first, and the length of a region prefix.
FLOW_COLUMNS = {
    "FLOW_POP_CNT_MON": 0,
    "FLOW_POP_CNT_TUS": 1,
    "FLOW_POP_CNT_WED": 2,
    "FLOW_POP_CNT_THU": 3,
    "FLOW_POP_CNT_FRI": 4,
    "FLOW_POP_CNT_SAT": 5,
    "FLOW_POP_CNT_SUN": 6,
}
PREFIX_LENGTH = 5


def _prefixed(flow: DataFrame) -> DataFrame:
    return flow.withColumn("prefix", F.substring("BLOCK_CD", 1, PREFIX_LENGTH))


def mapped_flow(flow: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Rows whose block prefix belongs to a region, with numeric weekday columns. The mapping
    is a small literal, so the filter runs in the scan stage."""
    with_region = _prefixed(flow).withColumn("region", lookup("prefix", prefixes)).where("region is not null")
    return with_region.withColumns({c: tolerant_double(c) for c in FLOW_COLUMNS})


def unknown_prefixes(flow: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Distinct prefixes outside the mapping; blocks without a code are left out."""
    seen = _prefixed(flow).select("prefix").where("prefix is not null").distinct()
    return seen.where(lookup("prefix", prefixes).isNull())


def flow_problems(mapped: DataFrame, file: str) -> DataFrame:
    """Files with missing or non-numeric weekday values."""
    bad = F.lit(False)
    for c in FLOW_COLUMNS:
        bad = bad | F.col(c).isNull()
    return mapped.groupBy(file).agg(F.count_if(bad).alias("bad_rows")).where("bad_rows > 0")


def repeated_flow_rows(mapped: DataFrame, file: str) -> DataFrame:
    """Files in which whole rows repeat: a sign that a month was loaded twice."""
    whole = mapped.groupBy(file, "STD_YM", "BLOCK_CD", *FLOW_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    return whole.groupBy(file).agg(F.sum(F.col("n") - 1).alias("repeated_rows")).where("repeated_rows > 0")


def flow_coverage(mapped: DataFrame, file: str) -> DataFrame:
    """Per file: matched rows, distinct blocks, sorted prefixes joined by ``|``.

    Rows fold to one per (file, block) first; prefixes are bounded by the mapping."""
    blocks = mapped.groupBy(file, "prefix", "BLOCK_CD").agg(F.count(F.lit(1)).alias("n"))
    return blocks.groupBy(file).agg(
        F.sum("n").alias("matched_rows"),
        F.count("BLOCK_CD").alias("matched_blocks"),
        F.array_join(F.array_sort(F.collect_set("prefix")), "|").alias("prefixes"),
    )


def flow_profile(mapped: DataFrame, by_year: bool = False) -> DataFrame:
    """(region, month, weekday, flow_pop_weekday): sum first, unpivot after.

    ``by_year`` adds the year to the key for inputs of more than one year."""
    monthly = mapped.groupBy("STD_YM", "region").agg(*[F.sum(c).alias(c) for c in FLOW_COLUMNS])
    long = monthly.unpivot(["STD_YM", "region"], list(FLOW_COLUMNS), "flow_day", "flow_pop_weekday")
    year = [F.substring("STD_YM", 1, 4).cast("int").alias("year")] if by_year else []
    return long.select(
        *year,
        "region",
        F.substring("STD_YM", -2, 2).cast("int").alias("month"),
        lookup("flow_day", FLOW_COLUMNS).alias("weekday"),
        "flow_pop_weekday",
    )


def profile_collisions(profile: DataFrame) -> DataFrame:
    """Keys that occur twice, as when months of several years are pooled."""
    keys = [c for c in ("year", "region", "month", "weekday") if c in profile.columns]
    return duplicate_keys(profile, keys)


def join_flow(panel: DataFrame, profile: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Panel with month, weekday and the profile value of its region; NULL where none fits.

    The profile has 84 rows per region (and year); regions come from the prefix mapping, so
    its size is fixed by that literal."""
    out = panel.withColumns({"month": month_of(spec.date), "weekday": weekday_of(spec.date)})
    at = {"__region": F.col(spec.region), "__month": F.col("month"), "__weekday": F.col("weekday")}
    if "year" in profile.columns:
        at["__year"] = F.year(spec.date)
    named = profile.select("flow_pop_weekday", *[F.col(k.removeprefix("__")).alias(k) for k in at])
    return out.withColumns(at).join(named, list(at), "left").drop(*at)
