"""Lags and rolling means by calendar date, not by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.functions.scalars import day_number
from panelshock.spec import DEFAULT, PanelSpec

# Lag and window lengths in days.
LAGS = {"lag1": 1, "lag7": 7}
ROLLING = {"rolling7": 7, "rolling28": 28}


def add_calendar_features(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Value of exactly t-n, and the mean of t-n..t-1 when every one of those days has a value.

    RANGE frames over the day number look at dates, so a gap gives NULL and a zero counts.
    History may come from any split. All frames share one exchange and one sort by series."""
    series = W.partitionBy(*spec.entity).orderBy(day_number(spec.date))
    value = F.col(spec.measure)
    columns: dict[str, Column] = {}
    for name, n in LAGS.items():
        columns[name] = F.first(value).over(series.rangeBetween(-n, -n)).cast("double")
    for name, n in ROLLING.items():
        frame = series.rangeBetween(-n, -1)
        columns[name] = F.when(F.count(value).over(frame) == n, F.sum(value).over(frame).cast("double") / n)
    return panel.withColumns(columns)


def audit_calendar_features(featured: DataFrame, spec: PanelSpec = DEFAULT, tolerance: float = 1e-8) -> DataFrame:
    """Re-derive every lag and window by another path and count the differences.

    Each day carries the running sum and count of its series and is sent forward to the days
    that look back to it: yesterday and the first day of each window. A window is a difference of
    two running sums, valid where the counts show a value on each of its days. The panel is
    shuffled once, by series; days meet inside their series. One row per feature."""
    offsets = sorted({0, 1, *LAGS.values(), *ROLLING.values()})
    value, names = F.col(spec.measure), [*LAGS, *ROLLING]
    upto = W.partitionBy(*spec.entity).orderBy(spec.date).rowsBetween(W.unboundedPreceding, 0)
    running = featured.select(
        *spec.key, *names, value.alias("value"), F.sum(F.coalesce(value, F.lit(0))).over(upto).alias("total"), F.count(value).over(upto).alias("present")
    )
    sent = running.withColumn("offset", F.explode(F.array(*[F.lit(n) for n in offsets]))).withColumn(spec.date, F.date_add(spec.date, F.col("offset")))
    at = {n: F.max(F.when(F.col("offset") == n, F.struct("value", "total", "present"))).alias(f"at{n}") for n in offsets if n}
    own = F.max(F.when(F.col("offset") == 0, F.struct(*names))).alias("own")
    met = sent.groupBy(*spec.key).agg(own, F.count_if(F.col("offset") == 0).alias("days"), *at.values()).where("days > 0")
    rebuilt = {f"x_{c}": F.col(f"at{n}.value").cast("double") for c, n in LAGS.items()}
    for c, n in ROLLING.items():
        first, last = f"at{n}", "at1"
        found = F.col(f"{last}.present") - F.col(f"{first}.present") + F.col(f"{first}.value").isNotNull().cast("int")
        total = F.col(f"{last}.total") - F.col(f"{first}.total") + F.col(f"{first}.value")
        rebuilt[f"x_{c}"] = F.when(found == n, total.cast("double") / n)
    joined = met.withColumns(rebuilt).select(*[F.col(f"own.{c}").alias(c) for c in names], *rebuilt)
    counts = []
    for c in names:
        a, b = F.col(c), F.col(f"x_{c}")
        same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance + 1e-5 * F.abs(b), F.lit(False))
        counts.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(F.lit(1)).alias("rows"),
                F.count(a).alias("present"),
                F.count_if(~same).alias("mismatches"),
            )
        )
    return joined.agg(F.array(*counts).alias("r")).select(F.inline("r"))
