"""Leak-free train/validation/test splits over indivisible components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshock.operators.episodes import episode_days
from panelshock.spec import DEFAULT, RATIOS, SPLITS, PanelSpec

RESTARTS = 2500
SEED = 20261003


def score_assignments(components: DataFrame, assignments: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Score of each candidate assignment (candidate, component_no, split); lower is better.

    4 * squared distance of date shares from the targets, 2 * the same for flagged dates per
    hazard, 100 for each hazard absent from a split."""
    hazards = list(spec.hazards)
    measured = ["dates", *hazards]
    placed = assignments.join(components.select("component_no", *measured), "component_no")
    sums = placed.groupBy("candidate").agg(
        *[F.sum(c).cast("double").alias(f"all_{c}") for c in measured],
        *[
            F.coalesce(F.sum(F.when(F.col("split") == s, F.col(c))), F.lit(0)).cast("double").alias(f"{s}_{c}")
            for s in SPLITS
            for c in measured
        ],
    )
    score = F.lit(0.0)
    for c, weight in [("dates", 4.0), *[(h, 2.0) for h in hazards]]:
        for s in SPLITS:
            share = F.col(f"{s}_{c}") / F.greatest(F.col(f"all_{c}"), F.lit(1.0))
            score = score + weight * (share - RATIOS[s]) * (share - RATIOS[s])
    empty = F.lit(0)
    for h in hazards:
        for s in SPLITS:
            empty = empty + (F.col(f"{s}_{h}") == 0).cast("int")
    return sums.select(
        "candidate",
        *[F.col(f"{s}_dates").cast("long").alias(f"{s}_dates") for s in SPLITS],
        empty.alias("empty_cells"),
        (score + 100.0 * empty).alias("score"),
    )


def _improve(sizes: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray]:
    """Steepest single-component moves from ``start``; ``sizes`` is components x measures."""
    targets = np.array([[RATIOS[s]] for s in SPLITS])
    weights = np.array([4.0] + [2.0] * (sizes.shape[1] - 1))
    totals = np.maximum(sizes.sum(axis=0), 1.0)

    def score(cells: np.ndarray) -> np.ndarray:
        off = (cells / totals - targets) ** 2
        return (off * weights).sum(axis=(-1, -2)) + 100.0 * (cells[..., 1:] == 0).sum(axis=(-1, -2))

    split = start.copy()
    n, k = len(sizes), len(SPLITS)
    one_hot = np.eye(k)
    while True:
        cells = one_hot[split].T @ sizes
        current = float(score(cells))
        # every move of every component at once: n x k x splits x measures
        removed = cells - one_hot[split][:, :, None] * sizes[:, None, :]
        moved = removed[:, None] + one_hot[None, :, :, None] * sizes[:, None, None, :]
        values = score(moved)
        best = int(values.argmin())
        if values.flat[best] >= current - 1e-12:
            return current, split
        split[best // k] = best % k


def search_split(
    spark: SparkSession,
    components: DataFrame,
    restarts: int = RESTARTS,
    seed: int = SEED,
    tasks: int | None = None,
    spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """Best assignment over seeded random restarts: (component_no, split, score).

    Restarts are spread over tasks; each returns its own optimum and ``min_by`` keeps one.
    A restart draws from (seed, restart), so a lost task repeats exactly. Components number at
    most one per calendar week, which bounds what the driver reads and each task holds."""
    hazards = list(spec.hazards)
    rows = components.select("component_no", "dates", *hazards).orderBy("component_no").collect()
    if len(rows) < 3:
        raise ValueError("fewer than three indivisible components: no three-way split exists")
    numbers = [int(r[0]) for r in rows]
    sizes = np.array([[float(v) for v in r[1:]] for r in rows])
    shares = [RATIOS[s] for s in SPLITS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for restart in batch["id"]:
                rng = np.random.default_rng([seed, int(restart)])
                found.append((int(restart), *_improve(sizes, rng.choice(len(SPLITS), len(sizes), p=shares))))
            yield pd.DataFrame(
                {
                    "restart": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "splits": [f[2].tolist() for f in found],
                }
            )

    starts = spark.range(0, restarts, 1, tasks or min(restarts, spark.sparkContext.defaultParallelism))
    best = starts.mapInPandas(run, "restart long, score double, splits array<int>").agg(
        F.min_by(F.struct("splits", "score"), F.struct("score", "restart")).alias("b")
    )
    names = F.array(*[F.lit(s) for s in SPLITS])
    known = F.array(*[F.lit(n) for n in numbers])
    return best.select(F.col("b.score").alias("score"), F.posexplode("b.splits").alias("i", "s")).select(
        F.get(known, F.col("i")).alias("component_no"), F.get(names, F.col("s")).alias("split"), "score"
    )


def assign_split(date_table: DataFrame, assignment: DataFrame) -> DataFrame:
    """Date table with the split of its component."""
    return date_table.join(assignment.select("component_no", "split"), "component_no")


def attach_split(panel: DataFrame, split_dates: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Panel rows with week, component and split.

    The date table has one row per calendar day. Pass it staged: the planner then knows its
    size and broadcasts it under the session's threshold, so the panel is not shuffled."""
    dates = split_dates.select(F.col("date").alias(spec.date), "week", "component", "split")
    return panel.join(dates, spec.date)


def split_leaks(assigned: DataFrame, fields: tuple[str, ...] = ("date", "week", "component")) -> DataFrame:
    """Values of a field that occur in more than one split. Rows fold to one per date first."""
    per_day = assigned.select("split", *[F.col(f).cast("string").alias(f) for f in fields]).distinct()
    long = per_day.unpivot(["split"], list(fields), "field", "value")
    return (
        long.groupBy("field", "value")
        .agg(F.min("split").alias("first"), F.max("split").alias("last"))
        .where("first <> last")
    )


def episode_leaks(assigned: DataFrame, episodes: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Episodes whose region-days are not all in one split, or have none."""
    region_days = assigned.select(
        F.col(spec.date).alias("date"), F.col(spec.region).alias("region"), "split"
    ).distinct()
    return (
        episode_days(episodes)
        .join(region_days, ["date", "region"], "left")
        .groupBy("episode_id")
        .agg(F.min("split").alias("first"), F.max("split").alias("last"))
        .where("first is null or first <> last")
    )


def split_report(split_dates: DataFrame, episodes: DataFrame, flags: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per split, empty ones included: dates, share, weeks, episodes by start date, flagged
    region-days per hazard. Every input is folded to one row per date before the last step."""
    starts = episodes.groupBy(F.col("start_date").alias("date")).agg(F.count(F.lit(1)).alias("starts"))
    flagged = flags.groupBy(F.col(spec.date).alias("date")).agg(
        *[F.count_if(F.col(h) == 1).alias(f"{h}_region_days") for h in spec.hazards]
    )
    names = [f"{h}_region_days" for h in spec.hazards]
    per_week = (
        split_dates.join(starts, "date", "left")
        .join(flagged, "date", "left")
        .groupBy("split", "week")
        .agg(
            F.count(F.lit(1)).alias("dates"),
            F.sum("starts").alias("episodes"),
            *[F.sum(n).alias(n) for n in names],
        )
    )
    listed = split_dates.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    totals = per_week.groupBy("split").agg(
        F.sum("dates").alias("dates"),
        F.count(F.lit(1)).alias("weeks"),
        F.sum("episodes").alias("episodes"),
        *[F.sum(n).alias(n) for n in names],
    )
    filled = listed.join(totals, "split", "left").select(
        "split", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("dates", "weeks", "episodes", *names)]
    )
    all_dates = per_week.agg(F.sum("dates")).scalar()
    return filled.withColumn("share", F.col("dates") / all_dates)


def empty_hazard_splits(events: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(hazard, split) pairs without an event row: every hazard must be in every split."""
    counts = events.groupBy("split").agg(*[F.count_if(F.col(h) == 1).alias(h) for h in spec.hazards])
    listed = events.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    long = listed.join(counts, "split", "left").unpivot(["split"], list(spec.hazards), "hazard", "rows")
    return long.where(F.coalesce("rows", F.lit(0)) == 0).select("hazard", "split")
