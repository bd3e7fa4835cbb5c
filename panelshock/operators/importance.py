"""Permutation importance: how much the test MAE grows when feature values are exchanged.

Rows are numbered once, by the digest of their key. The permutation of a repeat is a keyed
bijection of these numbers: a Feistel network whose keys come from (seed, group, repeat), walked
on until the number is one of the rows'. So no repeat ranks anything, every row looks its donor up
in one table that does not grow with the repeats, and a lost task repeats exactly."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from panelshock.functions.ordering import number_rows
from panelshock.functions.parsing import lookup

# Features of each group.
FEATURE_GROUPS = {
    "weather": ("avg_temp", "min_temp", "max_temp"),
    "lag": ("lag1", "lag7"),
    "rolling": ("rolling7", "rolling28"),
    "region": ("MCT_SGG_CD",),
    "industry": ("MCT_RY_CD",),
}
REPORT_GROUPS = {
    "avg_temp": "weather", "min_temp": "weather", "max_temp": "weather",
    "lag1": "past_sales", "lag7": "past_sales", "rolling7": "past_sales", "rolling28": "past_sales",
    "MCT_SGG_CD": "region", "MCT_RY_CD": "industry", "flow_pop_weekday": "flow_population",
}
Scorer = Callable[[DataFrame], DataFrame]


# a round mixes half of a number by two multiplications modulo a prime below 2^31
ROUNDS, KEY_DIGITS, PRIME, FACTORS = 4, 7, 2_147_483_647, (1_103_515_245, 69_069)


def _mixed(half: np.ndarray, key: np.ndarray) -> np.ndarray:
    v = (((half + key) * FACTORS[0] + 12_345) % PRIME * FACTORS[1] + key) % PRIME
    return v ^ (v >> 15)


def bijection(place: np.ndarray, count: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each place below ``count`` goes, a permutation of the places for every row of
    ``keys`` (rows by ROUNDS). Numbers beyond ``count`` are sent on until one is a place; the
    network has at most four times as many numbers as places."""
    bits = np.maximum(1, -(-np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) // 2))
    out, going = place.astype(np.int64).copy(), np.arange(len(place))
    while len(going):
        b = bits[going]
        left, right = out[going] >> b, out[going] & ((1 << b) - 1)
        for i in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, keys[going, i]) & ((1 << b) - 1))
        out[going] = (left << b) | right
        going = going[out[going] >= count[going]]
    return out


@F.pandas_udf(LongType())
def _donor(place: pd.Series, count: pd.Series, keys: pd.Series) -> pd.Series:
    if not len(place):
        return pd.Series([], dtype="int64")
    return pd.Series(bijection(place.to_numpy(), count.to_numpy(), np.vstack(keys.to_numpy()).astype(np.int64)))


def _round_keys(seed: int, group: Column, repeat: Column) -> Column:
    texts = [F.md5(F.concat_ws("|", F.lit(str(seed)), group, repeat.cast("string"), F.lit(str(i)))) for i in range(ROUNDS)]
    return F.array(*[F.conv(F.substring(t, 1, KEY_DIGITS), 16, 10).cast("long") for t in texts])


def permuted_errors(
    rows: DataFrame,
    keys: Sequence[str],
    within: Sequence[str],
    groups: dict[str, Sequence[str]],
    repeats: int,
    scorer: Scorer,
    actual: str,
    seed: int,
) -> DataFrame:
    """MAE per (within, feature_group, repeat) after exchanging the columns of the group
    together among the rows of ``within``. ``scorer`` adds ``prediction``."""
    within = list(within)
    columns = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    identity = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    numbered = number_rows(rows.withColumn("__token", F.md5(identity)), within, "__token", "__at").drop("__token")
    sizes = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("__count"))
    spread = numbered.join(sizes, within).select("*", F.explode(F.array(*[F.lit(g) for g in groups])).alias("feature_group"))
    receivers = spread.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    receivers = receivers.withColumn(
        "__from", _donor("__at", "__count", _round_keys(seed, F.col("feature_group"), F.col("repeat")))
    ).drop("__at", "__count")
    donors = numbered.select(*within, F.col("__at").alias("__from"), F.struct(*columns).alias("__donor"))
    exchanged = receivers.join(donors, [*within, "__from"]).drop("__from")
    replaced = {
        c: F.when(
            F.col("feature_group").isin(*[g for g, cs in groups.items() if c in cs]), F.col(f"__donor.{c}")
        ).otherwise(F.col(c))
        for c in columns
    }
    scored = scorer(exchanged.withColumns(replaced).drop("__donor"))
    return scored.groupBy(*within, "feature_group", "repeat").agg(
        F.avg(F.abs(F.col("prediction") - F.col(actual))).alias("mae"), F.count(F.lit(1)).alias("n_rows")
    )


def permutation_importance(
    rows: DataFrame,
    keys: Sequence[str],
    groups: dict[str, Sequence[str]],
    repeats: int,
    scorer: Scorer,
    actual: str = "actual_y1",
    within: Sequence[str] = ("disaster_type",),
    seed: int = 20261003,
) -> DataFrame:
    """Mean MAE increase per group of columns, with the sample sd over repeats (0 for one
    repeat) and the population sd. One-column groups give the importance per feature."""
    within = list(within)
    base = scorer(rows).groupBy(*within).agg(
        F.avg(F.abs(F.col("prediction") - F.col(actual))).alias("baseline_mae")
    )
    errors = permuted_errors(rows, keys, within, groups, repeats, scorer, actual, seed)
    gains = errors.join(base, within).withColumn("gain", F.col("mae") - F.col("baseline_mae"))
    return gains.groupBy(*within, "feature_group").agg(
        F.max("n_rows").alias("n_rows"),
        F.max("baseline_mae").alias("baseline_mae"),
        F.avg("gain").alias("importance_mean"),
        F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("importance_sd"),
        F.stddev_pop("gain").alias("importance_sd_pop"),
        F.count(F.lit(1)).alias("permutation_repeats"),
    )


def single_features(features: Sequence[str]) -> dict[str, tuple[str]]:
    return {f: (f,) for f in features}


def group_importance(importances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Importances summed per reporting group of their feature; unknown features are other."""
    group = F.coalesce(lookup("feature", REPORT_GROUPS), F.lit("other"))
    return (
        importances.withColumn("feature_group", group)
        .groupBy(*keys, "feature_group")
        .agg(F.sum("importance_mean").alias("importance_mean"))
    )


def top_features(importances: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("importance_mean").desc(), "feature")
    return importances.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
