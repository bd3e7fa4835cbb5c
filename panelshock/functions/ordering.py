"""Exact ranks and quantiles that never gather a whole group in one task.

Quantiles are selected by radix: every double becomes a 64-bit integer of the same order, and a
wanted rank is narrowed by 16 bits a round, in four rounds. A round only adds up the counts of at
most 65,536 sibling cells, whatever the values; no cell is ever ordered by value. Row numbers are
given inside digest cells. Both place rows by their value alone, so a recomputed task repeats."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

ROUNDS, ROUND_BITS = 4, 16
HASH_PREFIX = 3


def ordered_integers(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the given doubles; both zeros are one."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(LongType())
def _ordered(values: pd.Series) -> pd.Series:
    return pd.Series(ordered_integers(values.to_numpy()))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """The distinct values of each group that hold a wanted rank: (keys, value, start, upto,
    total), where ranks ``start .. upto - 1`` of ``total`` rows have that value. Wanted are the
    ranks at both sides of ``fraction * (total - 1)``. Equal values are counted first; the counts
    of the four levels of cells are sums of each other, so each level is one aggregation and a
    group of siblings has at most 65,536 rows. NULL and NaN values and NULL keys count as
    missing."""
    keys = list(keys)
    v = "__v"
    present = F.col(v).isNotNull() & ~F.isnan(v)
    for k in keys:
        present = present & F.col(k).isNotNull()
    counted = (
        df.select(*keys, F.col(value).cast("double").alias(v))
        .where(present)
        .groupBy(*keys, v)
        .agg(F.sum(F.lit(1)).alias("__n"))
        .withColumn("__p", _ordered(F.col(v)))
    )
    levels = [counted]
    for _ in range(ROUNDS - 1):
        cut = levels[0].withColumn("__p", F.shiftright("__p", ROUND_BITS))
        levels.insert(0, cut.groupBy(*keys, "__p").agg(F.sum("__n").alias("__n")))

    hits = None
    for level in levels:
        rows, parent = level.withColumn("__up", F.shiftright("__p", ROUND_BITS)), [*keys, "__up"]
        if hits is None:
            every = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
            rows = rows.withColumns({"__before": F.lit(0).cast("long"), "__total": F.sum("__n").over(every)})
            siblings = every
        else:
            rows = rows.join(hits.withColumnRenamed("__p", "__up"), parent)
            siblings = W.partitionBy(*parent)
        upto = F.col("__before") + F.sum("__n").over(siblings.orderBy("__p"))
        position = F.transform(F.array(*[F.lit(float(q)) for q in fractions]), lambda q: q * (F.col("__total") - 1))
        holds = F.exists(
            position,
            lambda x: ((F.ceil(x) >= F.col("__start")) & (F.ceil(x) < F.col("__upto")))
            | ((F.floor(x) >= F.col("__start")) & (F.floor(x) < F.col("__upto"))),
        )
        rows = rows.withColumn("__upto", upto).withColumn("__start", F.col("__upto") - F.col("__n")).where(holds)
        hits = rows.select(*keys, "__p", F.col("__start").alias("__before"), "__total", *([v, "__upto"] if level is counted else []))
    return hits.select(
        *keys, F.col(v).alias("value"), F.col("__before").alias("start"), F.col("__upto").alias("upto"), F.col("__total").alias("total")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys``, one column per entry.

    Equal to ``percentile`` but without its per-group map of values in one task. NaN counts as
    missing. Groups without a value, and NULL keys, are absent."""
    found = ranked_values(df, keys, value, list(quantiles.values()))
    out = []
    for name, q in quantiles.items():
        p = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(p), F.ceil(p)

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("start") <= rank) & (rank < F.col("upto")), F.col("value")))

        out.append(
            F.when(F.max(high) == F.max(low), at(low))
            .otherwise(F.max(high - p) * at(low) + F.max(p - low) * at(high))
            .alias(name)
        )
    return found.groupBy(*keys).agg(*out)


def number_rows(df: DataFrame, groups: Sequence[str], token: str, index: str) -> DataFrame:
    """Add the 0-based position of each row of a group in the order of ``token``, a unique
    hexadecimal digest. Digests are uniform, so cells by their prefix are even, whatever the
    size of the group."""
    groups = list(groups)
    cell = F.substring(F.col(token), 1, HASH_PREFIX)
    marked = df.withColumn("__cell", cell)
    sizes = marked.groupBy(*groups, "__cell").agg(F.count(F.lit(1)).alias("__size"))
    order = W.partitionBy(*groups).orderBy("__cell") if groups else W.orderBy("__cell")
    starts = sizes.select(*groups, "__cell", (F.sum("__size").over(order) - F.col("__size")).alias("__before"))
    inside = W.partitionBy(*groups, "__cell").orderBy(token)
    return (
        marked.join(starts, [*groups, "__cell"])
        .withColumn(index, F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__cell", "__before")
    )
