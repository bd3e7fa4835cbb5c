"""Regression scores as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regression_scores(actual: Column, predicted: Column, suffix: str = "", count: bool = True) -> list[Column]:
    """n, mae, rmse, r2 for a ``groupBy(..).agg``.

    The total sum of squares is n times the population variance, so no second pass is
    needed. R2 of constant actuals is 1 for a perfect fit and 0 otherwise; of one row, NULL."""
    error = actual - predicted
    squares = F.sum(error * error)
    total = F.var_pop(actual) * F.count(actual)
    r2 = (
        F.when(F.count(actual) < 2, None)
        .when(total > 0, 1 - squares / F.when(total > 0, total))
        .when(squares == 0, 1.0)
        .otherwise(0.0)
    )
    scores = [
        F.avg(F.abs(error)).alias(f"mae{suffix}"),
        F.sqrt(F.avg(error * error)).alias(f"rmse{suffix}"),
        r2.alias(f"r2{suffix}"),
    ]
    return [F.count(actual).alias("n"), *scores] if count else scores
