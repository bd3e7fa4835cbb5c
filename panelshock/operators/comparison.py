"""Model comparison: one wide row per run, gaps, stability labels, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.operators.report import RUN

# Split prefixes of the wide table, metric names, label thresholds.
PREFIXES = {"train": "train", "validation": "val", "test": "test"}
METRICS = ("mae", "rmse", "r2")
MAE_RATIO_LOW, MAE_RATIO_HIGH, TRAIN_ONLY_R2, DROP_R2 = 0.85, 1.15, 0.20, 0.15
STABLE_MAE_SPAN, STABLE_R2_SPAN = 0.20, 0.25
NO_LABEL = "mixed_or_no_large_gap_by_threshold"


def wide_metrics(metrics: DataFrame) -> DataFrame:
    """One row per run: every metric of every split side by side, and the gap columns."""
    columns = []
    for split, prefix in PREFIXES.items():
        at = F.col("split") == split
        columns += [F.max(F.when(at, F.col(m))).alias(f"{prefix}_{m}") for m in METRICS]
        columns.append(F.max(F.when(at, F.col("n"))).alias(f"{prefix}_n"))
        columns += [
            F.max(F.when(at, F.col(f"{m}_train_mean"))).alias(f"{prefix}_train_mean_baseline_{m}") for m in METRICS
        ]
    return (
        metrics.groupBy(*RUN)
        .agg(*columns)
        .withColumn("test_minus_train_mae", F.col("test_mae") - F.col("train_mae"))
        .withColumn("test_minus_validation_mae", F.col("test_mae") - F.col("val_mae"))
        .withColumn("train_minus_test_r2", F.col("train_r2") - F.col("test_r2"))
    )


def stability(wide: DataFrame) -> DataFrame:
    """Relative MAE changes, R2 drops and the ``|``-joined stability label."""
    tm, vm, sm = (F.col(f"{p}_mae") for p in ("train", "val", "test"))
    tr, vr, sr = (F.col(f"{p}_r2") for p in ("train", "val", "test"))
    mae_span = F.greatest(tm, vm, sm) / F.least(tm, vm, sm) - 1.0
    r2_span = F.greatest(tr, vr, sr) - F.least(tr, vr, sr)
    rules = {
        "train_only_fit": (tm < vm * MAE_RATIO_LOW)
        & (tm < sm * MAE_RATIO_LOW)
        & (tr - F.greatest(vr, sr) >= TRAIN_ONLY_R2),
        "validation_to_test_drop": (sm > vm * MAE_RATIO_HIGH) & (vr - sr >= DROP_R2),
        "train_to_validation_drop": (vm > tm * MAE_RATIO_HIGH) & (tr - vr >= DROP_R2),
        "comparatively_stable_by_threshold": (mae_span <= STABLE_MAE_SPAN) & (r2_span <= STABLE_R2_SPAN),
    }
    labels = F.concat_ws("|", *[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return wide.withColumns(
        {
            "train_to_validation_mae_change_pct": (vm / tm - 1.0) * 100.0,
            "validation_to_test_mae_change_pct": (sm / vm - 1.0) * 100.0,
            "train_to_test_mae_change_pct": (sm / tm - 1.0) * 100.0,
            "train_to_validation_r2_drop": tr - vr,
            "validation_to_test_r2_drop": vr - sr,
            "stability_assessment": F.coalesce(F.nullif(labels, F.lit("")), F.lit(NO_LABEL)),
        }
    )


def leaders(wide: DataFrame) -> DataFrame:
    """Best model per hazard and feature set by validation MAE and by test MAE; ties by the
    other score, then by name."""

    def best(first: str, second: str):
        return F.min_by(F.struct("model", "val_mae", "test_mae"), F.struct(first, second, "model"))

    picked = wide.groupBy("disaster_type", "feature_set").agg(
        best("val_mae", "test_mae").alias("v"), best("test_mae", "val_mae").alias("t")
    )
    return picked.select(
        "disaster_type",
        "feature_set",
        F.col("v.model").alias("best_validation_model"),
        F.col("v.val_mae").alias("best_validation_val_mae"),
        F.col("v.test_mae").alias("best_validation_test_mae"),
        F.col("t.model").alias("best_test_model"),
        F.col("t.test_mae").alias("best_test_test_mae"),
        F.col("t.val_mae").alias("best_test_val_mae"),
    )


def top_runs(wide: DataFrame, k: int = 3) -> DataFrame:
    """The k best runs per hazard and feature set by (validation, test) MAE."""
    order = W.partitionBy("disaster_type", "feature_set").orderBy("val_mae", "test_mae", "model")
    return wide.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*RUN, "rank")
