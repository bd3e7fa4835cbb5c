"""Summaries of a predictions table: scores, episodes, entities, distributions, outliers.

``predictions`` has one row per (disaster_type, model, feature_set, date, region, industry)
with ``split``, ``actual_y1`` and ``predicted_y1``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.functions.ordering import exact_quantiles
from panelshock.functions.scalars import clip
from panelshock.functions.stats import regression_scores
from panelshock.operators.audits import enforce
from panelshock.session import staged

RUN = ("disaster_type", "model", "feature_set")
EPISODE = ("disaster_type", "episode_id", "split")
# Quantiles of the distribution table and the outlier bounds.
DISTRIBUTION = {
    "median": 0.50, "p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25,
    "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99,
}
BOUNDS = {"train_p01": 0.01, "train_p99": 0.99}
SAMPLES = ("test_all", "test_inside_train_p01_p99", "test_winsorized_train_p01_p99")
# Names of the two samples of the importance analysis.
IMPORTANCE_SAMPLES = ("test_all", "test_inside_train_p01_p99")


def select_run(predictions: DataFrame, model: str, feature_set: str) -> DataFrame:
    """Predictions of one model and feature set; none at all raises."""
    saved = predictions.where((F.col("model") == model) & (F.col("feature_set") == feature_set))
    if saved.isEmpty():
        raise ValueError(f"no predictions of {model} with {feature_set}")
    return saved


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("predicted_y1") - F.col("actual_y1")
    return predictions.withColumn("error_y1", error).withColumn("abs_error_y1", F.abs(error))


def train_means(predictions: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return (
        predictions.where("split = 'train'").groupBy(*keys).agg(F.avg("actual_y1").alias("train_mean"))
    )


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Per run and split: n, mae, rmse, r2 and the same scores of the constant train mean.

    The train means are a first pass, staged: the planner sees their size and broadcasts them
    under its threshold. Rows fold on the map side to one per run and split."""
    scored = predictions.join(staged(train_means(predictions, keys)), list(keys), "left")
    y, p, m = F.col("actual_y1"), F.col("predicted_y1"), F.col("train_mean")
    return scored.groupBy(*keys, "split").agg(
        *regression_scores(y, p), *regression_scores(y, m, "_train_mean", count=False)
    )


def subgroup_response(predictions: DataFrame, keys: Sequence[str] = (*RUN, "region", "industry")) -> DataFrame:
    """Observed and predicted mean and sample sd per entity on the test split."""
    return (
        predictions.where("split = 'test'")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("actual_y1").alias("observed_mean_y1"),
            F.avg("predicted_y1").alias("predicted_mean_y1"),
            F.stddev_samp("actual_y1").alias("observed_sd_y1"),
        )
    )


def largest_responses(subgroups: DataFrame, keys: Sequence[str] = ("disaster_type",), k: int = 10) -> DataFrame:
    """Top k entities by absolute observed mean; ties by region and industry. The planner
    limits each partition to k before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.abs("observed_mean_y1").desc(), "region", "industry")
    return subgroups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def episode_day_summary(events: DataFrame) -> DataFrame:
    """Means, industries and rows per episode day. A day belongs to one region and keys are
    unique, so its rows are its industries."""
    return events.groupBy(*EPISODE, "date").agg(
        F.avg("actual_y1").alias("date_actual_mean"),
        F.avg("predicted_y1").alias("date_predicted_mean"),
        F.count_distinct("industry").alias("industries_observed"),
        F.count(F.lit(1)).alias("rows"),
    )


def episode_summary(events: DataFrame) -> DataFrame:
    """Per episode: day-equal means and medians, row statistics, signs per industry, error.

    Medians over days are bounded by the days of an episode; the median over rows uses cells,
    so a long episode of many industries never gathers in one task."""
    by_day = episode_day_summary(events).groupBy(*EPISODE).agg(
        F.count(F.lit(1)).alias("event_days"),
        F.avg("date_actual_mean").alias("actual_y1_day_equal_mean"),
        F.avg("date_predicted_mean").alias("predicted_y1_day_equal_mean"),
        F.median("date_actual_mean").alias("actual_y1_day_equal_median"),
        F.median("date_predicted_mean").alias("predicted_y1_day_equal_median"),
        F.max("industries_observed").alias("industries_max_day"),
        F.sum("rows").alias("rows"),
    )
    by_row = events.groupBy(*EPISODE).agg(
        F.avg("actual_y1").alias("actual_y1_row_mean"),
        F.avg("predicted_y1").alias("predicted_y1_row_mean"),
        F.stddev_samp("actual_y1").alias("actual_y1_row_sd"),
    )
    by_industry = (
        events.groupBy(*EPISODE, "industry")
        .agg(F.avg("actual_y1").alias("m"))
        .groupBy(*EPISODE)
        .agg(
            F.count(F.lit(1)).alias("industry_count"),
            F.count_if(F.col("m") < 0).alias("industries_negative_mean"),
            F.count_if(F.col("m") > 0).alias("industries_positive_mean"),
        )
    )
    median = exact_quantiles(events, EPISODE, "actual_y1", {"actual_y1_row_median": 0.5})
    keys = list(EPISODE)
    error = F.col("predicted_y1_day_equal_mean") - F.col("actual_y1_day_equal_mean")
    return (
        by_day.join(by_row, keys)
        .join(by_industry, keys)
        .join(median, keys)
        .withColumn("episode_error_y1", error)
        .withColumn("episode_absolute_error_y1", F.abs(error))
    )


def entity_episodes(events: DataFrame, entity: str) -> DataFrame:
    """Statistics of each entity (industry or region) within each episode."""
    keys = ["disaster_type", "split", "episode_id", entity]
    within = events.groupBy(*keys).agg(
        F.avg("actual_y1").alias("actual_mean_y1"),
        F.avg("predicted_y1").alias("predicted_mean_y1"),
        F.stddev_samp("actual_y1").alias("actual_sd_y1"),
        F.count(F.lit(1)).alias("observation_rows"),
        F.count_distinct("date").alias("event_dates"),
    )
    median = exact_quantiles(events, keys, "actual_y1", {"actual_median_y1": 0.5})
    return within.join(median, keys).withColumn(
        "error_y1", F.col("predicted_mean_y1") - F.col("actual_mean_y1")
    )


def entity_summary(within: DataFrame, entity: str) -> DataFrame:
    """Each entity over its episodes. Episodes belong to a region, so one industry has those of
    all regions: the quantiles come from ordered cells."""
    actual, predicted = F.col("actual_mean_y1"), F.col("predicted_mean_y1")
    keys = ["disaster_type", "split", entity]
    quantiles = exact_quantiles(
        within, keys, "actual_mean_y1",
        {"median_episode_actual_y1": 0.5, "p10_episode_actual_y1": 0.1, "p90_episode_actual_y1": 0.9},
    )
    return (
        within.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("episode_count"),
            F.avg(actual).alias("mean_episode_actual_y1"),
            F.stddev_samp(actual).alias("sd_episode_actual_y1"),
            F.avg(predicted).alias("mean_episode_predicted_y1"),
            F.avg("error_y1").alias("mean_episode_error_y1"),
            F.count_if(actual < 0).alias("episodes_actual_negative"),
            F.count_if(predicted < 0).alias("episodes_predicted_negative"),
            F.count_if(F.signum(actual) == F.signum(predicted)).alias("episodes_sign_agree"),
        )
        .join(quantiles, keys)
    )


def response_distribution(events: DataFrame, keys: Sequence[str] = ("disaster_type", "split")) -> DataFrame:
    """Counts, moments, exact quantiles and range of the response per hazard and split."""
    keys = list(keys)
    moments = events.groupBy(*keys).agg(
        F.count("actual_y1").alias("n_industry_rows"),
        F.avg("actual_y1").alias("mean"),
        F.stddev_samp("actual_y1").alias("sd"),
        F.min("actual_y1").alias("min"),
        F.max("actual_y1").alias("max"),
    )
    folded = events.select(*keys, "episode_id", "date").distinct()
    counts = folded.groupBy(*keys).agg(
        F.count_distinct("episode_id").alias("n_episodes"), F.count_distinct("date").alias("n_event_dates")
    )
    return moments.join(counts, keys).join(exact_quantiles(events, keys, "actual_y1", DISTRIBUTION), keys)


def train_bounds(predictions: DataFrame, keys: Sequence[str] = ("disaster_type",)) -> DataFrame:
    """1st and 99th percentile of the train response."""
    return exact_quantiles(predictions.where("split = 'train'"), list(keys), "actual_y1", BOUNDS)


def _test_with_bounds(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    # a first pass over train rows, staged so that the planner sees the size
    bounds = staged(train_bounds(predictions, keys))
    return predictions.where("split = 'test'").join(bounds, list(keys))


def sample_rows(predictions: DataFrame, keys: Sequence[str] = ("disaster_type",)) -> DataFrame:
    """Test rows under each sample of the importance analysis: all of them, and those whose
    response lies inside the train bounds."""
    inside = F.col("actual_y1").between(F.col("train_p01"), F.col("train_p99"))
    names = F.array(F.lit(IMPORTANCE_SAMPLES[0]), F.when(inside, F.lit(IMPORTANCE_SAMPLES[1])))
    rows = _test_with_bounds(predictions, keys).withColumn("sample", F.explode(F.array_compact(names)))
    return rows.drop("train_p01", "train_p99")


def outlier_rows(predictions: DataFrame, keys: Sequence[str] = ("disaster_type",)) -> DataFrame:
    """Test rows with their errors, the train bounds and whether they lie outside."""
    inside = F.col("actual_y1").between(F.col("train_p01"), F.col("train_p99"))
    return with_errors(_test_with_bounds(predictions, keys)).withColumn("outside_train_p01_p99", ~inside)


def outlier_sensitivity(predictions: DataFrame, keys: Sequence[str] = ("disaster_type",)) -> DataFrame:
    """Scores on all test rows, on rows inside the train bounds, and with actual and predicted
    clipped to them. Each row is copied once per sample and all samples fold together."""
    keys = list(keys)
    y, p, low, high = (F.col(c) for c in ("actual_y1", "predicted_y1", "train_p01", "train_p99"))
    inside = y.between(low, high)
    copies = [
        (F.lit(True), y, p),
        (inside, y, p),
        (F.lit(True), clip(y, low, high), clip(p, low, high)),
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("sample"),
                kept.alias("kept"),
                F.when(kept, a).alias("y"),
                F.when(kept, b).alias("p"),
            )
            for name, (kept, a, b) in zip(SAMPLES, copies)
        ]
    )
    rows = _test_with_bounds(predictions, keys).select(*keys, "train_p01", "train_p99", F.inline(entries))
    return rows.groupBy(*keys, "sample", "train_p01", "train_p99").agg(
        *regression_scores(F.col("y"), F.col("p")), F.count_if(~F.col("kept")).alias("excluded_test_rows")
    )


def prediction_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "predicted_y1") -> DataFrame:
    """One row: rows on each side, matched rows and the largest absolute difference."""
    a = left.select(*keys, F.col(value).alias("a"), F.lit(1).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("b"), F.lit(1).alias("in_right"))
    return a.join(b, list(keys), "full").agg(
        F.count("in_left").alias("left_rows"),
        F.count("in_right").alias("right_rows"),
        F.count_if(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("matched_rows"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_absolute_difference"),
    )


def require_reproduced(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-7) -> None:
    report = prediction_difference(left, right, keys)
    enforce(
        report.where(
            (F.col("left_rows") != F.col("matched_rows"))
            | (F.coalesce("max_absolute_difference", F.lit(0.0)) > tolerance)
        ),
        "saved predictions do not reproduce",
    )
