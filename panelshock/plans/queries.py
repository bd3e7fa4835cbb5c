"""Registered queries: each runs an operator over whole given tables.

``tidy`` only shapes the answer for comparison: dates as ISO text, decimals as double,
doubles to six places unless one exact division makes them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.functions import parsing, scalars
from panelshock.functions.ordering import exact_quantiles
from panelshock.functions.scalars import percent_deviation
from panelshock.operators import (
    audits, baseline, calendar, cards, comparison, episodes, flow, importance, models, panel, preprocess,
    report, splits, weather,
)
from panelshock.operators.boosting import LeafBoosting
from panelshock.plans import fixtures as fx
from panelshock.plans.pipelines import build_impact, importance_of_samples, require_refit
from panelshock.session import shared_folder, staged
from panelshock.sources import readers, writers
from panelshock.spec import DEFAULT, SPLITS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
TEMPERATURES = ("avg_temp", "min_temp", "max_temp")
EVENT_KEY = ("disaster_type", "date", "MCT_SGG_CD", "MCT_RY_CD")
SCORER_GROUPS = {"weather": ("avg_temp",), "lag": ("lag1", "lag7"), "rolling": ("rolling7",)}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def tidy(df: DataFrame, unrounded: tuple[str, ...] = ()) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "date":
            c = c.cast("string")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("double", "float") and name not in unrounded:
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): the number of violating rows of each audit."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        for name, df in checks.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


# --- transactions -------------------------------------------------------------------------


@query
def daily_agg_null_poison(spark, sf):
    daily = cards.daily_aggregate(cards.parse_transactions(fx.card_text(spark, sf)))
    return tidy(daily.withColumn("ts_at_text", parsing.plain_decimal_text(F.col("TS_AT"))), ("avg_price",))


@query
def load_quality_report(spark, sf):
    return tidy(cards.load_report(fx.card_text(spark, sf)))


@query
def parse_coercion_counts(spark, sf):
    raw = fx.card_text(spark, sf)
    parsed = raw.select(
        parsing.clean_key("MCT_SGG_CD").alias("region"),
        parsing.tolerant_double("TS_AT").alias("loose"),
        parsing.tolerant_decimal("TS_AT").alias("exact"),
        parsing.tolerant_date("TA_YMD").alias("day"),
        parsing.strict_double(F.when(F.col("USE_CNT") != "", F.col("USE_CNT"))).alias("strict"),
        parsing.strict_date(F.when(F.col("TA_YMD") != "20250230", F.col("TA_YMD"))).alias("strict_day"),
    )
    return tidy(
        parsed.groupBy("region").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("loose").alias("numbers"),
            F.count("exact").alias("exact_numbers"),
            F.sum("exact").alias("exact_sum"),
            F.count("day").alias("dates"),
            F.sum("strict").alias("count_sum"),
            F.max("strict_day").alias("last_day"),
        )
    )


@query
def first_keys_sample(spark, sf):
    daily = cards.daily_aggregate(cards.parse_transactions(fx.card_text(spark, sf)))
    return tidy(daily.orderBy(*cards.KEY).limit(10), ("avg_price",))


# --- weather ------------------------------------------------------------------------------


@query
def warning_rows(spark, sf):
    heat = weather.heat_warnings(fx.heat_text(spark, sf), fx.STATION_REGIONS)
    cold = weather.cold_warnings(fx.cold_text(spark, sf), fx.STATION_REGIONS)
    return tidy(weather.warnings_union(heat, cold), TEMPERATURES)


@query
def hourly_to_daily_complete(spark, sf):
    return tidy(weather.daily_rain(fx.hourly(spark, sf)))


@query
def rain_quantile_thresholds(spark, sf):
    return tidy(weather.rain_thresholds(weather.daily_rain(fx.hourly(spark, sf))))


@query
def rolling3h_exposure(spark, sf):
    return tidy(weather.rolling_exposure(fx.hourly(spark, sf), fx.RAIN_THRESHOLD))


@query
def daily_weather(spark, sf):
    hourly = fx.hourly(spark, sf)
    daily = weather.daily_weather(
        weather.heat_warnings(fx.heat_text(spark, sf), fx.STATION_REGIONS),
        weather.cold_warnings(fx.cold_text(spark, sf), fx.STATION_REGIONS),
        hourly,
        sorted(fx.STATION_REGIONS.values()),
    )
    return tidy(daily, TEMPERATURES)


@query
def daily_weather_with_exposure(spark, sf):
    hourly = fx.hourly(spark, sf)
    daily = weather.daily_weather(
        weather.heat_warnings(fx.heat_text(spark, sf), fx.STATION_REGIONS),
        weather.cold_warnings(fx.cold_text(spark, sf), fx.STATION_REGIONS),
        hourly,
        sorted(fx.STATION_REGIONS.values()),
    )
    joined = weather.attach_exposure(daily, weather.rolling_exposure(hourly, fx.RAIN_THRESHOLD))
    return tidy(joined.select("date", "MCT_SGG_CD", "heatwave", "cold_wave", "heavy_rain", "rainfall", "rain_3h_max_mm", "rain_3h_valid_windows"))


@query
def calendar_spine_join(spark, sf):
    return tidy(fx.weather_days(spark, sf), TEMPERATURES)


# --- panel --------------------------------------------------------------------------------


def _joined(spark, sf):
    card = panel.normalise_keys(fx.panel(spark, sf).select("date", "MCT_SGG_CD", "MCT_RY_CD", "TS_AT", "USE_CNT"), ["MCT_SGG_CD", "MCT_RY_CD"])
    card = card.withColumn("avg_price", F.col("TS_AT").cast("double") / F.col("USE_CNT"))
    return panel.join_weather(card, staged(fx.weather_days(spark, sf)))


@query
def panel_left_join(spark, sf):
    return tidy(panel.panel_columns(_joined(spark, sf)), ("avg_price", *TEMPERATURES))


@query
def panel_left_join_match_rate(spark, sf):
    return tidy(panel.match_report(_joined(spark, sf), "heavy_rain"))


@query
def unmatched_keys(spark, sf):
    return tidy(panel.unmatched_keys(fx.panel(spark, sf), fx.weather_days(spark, sf)))


@query
def missing_by_column(spark, sf):
    joined = panel.panel_columns(_joined(spark, sf))
    return audits.missing_by_column(joined, ["heatwave", "heavy_rain", "cold_wave", "avg_temp", "min_temp", "max_temp", "rainfall"])


@query
def industry_row_counts(spark, sf):
    return panel.row_counts(_joined(spark, sf), "MCT_RY_CD")


@query
def panel_coverage(spark, sf):
    return tidy(panel.coverage_report(fx.wide_panel(spark, sf)))


@query
def series_densified(spark, sf):
    return tidy(panel.densify(fx.panel(spark, sf)))


@query
def key_audits(spark, sf):
    """Violation counts of the key, domain, flag and baseline audits."""
    source = fx.panel(spark, sf)
    lines = fx.table(spark, sf, "lineitem")
    checks = {
        "duplicate_panel_keys": audits.duplicate_keys(source, DEFAULT.key),
        "duplicate_line_keys": audits.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]),
        "null_keys": audits.null_rows(source, DEFAULT.key),
        "null_flags": audits.null_rows(source, ["heatwave"]),
        "flag_domain": audits.outside_domain(source, "heatwave", [0, 1], null_allowed=True),
        "status_domain": audits.outside_domain(lines, "l_linestatus", ["F"], null_allowed=False),
        "flag_conflicts": episodes.flag_conflicts(source),
        "duplicate_hours": weather.duplicate_hours(fx.hourly(spark, sf)),
        "october_not_positive": baseline.october_problems(source),
        "rows_changed_by_join": audits.unequal_counts(source, panel.join_weather(source, fx.weather_days(spark, sf))),
        "varying_status": audits.varying_within(lines, ["l_orderkey"], "l_linestatus"),
        "unmapped_station_days": audits.mixed_station_files(fx.hourly_text(spark, sf), "ts", "station"),
    }
    return violations(checks)


# --- baselines and features ---------------------------------------------------------------


@query
def october_baseline_filter(spark, sf):
    return tidy(baseline.october_baseline(fx.wide_panel(spark, sf), minimum_days=10))


@query
def october_baseline_dense(spark, sf):
    kept = baseline.october_baseline(fx.panel(spark, sf))
    return tidy(kept.select("date", "MCT_SGG_CD", "MCT_RY_CD", "october_mean", "october_n", "Y"))


@query
def october_group_counts(spark, sf):
    source = fx.wide_panel(spark, sf)
    return baseline.group_counts(source, baseline.october_baseline(source, minimum_days=10))


@query
def train_baseline_y1(spark, sf):
    rows, _ = fx.event_rows(spark, sf)
    return tidy(rows.select("disaster_type", "date", "MCT_SGG_CD", "MCT_RY_CD", "split", "base", "actual_y1"))


@query
def train_baselines(spark, sf):
    source = fx.panel(spark, sf)
    dates, _, _ = fx.split_dates(source)
    assigned = splits.attach_split(source, dates)
    parts = [baseline.train_baselines(assigned, h).withColumn("hazard", F.lit(h)) for h in DEFAULT.hazards]
    return tidy(parts[0].unionByName(parts[1]))


@query
def target_audit(spark, sf):
    featured, _ = fx.featured_panel(spark, sf)
    return baseline.target_report(featured)


@query
def calendar_lag_rolling(spark, sf):
    featured = calendar.add_calendar_features(fx.panel(spark, sf))
    return tidy(featured.select("date", "MCT_SGG_CD", "MCT_RY_CD", "lag1", "lag7", "rolling7", "rolling28"))


@query
def customer_lag_rolling(spark, sf):
    featured = calendar.add_calendar_features(fx.customer_panel(spark, sf))
    return tidy(featured.select("date", "MCT_RY_CD", "TS_AT", "lag1", "lag7", "rolling7", "rolling28"))


@query
def customer_october_baseline(spark, sf):
    kept = baseline.october_baseline(fx.customer_panel(spark, sf), minimum_days=1)
    return tidy(kept.select("date", "MCT_RY_CD", "october_mean", "october_n", "Y"))


@query
def lag_audit(spark, sf):
    return calendar.audit_calendar_features(calendar.add_calendar_features(fx.panel(spark, sf)))


@query
def calendar_parts(spark, sf):
    days = fx.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return tidy(
        days.select(scalars.month_of("date").alias("month"), scalars.weekday_of("date").alias("weekday"), scalars.week_start("date").alias("week"))
        .groupBy("week", "month", "weekday")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# --- episodes and splits ------------------------------------------------------------------


@query
def region_day_flags(spark, sf):
    return tidy(episodes.daily_flags(fx.panel(spark, sf)))


@query
def event_episodes(spark, sf):
    found = episodes.find_episodes(episodes.daily_flags(fx.panel(spark, sf)))
    return tidy(episodes.weeks_text(found))


@query
def week_components(spark, sf):
    flags = episodes.daily_flags(fx.panel(spark, sf))
    return tidy(episodes.week_components(flags, episodes.find_episodes(flags)))


@query
def component_stats(spark, sf):
    dates, _, flags = fx.split_dates(fx.panel(spark, sf))
    return episodes.component_stats(dates, flags)


@query
def split_score(spark, sf):
    dates, _, flags = fx.split_dates(fx.panel(spark, sf))
    components = episodes.component_stats(dates, flags)
    c, n = F.col("candidate"), F.col("component_no")
    candidates = components.select("component_no", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("candidate"))
    slot = (n * (c + 3) + c) % 7
    assigned = candidates.withColumn("split", F.when(slot < 5, "train").when(slot == 5, "validation").otherwise("test"))
    return tidy(splits.score_assignments(components, assigned))


@query
def split_leak_audit(spark, sf):
    source = fx.panel(spark, sf)
    dates, found, flags = fx.split_dates(source)
    assigned = splits.attach_split(source, dates)
    # the same dates split by day, which must leak
    slot = F.datediff("date", F.lit("1995-01-01").cast("date")) % 7
    daily = dates.withColumn("split", F.when(slot < 5, "train").when(slot == 5, "validation").otherwise("test"))
    leaky = splits.attach_split(source, daily)
    events = flags.join(dates.select("date", "split"), "date")
    checks = {
        "by_component": splits.split_leaks(assigned),
        "episodes_by_component": splits.episode_leaks(assigned, found),
        "by_day": splits.split_leaks(leaky),
        "episodes_by_day": splits.episode_leaks(leaky, found),
        "empty_hazard_splits": splits.empty_hazard_splits(events),
        "overlapping_episodes": episodes.overlapping_episodes(found),
    }
    return violations(checks)


@query
def split_report(spark, sf):
    dates, found, flags = fx.split_dates(fx.panel(spark, sf))
    return tidy(splits.split_report(dates, found, flags))


@query
def episode_day_map(spark, sf):
    return tidy(episodes.episode_days(episodes.find_episodes(episodes.daily_flags(fx.panel(spark, sf)))))


# --- flow ---------------------------------------------------------------------------------


@query
def flow_profile_unpivot(spark, sf):
    mapped = flow.mapped_flow(fx.flow_text(spark, sf), fx.FLOW_PREFIXES)
    return tidy(flow.flow_profile(mapped, by_year=True).withColumn("flow_pop_weekday", F.round("flow_pop_weekday", 2)))


@query
def flow_coverage(spark, sf):
    return flow.flow_coverage(flow.mapped_flow(fx.flow_text(spark, sf), fx.FLOW_PREFIXES), "STD_YM")


@query
def unknown_prefixes(spark, sf):
    return flow.unknown_prefixes(fx.flow_text(spark, sf), fx.FLOW_PREFIXES)


@query
def flow_audits(spark, sf):
    mapped = flow.mapped_flow(fx.flow_text(spark, sf), fx.FLOW_PREFIXES)
    checks = {
        "bad_files": flow.flow_problems(mapped, "STD_YM"),
        "repeated_rows": flow.repeated_flow_rows(mapped, "STD_YM"),
        "pooled_years": flow.profile_collisions(flow.flow_profile(mapped)),
        "by_year": flow.profile_collisions(flow.flow_profile(mapped, by_year=True)),
    }
    return violations(checks)


@query
def panel_flow_join(spark, sf):
    profile = staged(flow.flow_profile(flow.mapped_flow(fx.flow_text(spark, sf), fx.FLOW_PREFIXES), by_year=True))
    joined = flow.join_flow(fx.panel(spark, sf), profile)
    return tidy(
        joined.select("date", "MCT_SGG_CD", "MCT_RY_CD", "month", "weekday", F.round("flow_pop_weekday", 2).alias("flow_pop_weekday"))
    )


# --- reports on predictions ---------------------------------------------------------------


@query
def regression_metrics(spark, sf):
    scored, _ = fx.predictions(spark, sf)
    out = report.regression_metrics(scored)
    return tidy(out.select(*report.RUN, "split", "n", "mae", "rmse", "r2"))


@query
def mean_predictor_metrics(spark, sf):
    scored, _ = fx.predictions(spark, sf)
    out = report.regression_metrics(scored, ["disaster_type", "model", "feature_set"])
    return tidy(out.select(*report.RUN, "split", "mae_train_mean", "rmse_train_mean", "r2_train_mean"))


def _wide(spark, sf):
    scored, _ = fx.predictions(spark, sf)
    return comparison.wide_metrics(report.regression_metrics(scored))


@query
def metrics_pivot_gaps(spark, sf):
    return tidy(_wide(spark, sf))


@query
def stability_labels(spark, sf):
    out = comparison.stability(_wide(spark, sf))
    return tidy(
        out.select(
            *report.RUN, "train_to_validation_mae_change_pct", "validation_to_test_mae_change_pct",
            "train_to_test_mae_change_pct", "train_to_validation_r2_drop", "validation_to_test_r2_drop", "stability_assessment",
        )
    )


@query
def leaders_topk(spark, sf):
    return tidy(comparison.leaders(_wide(spark, sf)))


@query
def top_runs(spark, sf):
    return comparison.top_runs(_wide(spark, sf))


@query
def subgroup_response(spark, sf):
    scored, _ = fx.predictions(spark, sf)
    return tidy(report.subgroup_response(scored))


@query
def largest_responses(spark, sf):
    groups = report.subgroup_response(fx.saved_run(spark, sf))
    return tidy(report.largest_responses(groups).select("disaster_type", "region", "industry", "n", "observed_mean_y1", "rank"))


@query
def episode_day_summary(spark, sf):
    return tidy(report.episode_day_summary(fx.saved_run(spark, sf)))


@query
def episode_summary(spark, sf):
    return tidy(report.episode_summary(fx.saved_run(spark, sf)))


@query
def industry_episode_comparison(spark, sf):
    return tidy(report.entity_episodes(fx.saved_run(spark, sf), "industry"))


@query
def entity_episode_summary(spark, sf):
    return tidy(report.entity_summary(report.entity_episodes(fx.saved_run(spark, sf), "region"), "region"))


@query
def response_distribution(spark, sf):
    return tidy(report.response_distribution(fx.saved_run(spark, sf)))


@query
def price_distribution(spark, sf):
    """The distribution table over every order line, grouped by return flag and status."""
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("disaster_type"),
        F.col("l_linestatus").alias("split"),
        F.col("l_suppkey").alias("episode_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("actual_y1"),
    )
    out = report.response_distribution(rows)
    return tidy(out.withColumns({c: F.round(c, 3) for c in ("mean", "sd")}))


@query
def industry_episode_summary(spark, sf):
    return tidy(report.entity_summary(report.entity_episodes(fx.saved_run(spark, sf), "industry"), "industry"))


@query
def outlier_sensitivity(spark, sf):
    return tidy(report.outlier_sensitivity(fx.saved_run(spark, sf)))


@query
def outlier_rows(spark, sf):
    rows = report.outlier_rows(fx.saved_run(spark, sf))
    return tidy(
        rows.select("disaster_type", "date", "region", "industry", "error_y1", "abs_error_y1", "train_p01", "train_p99", "outside_train_p01_p99")
    )


@query
def prediction_diff(spark, sf):
    scored, _ = fx.predictions(spark, sf)
    key = ["disaster_type", "date", "region", "industry"]
    a = scored.where("model = 'Ridge' and feature_set = 'B_plus_past_sales'")
    b = scored.where("model = 'Random Forest' and feature_set = 'B_plus_past_sales'")
    return tidy(report.prediction_difference(a, b, key))


# --- importance ---------------------------------------------------------------------------


def fixed_scorer(df: DataFrame) -> DataFrame:
    base = F.col("base")
    moved = (
        0.25 * (F.coalesce("lag1", base) - base)
        + 0.125 * (F.coalesce("lag7", base) - base)
        + 0.0625 * (F.coalesce("rolling7", base) - base)
    )
    return df.withColumn("prediction", 0.5 * (F.col("avg_temp") - 5) + 100 * moved / base)


def _test_events(spark, sf):
    rows, _ = fx.event_rows(spark, sf)
    return rows.where("split = 'test'").select(*EVENT_KEY, "actual_y1", "base", "avg_temp", "lag1", "lag7", "rolling7")


@query
def permutation_importance_linear(spark, sf):
    groups = importance.single_features(["avg_temp", "lag1", "lag7", "rolling7"])
    out = importance.permutation_importance(_test_events(spark, sf), EVENT_KEY, groups, 10, fixed_scorer)
    return tidy(out)


@query
def permutation_importance_grouped(spark, sf):
    out = importance.permutation_importance(_test_events(spark, sf), EVENT_KEY, SCORER_GROUPS, 50, fixed_scorer, seed=7)
    return tidy(out)


def _fitted_importances(spark, sf):
    """Permutation importance of every feature of the fitted ridge of each feature set."""
    source = staged(_model_panel(spark, sf))
    _, scorers = models.run_grid(source, {"Ridge": models.ridge}, models.FEATURE_SETS)
    return models.grid_importance(source, scorers, models.FEATURE_SETS).select(*report.RUN, "feature", "importance_mean")


@query
def importance_top10(spark, sf):
    return tidy(importance.top_features(_fitted_importances(spark, sf), ["disaster_type", "model", "feature_set"]))


@query
def importance_by_group(spark, sf):
    grouped = importance.group_importance(_fitted_importances(spark, sf), report.RUN)
    chosen = comparison.top_runs(_wide(spark, sf)).select(*report.RUN)
    return tidy(grouped.join(chosen, list(report.RUN), "left_semi"))


@query
def importance_two_samples(spark, sf):
    """Features and groups of the fitted ridge of each hazard, on both test samples."""
    source = staged(_model_panel(spark, sf))
    chosen = models.FEATURE_SETS["B_plus_past_sales"]
    _, scorers = models.run_grid(source, {"Ridge": models.ridge}, {"B_plus_past_sales": chosen})
    features = [*chosen["numeric"], *chosen["categorical"]]
    parts = []
    for hazard in DEFAULT.hazards:
        events = models.event_rows(source, hazard).select(
            F.lit(hazard).alias("disaster_type"), "split", *DEFAULT.key, F.col(f"Y1_{hazard}").alias("actual_y1"),
            *[c for c in features if c not in DEFAULT.key],
        )
        score = scorers[hazard, "B_plus_past_sales", "Ridge"]
        parts.append(importance_of_samples(events, list(DEFAULT.key), score, importance.single_features(features), importance.FEATURE_GROUPS))
    return tidy(parts[0].unionByName(parts[1]))


# --- preprocessing and models -------------------------------------------------------------


@query
def impute_scale(spark, sf):
    rows, _ = fx.event_rows(spark, sf)
    train = rows.where("split = 'train'")
    return tidy(preprocess.numeric_statistics(train, ["avg_temp", "min_temp", "max_temp", "lag1", "lag7", "rolling7", "rolling28"], ["disaster_type"]))


@query
def category_modes(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    return preprocess.category_modes(lines, ["l_returnflag", "l_linestatus", "l_suppkey"])


@query
def exact_quantiles_by_supplier(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    return tidy(exact_quantiles(lines, ["l_suppkey"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


def _fit_on_temperature(spark, sf, fitter):
    """One standardised feature, so the closed form is plain SQL."""
    rows, _ = fx.event_rows(spark, sf)
    rows = staged(rows.select("disaster_type", "split", "actual_y1", "avg_temp"))
    assembler = VectorAssembler(inputCols=["x"], outputCol="features")
    parts = []
    for hazard in DEFAULT.hazards:
        events = rows.where(F.col("disaster_type") == hazard)
        train = events.where("split = 'train'")
        mean, sd = train.agg(F.avg("avg_temp"), F.stddev_pop("avg_temp")).first()
        vectors = assembler.transform(events.withColumn("x", (F.col("avg_temp") - mean) / (sd or 1.0)))
        fitted = fitter(vectors.where("split = 'train'"), "actual_y1")
        parts.append(fitted.transform(vectors))
    scored = parts[0].unionByName(parts[1])
    return tidy(
        scored.groupBy("disaster_type", "split").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("prediction").alias("mean_prediction"),
            F.max("prediction").alias("max_prediction"),
            F.avg(F.abs(F.col("prediction") - F.col("actual_y1"))).alias("mae"),
        )
    )


@query
def linear_fit(spark, sf):
    return _fit_on_temperature(spark, sf, models.linear)


@query
def ridge_fit(spark, sf):
    return _fit_on_temperature(spark, sf, models.ridge)


@query
def split_search(spark, sf):
    dates, _, flags = fx.split_dates(fx.panel(spark, sf))
    stats = staged(episodes.component_stats(dates, flags))
    found = staged(splits.search_split(spark, stats))
    plain = dates.select("component_no", "split").distinct()
    candidates = found.select(F.lit(0).alias("candidate"), "component_no", "split").unionByName(
        plain.select(F.lit(1).alias("candidate"), "component_no", "split")
    )
    scores = splits.score_assignments(stats, candidates).agg(
        F.max(F.when(F.col("candidate") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("candidate") == 1, F.col("score"))).alias("b")
    )
    placed = splits.assign_split(dates.drop("split"), found.select("component_no", "split"))
    facts = found.agg(
        F.count(F.lit(1)).alias("components"), F.count_distinct("component_no").alias("distinct_components"),
        F.count_distinct("split").alias("splits"), F.min("score").alias("score"),
    )
    leaks = splits.split_leaks(placed).agg(F.count(F.lit(1)).alias("leaks"))
    return facts.join(scores).join(leaks).select(
        "components", "distinct_components", "splits", "leaks",
        (F.col("a") <= F.col("b") + 1e-9).alias("no_worse_than_arithmetic"), (F.abs(F.col("a") - F.col("score")) < 1e-9).alias("score_agrees"),
    )


def _model_panel(spark, sf):
    source = fx.panel(spark, sf)
    profile = staged(flow.flow_profile(flow.mapped_flow(fx.flow_text(spark, sf), fx.FLOW_PREFIXES), by_year=True))
    dates, _, _ = fx.split_dates(source)
    assigned = flow.join_flow(splits.attach_split(source, dates), profile)
    return calendar.add_calendar_features(baseline.add_targets(assigned))


LINEAR = {n: models.MODELS[n] for n in ("Linear Regression", "Ridge")}


@query
def model_grid_linear(spark, sf):
    """Least squares and ridge on every feature set, the one with month and weekday too: the
    fit's errors per split, which SQL has from the normal equations. Least squares is compared on
    the train rows, where it is unique even if columns depend on each other."""
    sets = {**models.FEATURE_SETS, "calendar": models.CALENDAR_SET}
    scored, _ = models.run_grid(_model_panel(spark, sf), LINEAR, sets)
    y, p = F.col("actual_y1"), F.col("predicted_y1")
    return tidy(
        scored.where("model = 'Ridge' OR split = 'train'").groupBy(*report.RUN, "split").agg(
            F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_actual_y1"), F.avg(p).alias("mean_prediction"),
            F.avg(F.abs(p - y)).alias("mae"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        )
    )


def best_single_split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least squared error of ``y`` that one test reaches per group: a whole degree of avg_temp
    at most, a region, or an industry."""
    def test(kind: str, value, place) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), place.cast("long").alias("place"))

    degree = F.floor("avg_temp")
    tests = F.array(test("degree", degree, degree), *[test(c, F.col(c), F.lit(0)) for c in ("region", "industry")])
    cells = rows.select(*keys, "y", F.inline(tests)).where("value IS NOT NULL").groupBy(*keys, "kind", "value", "place").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")
    )
    # a row per value: the values of one test are days' degrees, regions or industries
    below = W.partitionBy(*keys, "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    ordered = F.col("kind") == "degree"
    left = cells.withColumn("ln", F.when(ordered, F.sum("n").over(below)).otherwise(F.col("n")))
    left = left.withColumn("ls", F.when(ordered, F.sum("s").over(below)).otherwise(F.col("s")))
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tn"), F.sum("y").alias("ts"), F.sum(F.col("y") * F.col("y")).alias("tq"))
    right_n, right_s = F.col("tn") - F.col("ln"), F.col("ts") - F.col("ls")
    error = F.col("tq") - F.col("ls") * F.col("ls") / F.col("ln") - right_s * right_s / F.nullif(right_n, F.lit(0))
    return left.join(whole, keys).groupBy(*keys).agg(F.min(error).alias("best_split_sse"))


def _tree_facts(spark, sf, fitters, inside=False):
    """Rows and mean of each split, and how the train rows are fitted: no worse than by the best
    single test, which SQL finds too; tree averages stay ``inside`` the train range."""
    source = staged(_model_panel(spark, sf))
    scored, _ = models.run_grid(source, fitters, {"B_plus_past_sales": models.FEATURE_SETS["B_plus_past_sales"]})
    y, p = F.col("actual_y1"), F.col("predicted_y1")
    run = list(report.RUN)
    weather_of = source.select("date", F.col(DEFAULT.region).alias("region"), F.col(DEFAULT.industry).alias("industry"), "avg_temp")
    train = scored.where("split = 'train'").withColumn("y", y)
    best = best_single_split(train.join(weather_of, ["date", "region", "industry"]), run)
    taught = train.groupBy(*run).agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.stddev_pop(y).alias("spread"), F.sum((p - y) * (p - y)).alias("sse"))
    slack = 1e-6 * (F.col("spread") + 1)
    outside = (p < F.col("lo") - slack) | (p > F.col("hi") + slack)
    return tidy(
        scored.join(taught.join(best, run), run).groupBy(*run, "split").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("mean_actual_y1"),
            F.count_if(p.isNull() | F.isnan(p)).alias("without_prediction"),
            F.count_if(outside if inside else F.lit(False)).alias("outside_train_range"),
            F.max("best_split_sse").alias("best_split_sse"),
            F.bool_and(F.col("sse") <= F.col("best_split_sse")).alias("no_worse_than_best_split"),
        )
    )


@query
def refit_reproduction(spark, sf):
    """The same run fitted twice from the same panel: every prediction within 1e-7."""
    source = staged(_model_panel(spark, sf))
    chosen = {"B_plus_past_sales": models.FEATURE_SETS["B_plus_past_sales"]}
    saved, refit = (models.run_grid(source, {"Ridge": models.ridge}, chosen)[0] for _ in range(2))
    return tidy(require_refit(saved, refit).withColumn("reproduced", F.col("max_absolute_difference") <= 1e-7).drop("max_absolute_difference"))


@query
def forest_metrics(spark, sf):
    return _tree_facts(spark, sf, {"Random Forest": models.forest}, inside=True)


@query
def extra_trees_metrics(spark, sf):
    return _tree_facts(spark, sf, {"Extra Trees": models.extra_trees}, inside=True)


@query
def squared_boosting_metrics(spark, sf):
    return _tree_facts(spark, sf, {"HistGradientBoosting": models.squared_boosting})


@query
def huber_boosting_metrics(spark, sf):
    return _tree_facts(spark, sf, {"Gradient Boosting": models.huber_boosting})


@query
def boosting_first_split(spark, sf):
    """One tree of two leaves on whole degrees, month, weekday, region and industry: rows,
    summed residual and value of both leaves, which SQL finds by trying every test."""
    rows = _model_panel(spark, sf).withColumn("degree", F.floor("avg_temp"))
    parts = []
    for hazard in DEFAULT.hazards:
        events = models.event_rows(rows, hazard).where("split = 'train'")
        events = staged(events.select(F.col(f"Y1_{hazard}").alias("y"), "degree", "month", "weekday", *DEFAULT.entity))
        names = [(c, r[0]) for c in DEFAULT.entity for r in events.select(c).distinct().orderBy(c).collect()]
        flags = {f"is_{i}": (F.col(c) == v).cast("double") for i, (c, v) in enumerate(names)}
        vectors = VectorAssembler(inputCols=["degree", "month", "weekday", *flags], outputCol="features").transform(events.withColumns(flags))
        fitted = LeafBoosting.fit(vectors, "y", stages=1, rate=1.0, leaves=2)
        leaf = fitted.transform(vectors).groupBy("prediction").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("y") - fitted.start).alias("leaf_sum")
        )
        parts.append(leaf.select(F.lit(hazard).alias("disaster_type"), "n", "leaf_sum", (F.col("prediction") - fitted.start).alias("leaf_value")))
    return tidy(parts[0].unionByName(parts[1]))


@query
def impact_pipeline(spark, sf):
    """Panel to audited targets and features behind a searched split: event rows per hazard and
    entity, all with a target in season, and the splits they fall in."""
    tables = build_impact(fx.panel(spark, sf))
    flags = F.array(*[F.struct(F.lit(h).alias("disaster_type"), F.col(h).alias("flag"), F.col(f"Y1_{h}").isNotNull().alias("has_target")) for h in DEFAULT.hazards])
    events = tables.panel.select("split", *DEFAULT.entity, F.inline(flags)).where("flag = 1")
    per_hazard = events.groupBy("disaster_type").agg(F.count_distinct("split").alias("splits"))
    return tidy(
        events.groupBy("disaster_type", *DEFAULT.entity)
        .agg(F.count(F.lit(1)).alias("event_rows"), F.count_if("has_target").alias("with_target"))
        .join(per_hazard, "disaster_type")
    )


# --- raw files ----------------------------------------------------------------------------


def _dealt(df: DataFrame, files: int) -> DataFrame:
    """``df`` in ``files`` partitions, each with rows where there are enough."""
    return df.repartition(files, *[F.col(f"`{c}`") for c in df.columns[:2]])


def _scanned(df: DataFrame, files: int, exactly: bool = False) -> DataFrame:
    """A table straight from a scan in at least, or exactly, ``files`` partitions with rows. No row
    is shuffled where the scan has enough of them; else the table is small and dealt out."""
    parts, filled = df.rdd.getNumPartitions(), df.select(F.spark_partition_id()).distinct().count()
    if not exactly and filled >= files:
        return df
    # neighbours are put together: fewer empty ones than a group has cannot empty it
    return df.coalesce(files) if exactly and parts - filled < parts // files else _dealt(df, files)


def _as_files(spark, out: DataFrame, sep: str, encoding: str, path: str | None = None, extension: str = "csv") -> str:
    """A table in the form of a raw text file, a part file of a shared folder for each partition
    with rows."""
    # Korean text needs the JVM's own charsets
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = path or f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    out.write.options(header=True, sep=sep, encoding=encoding, quoteAll=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, extension=extension).csv(path)
    return path


@query
def card_files(spark, sf):
    """Transactions written as tab-separated cp949 text, read back and folded per day."""
    text = fx.card_text(spark, sf).withColumn("TIME_GB", F.lit("서울"))
    path = _as_files(spark, _scanned(text, 4), "\t", readers.KOREAN)
    daily = cards.daily_aggregate(cards.parse_transactions(readers.read_card(spark, path)))
    return tidy(daily.withColumn("ts_at_text", parsing.plain_decimal_text(F.col("TS_AT"))), ("avg_price",))


@query
def picked_source(spark, sf):
    """Transactions found by their header among folders of text files: a folder with other
    columns stands first, and tab-separated files stand behind. The chosen folder is folded per
    day; its name and the number of files read go with it."""
    root = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    text = fx.card_text(spark, sf).withColumn("TIME_GB", F.lit("서울"))
    _as_files(spark, _dealt(fx.flow_text(spark, sf), 2), "\t", readers.KOREAN, f"{root}/1-flow", "txt")
    _as_files(spark, _scanned(text, 4, exactly=True), "\t", readers.KOREAN, f"{root}/2-card", "txt")
    _as_files(spark, _dealt(text.limit(0), 1), "\t", readers.KOREAN, f"{root}/0-late", "tsv")
    folder = readers.pick_source(spark, f"{root}/*").rpartition("/")[0]
    raw = readers.read_card(spark, folder)
    name, read = folder.rpartition("/")[2], readers.source_manifest(raw).agg(F.count(F.lit(1)).alias("files_read"))
    daily = cards.daily_aggregate(cards.parse_transactions(raw))
    facts = daily.withColumn("ts_at_text", parsing.plain_decimal_text(F.col("TS_AT"))).withColumn("folder", F.lit(name)).join(read)
    return tidy(facts, ("avg_price",))


@query
def run_metadata(spark, sf):
    """Facts of one saved run, written as JSON and read back: its rows, days and means, whether
    its predictors are allowed, and whether outcome columns and an absent run are refused."""
    scored, _ = fx.predictions(spark, sf)
    chosen = report.select_run(scored, "Ridge", "B_plus_past_sales")
    features = [c for names in models.FEATURE_SETS["B_plus_past_sales"].values() for c in names]
    audits.require_allowed_features(features)

    def refused(check) -> Column:
        try:
            check()
        except ValueError:
            return F.lit(True)
        return F.lit(False)

    facts = chosen.groupBy("model", "feature_set").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS], F.avg("actual_y1").alias("mean_actual_y1"),
        F.avg(F.abs(F.col("actual_y1") - F.col("predicted_y1"))).alias("mae"),
        F.lit("|".join(features)).alias("features"),
        refused(lambda: audits.require_allowed_features([*features, DEFAULT.measure])).alias("outcome_refused"),
        refused(lambda: report.select_run(scored, "Ridge", "absent")).alias("absent_run_refused"),
    )
    path = f"{shared_folder(spark)}/metadata-{uuid.uuid4().hex}"
    writers.write_metadata(facts, path)
    return tidy(spark.read.schema(facts.schema).json(path))


@query
def warning_files(spark, sf):
    """Three heat files and two cold files as text, read back and united."""
    heat_path = _as_files(spark, _dealt(fx.heat_text(spark, sf), readers.HEAT_FILES), "\t", readers.KOREAN)
    cold_path = _as_files(spark, _dealt(fx.cold_text(spark, sf), readers.COLD_FILES), "\t", readers.KOREAN)
    heat = readers.read_heat_warnings(spark, f"{heat_path}/part-*")
    cold = readers.read_cold_warnings(spark, f"{cold_path}/part-*")
    united = weather.warnings_union(weather.heat_warnings(heat, fx.STATION_REGIONS), weather.cold_warnings(cold, fx.STATION_REGIONS))
    return tidy(united, TEMPERATURES)


@query
def hourly_files(spark, sf):
    """Hourly rain as comma-separated text, read back and folded to days."""
    raw = fx.hourly_text(spark, sf).select(
        F.col("station").alias(weather.STATION), F.lit("관측소").alias(readers.STATION_NAME), F.col("ts").alias(weather.DAY), F.col("rain").alias(readers.RAIN)
    )
    path = _as_files(spark, _dealt(raw, 3), ",", readers.KOREAN)
    hours = weather.hourly_observations(readers.read_hourly(spark, f"{path}/part-*"), weather.STATION, weather.DAY, readers.RAIN, fx.STATION_REGIONS)
    return tidy(weather.daily_rain(hours))


@query
def flow_files(spark, sf):
    """Weekday flow as text between bars, read back and unpivoted."""
    path = _as_files(spark, _dealt(fx.flow_text(spark, sf), 3), "|", "UTF-8")
    mapped = flow.mapped_flow(readers.read_flow(spark, f"{path}/part-*"), fx.FLOW_PREFIXES)
    return tidy(flow.flow_profile(mapped, by_year=True).withColumn("flow_pop_weekday", F.round("flow_pop_weekday", 2)))


@query
def result_csv_round_trip(spark, sf):
    """Saved predictions written as an ordered exchange file with byte order marks and read back
    with their types."""
    run = fx.saved_run(spark, sf)
    path = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    columns = {c: t for c, t in run.dtypes if c in ("disaster_type", "episode_id", "date", "split", "region", "industry", "actual_y1", "predicted_y1")}
    writers.write_csv(run.select(*columns), path, order_by=["disaster_type", "date", "region", "industry"], bom=True)
    try:
        writers.write_csv(run.select(*columns), path)
    except AnalysisException:
        refused = True
    else:
        refused = False
    return tidy(report.episode_day_summary(readers.read_result_csv(spark, path, columns))).withColumn("second_write_refused", F.lit(refused))
