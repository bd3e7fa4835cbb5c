"""End-to-end jobs composed of operators. Each step hands over a DataFrame; write it with
``sources.writers.write_table`` where several later steps read it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshock.functions.parsing import strict_date
from panelshock.functions.scalars import month_of, weekday_of
from panelshock.operators import (
    audits, baseline, calendar, cards, episodes, flow, importance, panel, report, splits, weather,
)
from panelshock.session import staged
from panelshock.sources import readers
from panelshock.spec import DEFAULT, RATIOS, SPLITS, PanelSpec


def build_card_panel(raw: DataFrame) -> DataFrame:
    """Raw transaction text to the daily aggregate with a real ``date``."""
    daily = cards.daily_aggregate(cards.parse_transactions(raw))
    return daily.withColumn("date", strict_date("TA_YMD")).drop("TA_YMD")


def build_weather(
    heat_raw: DataFrame, cold_raw: DataFrame, hourly_raw: DataFrame,
    warning_stations: dict[str, str], rain_stations: dict[str, str], only_known_stations: bool = False,
) -> DataFrame:
    """Raw warning and hourly text to daily weather with the rolling exposure.

    Hourly rows of unmapped stations are skipped, or refused with ``only_known_stations``."""
    for raw in (heat_raw, cold_raw):
        audits.enforce(weather.missing_stations(raw, warning_stations, readers.FILE), "station missing in a warning file")
    audits.enforce(
        audits.mixed_station_files(hourly_raw, readers.FILE, weather.STATION), "several stations in an hourly file"
    )
    if only_known_stations:
        unknown = weather.unknown_stations(hourly_raw, weather.STATION, rain_stations)
        audits.enforce(unknown, "unexpected station in an hourly file")
    hourly = staged(
        weather.hourly_observations(hourly_raw, weather.STATION, weather.DAY, readers.RAIN, rain_stations)
    )
    regions = sorted(set(rain_stations.values()))
    audits.enforce(weather.regions_without_hours(hourly, regions), "region without hourly observations")
    audits.enforce(weather.duplicate_hours(hourly), "duplicate hourly timestamps")
    heat = weather.heat_warnings(heat_raw, warning_stations)
    cold = weather.cold_warnings(cold_raw, warning_stations)
    audits.enforce(
        audits.duplicate_keys(weather.warnings_union(heat, cold), ["date", "MCT_SGG_CD"]),
        "duplicate date-region key in warning rows",
    )
    daily = weather.daily_weather(heat, cold, hourly, regions)
    return weather.attach_exposure(daily, weather.rolling_exposure(hourly))


def build_panel(card: DataFrame, daily_weather: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Card aggregate with its day's weather; key audits before, row-count audit after. Both
    sides are staged, so raw files are parsed once for the audits and the join."""
    card = staged(panel.normalise_keys(card, spec.entity))
    daily_weather = staged(panel.normalise_keys(daily_weather, [spec.region]))
    audits.enforce(audits.null_rows(card, [spec.date, spec.region]), "null join keys in the card table")
    audits.enforce(audits.null_rows(daily_weather, [spec.date, spec.region]), "null join keys in the weather table")
    audits.enforce(audits.duplicate_keys(card, spec.key), "duplicate date-region-industry keys")
    audits.enforce(audits.duplicate_keys(daily_weather, [spec.date, spec.region]), "duplicate date-region keys")
    joined = panel.panel_columns(panel.join_weather(card, daily_weather, spec))
    audits.enforce(audits.unequal_counts(card, joined), "row count changed by the weather join")
    return joined


@dataclass
class ImpactTables:
    """What the modelling steps share."""

    panel: DataFrame
    episodes: DataFrame
    split_dates: DataFrame
    baselines: dict[str, DataFrame]


def build_impact(
    source: DataFrame,
    profile: DataFrame | None = None,
    restarts: int = splits.RESTARTS,
    seed: int = splits.SEED,
    spec: PanelSpec = DEFAULT,
) -> ImpactTables:
    """Episodes, leak-free split, targets and calendar features of a panel, audited.

    The small tables are staged: the split is searched once, every later read sees the same
    one, and the planner knows the sizes it joins."""
    audits.require_columns(source, [*spec.key, spec.measure, *spec.hazards])
    audits.enforce(audits.null_rows(source, [*spec.key, spec.measure]), "null key, date or measure")
    audits.enforce(audits.duplicate_keys(source, spec.key), "duplicate date-region-industry keys")
    audits.enforce(episodes.flag_conflicts(source, spec), "event flag differs between industries")
    flags = staged(episodes.daily_flags(source, spec))
    found = staged(episodes.find_episodes(flags, spec))
    dates = staged(episodes.week_components(flags, found, spec.date))
    stats = episodes.component_stats(dates, flags, spec)
    assignment = splits.search_split(source.sparkSession, stats, restarts, seed, spec=spec)
    split_dates = staged(splits.assign_split(dates, assignment))
    events = flags.withColumnRenamed(spec.date, "date").join(split_dates.select("date", "split"), "date")
    audits.enforce(splits.empty_hazard_splits(events, spec), "a hazard is absent from a split")
    assigned = splits.attach_split(source, split_dates, spec).withColumns(
        {"month": month_of(spec.date), "weekday": weekday_of(spec.date)}
    )
    audits.enforce(splits.split_leaks(assigned), "a date, week or component is in two splits")
    audits.enforce(splits.episode_leaks(assigned, found, spec), "an episode is in two splits")
    if profile is not None:
        profile = staged(profile)
        audits.enforce(flow.profile_collisions(profile), "duplicate region-month-weekday keys")
        assigned = flow.join_flow(assigned, profile, spec)
    featured = calendar.add_calendar_features(baseline.add_targets(assigned, spec), spec)
    for hazard in spec.hazards:
        audits.enforce(baseline.missing_baselines(featured, hazard, spec), f"no positive train baseline for {hazard}")
    bases = {h: baseline.train_baselines(assigned, h, spec) for h in spec.hazards}
    return ImpactTables(featured, found, split_dates, bases)


def flow_metadata(raw: DataFrame, prefixes: dict[str, str], joined: DataFrame) -> DataFrame:
    """One row about the flow feature: files, ignored prefixes, coverage per file, and panel
    rows with and without a value. ``raw`` comes from ``read_flow``. Lists are bounded by the
    number of files and of prefixes."""
    coverage = flow.flow_coverage(flow.mapped_flow(raw, prefixes), readers.FILE)
    ignored = flow.unknown_prefixes(raw, prefixes).agg(F.array_sort(F.collect_list("prefix")).alias("v"))
    files = readers.source_manifest(raw).agg(F.array_sort(F.collect_list("file")).alias("v"))
    per_file = coverage.agg(F.array_sort(F.collect_list(F.struct(*coverage.columns))).alias("v"))
    return joined.agg(
        F.count("flow_pop_weekday").alias("matched_feature_rows"),
        F.count_if(F.col("flow_pop_weekday").isNull()).alias("unmatched_feature_rows"),
    ).select(
        files.scalar().alias("source_files"),
        F.create_map(*[F.lit(x) for item in prefixes.items() for x in item]).alias("prefix_to_region"),
        ignored.scalar().alias("ignored_block_prefixes"),
        per_file.scalar().alias("coverage"),
        "*",
    )


def run_config(spark: SparkSession, seed: int, feature_sets: dict[str, dict[str, list[str]]], models: list[str]) -> DataFrame:
    """One row of the choices that define a modelling run."""
    sets = [(name, [*s["numeric"], *s["categorical"]]) for name, s in feature_sets.items()]
    row = (seed, dict(RATIOS), dict(sets), sorted(audits.FORBIDDEN_FEATURES), dict(calendar.LAGS), dict(calendar.ROLLING), list(models))
    return spark.createDataFrame(
        [row],
        "seed long, ratios map<string,double>, feature_sets map<string,array<string>>, excluded_features array<string>, "
        "lag_days map<string,int>, rolling_days map<string,int>, models array<string>",
    )


def analysis_config(saved: DataFrame, refit: DataFrame) -> DataFrame:
    """One row per hazard: train bounds and rows, and how closely a refit reproduces the saved
    predictions."""
    key = ["disaster_type", "date", "region", "industry"]
    difference = report.prediction_difference(saved, refit, key).select("max_absolute_difference")
    train = saved.where("split = 'train'").groupBy("disaster_type").agg(F.count(F.lit(1)).alias("train_n"))
    return report.train_bounds(saved).join(train, "disaster_type").withColumn(
        "saved_prediction_max_absolute_difference", difference.scalar()
    )


def require_refit(saved: DataFrame, refit: DataFrame) -> DataFrame:
    """Compare a refit with the saved predictions of the same run on every split; a row that
    one side lacks or a difference above 1e-7 raises. Returns one row per split."""
    key = ["disaster_type", "date", "region", "industry"]
    parts = []
    for split in SPLITS:
        left, right = (df.where(F.col("split") == split) for df in (saved, refit))
        report.require_reproduced(left, right, key)
        parts.append(report.prediction_difference(left, right, key).select(F.lit(split).alias("split"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def importance_of_samples(
    rows: DataFrame, keys: list[str], scorer: importance.Scorer,
    single: dict[str, tuple[str, ...]], grouped: dict[str, tuple[str, ...]],
    single_repeats: int = 30, grouped_repeats: int = 50, seed: int = 20261003,
) -> DataFrame:
    """Permutation importance of single features and of groups on both test samples.

    ``rows`` has actual_y1, split, hazard and the features; ``scorer`` adds ``prediction``."""
    samples = staged(report.sample_rows(rows))
    within = ("disaster_type", "sample")
    parts = [
        importance.permutation_importance(samples, keys, groups, repeats, scorer, within=within, seed=seed).withColumn("kind", F.lit(kind))
        for kind, groups, repeats in (("single", single, single_repeats), ("group", grouped, grouped_repeats))
    ]
    return parts[0].unionByName(parts[1])


def response_report(predictions: DataFrame, found: DataFrame, model: str, feature_set: str) -> dict[str, DataFrame]:
    """Every summary table of one model's saved predictions."""
    audits.enforce(episodes.overlapping_episodes(found), "overlapping episodes")
    saved = episodes.attach_episode(report.select_run(predictions, model, feature_set), found)
    audits.enforce(saved.where(F.col("episode_id").isNull()), "predictions that map to no episode")
    industry = report.entity_episodes(saved, "industry")
    region = report.entity_episodes(saved, "region")
    return {
        "metrics": report.regression_metrics(saved, ["disaster_type"]),
        "episode_summary": report.episode_summary(saved),
        "episode_day_summary": report.episode_day_summary(saved),
        "industry_episode_comparison": industry,
        "industry_episode_summary": report.entity_summary(industry, "industry"),
        "region_episode_comparison": region,
        "region_episode_summary": report.entity_summary(region, "region"),
        "response_distribution": report.response_distribution(saved),
        "outlier_sensitivity": report.outlier_sensitivity(saved),
        "outlier_rows": report.outlier_rows(saved),
    }
