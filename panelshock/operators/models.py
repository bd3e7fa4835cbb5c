"""Regression models over event rows and the grid that compares them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.functions.parsing import lookup
from panelshock.operators.audits import require_allowed_features
from panelshock.operators.boosting import HuberBoosting, LeafBoosting
from panelshock.operators.extra_trees import ExtraTrees
from panelshock.operators.importance import REPORT_GROUPS, permutation_importance, single_features
from panelshock.operators.least_squares import LeastSquares
from panelshock.operators.preprocess import Preprocessor
from panelshock.session import staged
from panelshock.spec import DEFAULT, SPLITS, PanelSpec

SEED = 20261003
RIDGE_ALPHA = 10.0
FOREST_BINS = 1024
# Predictors of each feature set.
WEATHER = ["avg_temp", "min_temp", "max_temp"]
HISTORY = ["lag1", "lag7", "rolling7", "rolling28"]
CATEGORICAL = ["MCT_SGG_CD", "MCT_RY_CD"]
FEATURE_SETS = {
    "A_weather_region_industry": {"numeric": WEATHER, "categorical": CATEGORICAL},
    "B_plus_past_sales": {"numeric": WEATHER + HISTORY, "categorical": CATEGORICAL},
    "C_plus_flow_population": {"numeric": WEATHER + HISTORY + ["flow_pop_weekday"], "categorical": CATEGORICAL},
}
CALENDAR_SET = {"numeric": WEATHER + ["month", "weekday"] + HISTORY, "categorical": CATEGORICAL}
Fitter = Callable[[DataFrame, str], object]


def linear(train: DataFrame, label: str):
    """Least squares; of dependent columns the weights of least norm."""
    return LeastSquares.fit(train, label)


def ridge(train: DataFrame, label: str, alpha: float = RIDGE_ALPHA):
    """Squared error plus alpha times the squared weights, exact for any number of features."""
    return LeastSquares.fit(train, label, alpha)


def forest(train: DataFrame, label: str, trees: int = 400, depth: int = 30, seed: int = SEED):
    """400 trees, at least 3 rows per leaf, 80 % of the features per split. A feature is cut at
    up to 1,023 places, which is every place where it has no more distinct values."""
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=trees, minInstancesPerNode=3,
        featureSubsetStrategy="0.8", maxDepth=depth, maxBins=FOREST_BINS, seed=seed,
    ).fit(train)


def huber_boosting(train: DataFrame, label: str, stages: int = 200):
    return HuberBoosting.fit(train, label, stages=stages)


def squared_boosting(train: DataFrame, label: str, stages: int = 200):
    """Squared loss, rate 0.05, best-first trees of 15 leaves, L2 penalty 2."""
    return LeafBoosting.fit(train, label, stages=stages)


def extra_trees(train: DataFrame, label: str, trees: int = 400, seed: int = SEED):
    """400 trees of drawn thresholds, at least 3 rows per leaf, 80 % of the features per node."""
    return ExtraTrees.fit(train, label, trees=trees, seed=seed)


MODELS: dict[str, Fitter] = {
    "Linear Regression": linear,
    "Ridge": ridge,
    "Random Forest": forest,
    "Gradient Boosting": huber_boosting,
    "Extra Trees": extra_trees,
    "HistGradientBoosting": squared_boosting,
}


def event_rows(panel: DataFrame, hazard: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows with the flag set and a target."""
    return panel.where((F.col(hazard) == 1) & F.col(f"Y1_{hazard}").isNotNull())


def require_all_splits(events: DataFrame, hazard: str) -> None:
    found = {r["split"] for r in events.select("split").distinct().collect()}
    missing = [s for s in SPLITS if s not in found]
    if missing:
        raise ValueError(f"no {hazard} event rows in {missing}")


def run_grid(
    panel: DataFrame,
    models: dict[str, Fitter],
    feature_sets: dict[str, dict[str, list[str]]] | None = None,
    spec: PanelSpec = DEFAULT,
    at_once: int = 4,
) -> tuple[DataFrame, dict[tuple[str, str, str], Callable[[DataFrame], DataFrame]]]:
    """Fit every hazard x feature set x model on the shared split.

    Returns the long predictions table and the scorers, functions that add ``prediction``.
    Per hazard, event rows are staged and preprocessing is fitted once for all sets. Fits are
    chains of short jobs, so ``at_once`` of them run side by side."""
    feature_sets = feature_sets or FEATURE_SETS
    for chosen in feature_sets.values():
        require_allowed_features(chosen["numeric"] + chosen["categorical"], panel.columns)
    numeric = list(dict.fromkeys(c for s in feature_sets.values() for c in s["numeric"]))
    categorical = list(dict.fromkeys(c for s in feature_sets.values() for c in s["categorical"]))
    wanted = []
    for hazard in spec.hazards:
        label = f"Y1_{hazard}"
        needed = list(dict.fromkeys([*spec.key, "split", label, *numeric, *categorical]))
        events = staged(event_rows(panel, hazard, spec).select(*needed))
        require_all_splits(events, hazard)
        prepared = Preprocessor.fit(events.where("split = 'train'"), numeric, categorical)
        for set_name, chosen in feature_sets.items():
            vectors = staged(prepared.vectors(events, **chosen).select(*spec.key, "split", label, "features"))
            wanted += [(hazard, set_name, name, prepared, vectors, fitter) for name, fitter in models.items()]

    def fit(one):
        hazard, _, _, _, vectors, fitter = one
        return fitter(vectors.where("split = 'train'").select("features", f"Y1_{hazard}"), f"Y1_{hazard}")

    session = panel.sparkSession
    with ThreadPoolExecutor(at_once) as pool:
        futures = [pool.submit(inheritable_thread_target(session)(fit), one) for one in wanted]
        fits = [f.result() for f in futures]
    parts, scorers = [], {}
    for (hazard, set_name, model_name, prepared, vectors, _), fitted in zip(wanted, fits):
        scorers[hazard, set_name, model_name] = scorer(prepared, feature_sets[set_name], fitted)
        parts.append(
            fitted.transform(vectors).select(
                F.col(spec.date).alias("date"),
                F.col(spec.region).alias("region"),
                F.col(spec.industry).alias("industry"),
                F.lit(hazard).alias("disaster_type"),
                F.col(f"Y1_{hazard}").alias("actual_y1"),
                F.col("prediction").alias("predicted_y1"),
                F.lit(model_name).alias("model"),
                F.lit(set_name).alias("feature_set"),
                "split",
            )
        )
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    # written once: every metric and report would score all models again
    return staged(predictions), scorers


def scorer(prepared: Preprocessor, chosen: dict[str, list[str]], fitted) -> Callable[[DataFrame], DataFrame]:
    """Adds ``prediction`` to rows with the raw feature columns."""

    def score(df: DataFrame) -> DataFrame:
        return fitted.transform(prepared.vectors(df, **chosen)).drop("features")

    return score


def grid_importance(
    panel: DataFrame,
    scorers: dict[tuple[str, str, str], Callable[[DataFrame], DataFrame]],
    feature_sets: dict[str, dict[str, list[str]]],
    repeats: int = 5,
    seed: int = SEED,
    spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """Permutation importance of every feature of every fitted run on its test rows."""
    parts = []
    for hazard in spec.hazards:
        label = f"Y1_{hazard}"
        test = staged(event_rows(panel, hazard, spec).where("split = 'test'").withColumn("disaster_type", F.lit(hazard)))
        for (fitted_hazard, set_name, model_name), score in scorers.items():
            if fitted_hazard != hazard:
                continue
            features = [*feature_sets[set_name]["numeric"], *feature_sets[set_name]["categorical"]]
            rows = test.select("disaster_type", *dict.fromkeys([*spec.key, label, *features]))
            found = permutation_importance(
                rows, spec.key, single_features(features), repeats, score, label, ("disaster_type",), seed
            )
            parts.append(
                found.select(
                    "disaster_type",
                    F.lit(model_name).alias("model"),
                    F.lit(set_name).alias("feature_set"),
                    F.col("feature_group").alias("feature"),
                    F.coalesce(lookup("feature_group", REPORT_GROUPS), F.lit("other")).alias("feature_group"),
                    "importance_mean",
                    F.col("importance_sd_pop").alias("importance_std"),
                    F.col("n_rows").alias("n_test_rows"),
                    "permutation_repeats",
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
