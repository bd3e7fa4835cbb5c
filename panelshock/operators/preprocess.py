"""Train-fitted imputation, scaling and one-hot encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshock.functions.ordering import exact_quantiles
from panelshock.session import staged


def numeric_statistics(train: DataFrame, numeric: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(within, feature, rows, missing, median, mean, sd): the exact median of the present
    values (0 when there is none), then mean and population sd after filling with it."""
    within = list(within)
    long = train.select(*within, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        within, list(numeric), "feature", "value"
    )
    keys = [*within, "feature"]
    medians = exact_quantiles(long, keys, "value", {"median": 0.5})
    # a first pass, one row per feature, staged so that the planner sees the size
    filled = (
        long.join(staged(medians), keys, "left")
        .withColumn("median", F.coalesce("median", F.lit(0.0)))
        .withColumn("filled", F.coalesce("value", "median"))
    )
    return filled.groupBy(*keys, "median").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("filled").alias("mean"),
        F.stddev_pop("filled").alias("sd"),
    )


def category_modes(train: DataFrame, categorical: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(within, feature, mode): the most frequent value, ties by the smallest. Values are
    counted before they are compared."""
    within = list(within)
    long = train.select(*within, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        within, list(categorical), "feature", "value"
    )
    counts = long.where("value is not null").groupBy(*within, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*within, "feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


@dataclass
class Preprocessor:
    """Constants and encoders fitted once on train rows; ``vectors`` serves any subset of the
    fitted columns."""

    constants: dict[str, tuple[float, float, float]]
    modes: dict[str, str | None]
    encoder: PipelineModel

    @classmethod
    def fit(cls, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preprocessor:
        # one row per feature reaches the driver
        stats = {r["feature"]: (r["median"], r["mean"], r["sd"]) for r in numeric_statistics(train, numeric).collect()}
        found = {r["feature"]: r["mode"] for r in category_modes(train, categorical).collect()}
        modes = {c: found.get(c) for c in categorical}
        indexed = [f"__index_{c}" for c in categorical]
        stages = [
            StringIndexer(
                inputCols=[f"__cat_{c}" for c in categorical], outputCols=indexed,
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=[f"__onehot_{c}" for c in categorical], dropLast=True),
        ]
        encoder = Pipeline(stages=stages).fit(train.select(*[_category(c, modes).alias(f"__cat_{c}") for c in categorical]))
        return cls(stats, modes, encoder)

    def vectors(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
        """Add ``features``: scaled numerics, then one-hot categories; an unseen category is
        all zeros."""
        scaled = {}
        for c in numeric:
            median, mean, sd = self.constants[c]
            scaled[f"__num_{c}"] = (F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / (sd or 1.0)
        texts = {f"__cat_{c}": _category(c, self.modes) for c in self.modes}
        encoded = self.encoder.transform(df.withColumns({**scaled, **texts}))
        parts = [*scaled, *[f"__onehot_{c}" for c in categorical]]
        helpers = [f"__{kind}_{c}" for c in self.modes for kind in ("cat", "index", "onehot")]
        return VectorAssembler(inputCols=parts, outputCol="features").transform(encoded).drop(*helpers, *scaled)


def _category(c: str, modes: dict[str, str | None]) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(modes[c] or ""))
