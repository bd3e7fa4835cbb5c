import numpy as np
import pytest
from dates import day
from pyspark.sql import functions as F

from panelshock.operators import blocks, boosting, importance, models, preprocess
from panelshock.operators.boosting import HuberBoosting, LeafBoosting

rng = np.random.default_rng(11)
N = 240
FRAME = [
    (day("2025-07-01"), f"r{i % 2}", f"i{i % 5}", None if i % 17 == 0 else float(rng.normal(10, 3)), float(rng.normal(0, 2)), ("train", "train", "train", "validation", "test")[i // 5 % 5])
    for i in range(N)
]
SCHEMA = "date date, MCT_SGG_CD string, MCT_RY_CD string, lag1 double, avg_temp double, split string, Y1_heatwave double"
NUMERIC, CATEGORICAL = ["lag1", "avg_temp"], ["MCT_SGG_CD", "MCT_RY_CD"]


def response(lag, temp, region, noise):
    return 2.0 * (lag or 10.0) - 3.0 * temp + (5.0 if region == "r1" else 0.0) + noise


DATA = [(*r, response(r[3], r[4], r[1], float(rng.normal()))) for r in FRAME]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(DATA, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def prepared(rows):
    return preprocess.Preprocessor.fit(rows.where("split = 'train'"), NUMERIC, CATEGORICAL)


def matrix():
    """Imputed, scaled and one-hot columns by NumPy, and the response, for train and all rows."""
    train = [r for r in DATA if r[5] == "train"]
    x = np.zeros((N, 2 + 2 + 5))
    for j, c in enumerate((3, 4)):
        median = np.median([r[c] for r in train if r[c] is not None])
        filled = np.array([median if r[c] is None else r[c] for r in DATA])
        fit = np.array([median if r[c] is None else r[c] for r in train])
        x[:, j] = (filled - fit.mean()) / fit.std()
    for i, r in enumerate(DATA):
        x[i, 2 + int(r[1][1])] = 1
        x[i, 4 + int(r[2][1])] = 1
    y = np.array([r[6] for r in DATA])
    return x, y, np.array([r[5] == "train" for r in DATA])


def test_statistics_and_modes(spark, rows):
    train = rows.where("split = 'train'").withColumn("empty", F.lit(None).cast("double"))
    got = {r.feature: r for r in preprocess.numeric_statistics(train, [*NUMERIC, "empty"]).collect()}
    values = [r[3] for r in DATA if r[5] == "train"]
    median = np.median([v for v in values if v is not None])
    filled = np.array([median if v is None else v for v in values])
    assert got["lag1"].median == pytest.approx(median) and got["lag1"].sd == pytest.approx(filled.std())
    assert (got["empty"].median, got["empty"].mean, got["empty"].sd) == (0.0, 0.0, 0.0)
    ties = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert preprocess.category_modes(ties, ["c"]).first()["mode"] == "a"


def test_vectors_equal_numpy_and_unseen_is_zero(spark, rows, prepared):
    x, _, _ = matrix()
    got = prepared.vectors(rows, NUMERIC, CATEGORICAL).select("lag1", "avg_temp", "features").collect()
    expected = {(r[3], r[4]): x[i] for i, r in enumerate(DATA)}
    for r in got:
        np.testing.assert_allclose(r.features.toArray(), expected[r.lag1, r.avg_temp], atol=1e-12)
    other = spark.createDataFrame([(None, 0.0, "new", None)], "lag1 double, avg_temp double, MCT_SGG_CD string, MCT_RY_CD string")
    vector = prepared.vectors(other, NUMERIC, CATEGORICAL).first().features.toArray()
    # the region is unseen, the missing industry takes the most frequent one
    assert vector[2:4].tolist() == [0, 0] and vector[4:].sum() == 1
    assert prepared.vectors(other, ["avg_temp"], ["MCT_RY_CD"]).first().features.size == 1 + 5


def predictions(prepared, rows, fitter):
    vectors = prepared.vectors(rows, NUMERIC, CATEGORICAL)
    fitted = fitter(vectors.where("split = 'train'").select("features", "Y1_heatwave"), "Y1_heatwave")
    got = {(r.lag1, r.avg_temp): r.prediction for r in fitted.transform(vectors).collect()}
    return np.array([got[r[3], r[4]] for r in DATA])


def test_linear_predicts_as_least_squares(rows, prepared):
    x, y, train = matrix()
    design = np.hstack([x, np.ones((N, 1))])
    weights = np.linalg.lstsq(design[train], y[train], rcond=None)[0]
    np.testing.assert_allclose(predictions(prepared, rows, models.linear), design @ weights, atol=1e-4)


def test_ridge_equals_closed_form(rows, prepared):
    x, y, train = matrix()
    xt, yt = x[train], y[train]
    centred = xt - xt.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + 10.0 * np.eye(x.shape[1]), centred.T @ (yt - yt.mean()))
    expected = yt.mean() + (x - xt.mean(axis=0)) @ weights
    np.testing.assert_allclose(predictions(prepared, rows, models.ridge), expected, atol=1e-8)


def test_trees_beat_the_mean(rows, prepared):
    _, y, train = matrix()
    spread = np.abs(y[train] - y[train].mean()).mean()
    for fitter in (
        lambda t, c: models.forest(t, c, trees=20, depth=8),
        lambda t, c: models.squared_boosting(t, c, stages=20),
    ):
        error = np.abs(predictions(prepared, rows, fitter) - y)[train].mean()
        assert error < 0.6 * spread


def huber_stages(x, y, stages, rate):
    """Reference boosting with exhaustive depth-1 splits."""
    f = np.full(len(y), np.median(y))
    for _ in range(stages):
        residual = y - f
        limit = np.quantile(np.abs(residual), 0.9)
        target = np.clip(residual, -limit, limit)
        best = None
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= cut
                loss = target[left].var() * left.sum() + target[~left].var() * (~left).sum()
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, left)
        for part in (best[1], ~best[1]):
            median = np.median(residual[part])
            value = median + np.clip(residual[part] - median, -limit, limit).mean()
            f[part] += rate * value
    return f


def test_huber_boosting_equals_direct_computation(spark):
    from pyspark.ml.feature import VectorAssembler

    x = np.column_stack([np.arange(60) % 7, (np.arange(60) * 3) % 11]).astype(float)
    y = 4 * (x[:, 0] > 3) + x[:, 1] + np.where(np.arange(60) == 7, 500.0, 0.0) + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = HuberBoosting.fit(df, "y", stages=3, rate=0.1, depth=1)
    got = {(r.a, r.b, r.y): r.prediction for r in model.transform(df).collect()}
    expected = huber_stages(x, y, 3, 0.1)
    for (a, b), c, e in zip(x, y, expected):
        assert got[a, b, c] == pytest.approx(e, abs=1e-9)


def exact_tree(x, r, depth, clip):
    """Level-wise tree on all thresholds: a function from rows to leaf numbers."""
    target = np.clip(r, -clip, clip)
    leaf = np.zeros(len(r), dtype=int)
    for level in range(depth):
        for node in np.unique(leaf):
            own, best = leaf == node, None
            for j in range(x.shape[1]):
                for cut in np.unique(x[own, j])[:-1]:
                    left = own & (x[:, j] <= cut)
                    right = own & ~left
                    gain = target[left].sum() ** 2 / left.sum() + target[right].sum() ** 2 / right.sum() - target[own].sum() ** 2 / own.sum()
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, right)
            if best:
                leaf[best[1]] += 10 ** (depth - level) * (node + 1)
    return leaf


def test_huber_boosting_of_depth_two(spark, monkeypatch):
    """Against exhaustive trees and medians, with predictions written after every second tree."""
    x, y = rng.normal(size=(90, 3)).round(1), rng.normal(size=90) * 10
    y = y + 8 * (x[:, 0] > 0) * (x[:, 1] > 0.3)
    f, rate = np.full(90, np.median(y)), 0.5
    for _ in range(5):
        r = y - f
        clip = np.quantile(np.abs(r), 0.9)
        leaf = exact_tree(x, r, 2, clip)
        for one in np.unique(leaf):
            median = np.median(r[leaf == one])
            f[leaf == one] += rate * (median + np.clip(r[leaf == one] - median, -clip, clip).mean())
    df = vectors_of(spark, x, y).repartition(3)
    model = HuberBoosting.fit(df, "y", stages=5, rate=rate)
    assert predicted_by(model, df, y) == pytest.approx(f, abs=1e-8)
    monkeypatch.setattr(blocks, "LISTED", 3)  # every cell is refined to its last bit
    monkeypatch.setattr(boosting, "LEAF_ROWS", 12)  # larger leaves are counted
    monkeypatch.setattr(blocks, "DIRECT", 0)  # sums meet on executors
    monkeypatch.setattr(blocks, "PART_ROWS", 20)
    again = HuberBoosting.fit(df, "y", stages=3, rate=rate)
    assert [t.value for t in again.trees] == [t.value for t in model.trees[:3]]


def vectors_of(spark, x, y):
    from pyspark.ml.linalg import Vectors

    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "y"])


def predicted_by(model, df, y):
    found = {r.y: r.prediction for r in model.transform(df).collect()}
    return [found[v] for v in y]


def best_first_tree(x, r, leaves, penalty, least):
    """One split at a time by brute force: the rows of each leaf."""

    def best(own):
        found = None
        for j in range(x.shape[1]):
            for cut in np.unique(x[own, j])[:-1]:
                left = own[x[own, j] <= cut]
                right = own[x[own, j] > cut]
                if min(len(left), len(right)) < least:
                    continue
                gain = sum(r[p].sum() ** 2 / (len(p) + penalty) for p in (left, right)) - r[own].sum() ** 2 / (len(own) + penalty)
                if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-12)):
                    found = (gain, left, right)
        return found

    parts = [np.arange(len(r))]
    while len(parts) < leaves:
        options = [(b[0], i, b) for i, b in enumerate(map(best, parts)) if b]
        if not options:
            break
        _, i, (_, left, right) = max(options, key=lambda o: o[0])
        parts[i : i + 1] = [left, right]
    return parts


@pytest.mark.parametrize("leaves, least, listed", [(15, 5, 0), (15, 5, 40), (4, 20, 256), (1, 1, 0), (300, 1, 12)])
def test_leaf_boosting_equals_a_split_at_a_time(spark, monkeypatch, leaves, least, listed):
    x, y = rng.normal(size=(150, 4)).round(1), rng.normal(size=150)
    x[:, 3] = x[:, 3] > 0
    y = y + 3 * np.sin(3 * x[:, 0]) + 2 * x[:, 3] * x[:, 1]
    f, penalty, rate, stages = np.full(150, y.mean()), 2.0, 0.3, 4
    sizes = []
    for _ in range(stages):
        r = y - f
        parts = best_first_tree(x, r, leaves, penalty, least)
        sizes.append(len(parts))
        for own in parts:
            f[own] += rate * r[own].sum() / (len(own) + penalty)
    monkeypatch.setattr(boosting, "LEAF_ROWS", listed)
    model = LeafBoosting.fit(vectors_of(spark, x, y).repartition(4), "y", stages, rate, leaves, penalty, least)
    assert [len(t.leaves()) for t in model.trees] == sizes and max(sizes) <= leaves
    assert predicted_by(model, vectors_of(spark, x, y), y) == pytest.approx(f, abs=1e-9)


def test_boosting_does_not_depend_on_partitions(spark):
    x, y = rng.normal(size=(400, 3)), rng.normal(size=400)
    one, many = (LeafBoosting.fit(vectors_of(spark, x, y).repartition(p), "y", 12) for p in (1, 7))
    assert [(t.feature, t.threshold, t.value) for t in one.trees] == [(t.feature, t.threshold, t.value) for t in many.trees]


def test_binning(spark):
    many = np.column_stack([np.arange(3000) % 1000, np.arange(3000) % 2, np.zeros(3000)])
    found = blocks.Binning.fit(vectors_of(spark, many, np.zeros(3000)).drop("y"))
    assert 200 <= len(found.thresholds[0]) < 255 and found.thresholds[1].tolist() == [0.5] and not len(found.thresholds[2])
    assert np.bincount(found.bins(many)[:, 0]).max() <= 3000 / 100
    with pytest.raises(ValueError, match="no train rows"):
        LeafBoosting.fit(vectors_of(spark, many[:1], [0.0]).limit(0), "y", 1)


def test_grid_fits_every_combination(spark, rows):
    events = rows.withColumn("heatwave", F.lit(1)).withColumn("TS_AT", F.lit(1.0))
    spec = models.PanelSpec(hazards={"heatwave": (7,)})
    keyed = events.withColumn("MCT_RY_CD", F.concat("MCT_RY_CD", F.lit("")))
    sets = {"S": {"numeric": ["avg_temp"], "categorical": ["MCT_SGG_CD"]}, "T": {"numeric": NUMERIC, "categorical": CATEGORICAL}}
    scored, scorers = models.run_grid(keyed, {"Ridge": models.ridge, "Linear Regression": models.linear}, sets, spec)
    counts = {tuple(r)[:2]: r["count"] for r in scored.groupBy("feature_set", "model").count().collect()}
    assert counts == {(s, m): N for s in sets for m in ("Ridge", "Linear Regression")}
    again = scorers["heatwave", "T", "Ridge"](keyed).agg(F.sum("prediction")).first()[0]
    saved = scored.where("feature_set = 'T' and model = 'Ridge'").agg(F.sum("predicted_y1")).first()[0]
    assert again == pytest.approx(saved)
    with pytest.raises(ValueError, match="no heatwave event rows"):
        models.run_grid(keyed.where("split <> 'test'"), {"Ridge": models.ridge}, sets, spec)
    with pytest.raises(ValueError, match="forbidden"):
        models.run_grid(keyed, {"Ridge": models.ridge}, {"bad": {"numeric": ["TS_AT"], "categorical": []}}, spec)


def test_permutation_exchanges_whole_groups(spark):
    data = [(f"k{i}", "h", float(i), float(-i), float(i % 3), float(3 * i)) for i in range(50)]
    df = spark.createDataFrame(data, "k string, disaster_type string, a double, b double, c double, actual_y1 double")

    def scorer(d):
        return d.withColumn("prediction", 3 * F.col("a") + 2 * (F.col("a") + F.col("b")))

    groups = {"ab": ("a", "b"), "a": ("a",), "c": ("c",)}
    got = {r.feature_group: r for r in importance.permutation_importance(df, ["k"], groups, 20, scorer).collect()}
    assert got["c"].importance_mean == 0.0 and got["c"].baseline_mae == 0.0
    # a and b move together, so their sum stays 0; moving a alone breaks it
    assert 0 < got["ab"].importance_mean < got["a"].importance_mean
    assert got["a"].n_rows == 50 and got["a"].permutation_repeats == 20
    assert got["ab"].importance_sd == pytest.approx(got["ab"].importance_sd_pop * (20 / 19) ** 0.5)
    expected = 3 * np.mean([abs(i - j) for i in range(50) for j in range(50)])
    assert got["ab"].importance_mean == pytest.approx(expected, rel=0.1)
    once = importance.permutation_importance(df, ["k"], {"c": ("c",)}, 1, scorer).first()
    assert once.importance_sd == 0.0


def test_grid_importance_covers_every_feature(rows):
    events = rows.withColumn("heatwave", F.lit(1)).withColumn("TS_AT", F.lit(1.0))
    # one row per key, as the panel guarantees
    events = events.withColumn("MCT_RY_CD", F.concat_ws("/", "MCT_RY_CD", F.format_string("%.12f", "avg_temp")))
    spec = models.PanelSpec(hazards={"heatwave": (7,)})
    sets = {"T": {"numeric": NUMERIC, "categorical": ["MCT_SGG_CD"]}}
    _, scorers = models.run_grid(events, {"Ridge": models.ridge}, sets, spec)
    got = {r.feature: r for r in models.grid_importance(events, scorers, sets, repeats=3, spec=spec).collect()}
    assert set(got) == {"lag1", "avg_temp", "MCT_SGG_CD"}
    assert got["avg_temp"].importance_mean > got["MCT_SGG_CD"].importance_mean > 0
    assert (got["lag1"].feature_group, got["MCT_SGG_CD"].feature_group) == ("past_sales", "region")
    assert (got["lag1"].n_test_rows, got["lag1"].permutation_repeats) == (sum(r[5] == "test" for r in DATA), 3)


@pytest.mark.parametrize("features", [20, 4200])
def test_ridge_on_both_sides_of_the_normal_equations(spark, features):
    from pyspark.ml.linalg import Vectors

    draw = np.random.default_rng(4)
    x = draw.normal(size=(40, features))
    y = x[:, :5].sum(axis=1) + draw.normal(size=40)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "y"])
    got = np.array([r.prediction for r in models.ridge(df, "y").transform(df).collect()])
    centred = x - x.mean(axis=0)
    kernel = centred @ centred.T
    expected = y.mean() + kernel @ np.linalg.solve(kernel + models.RIDGE_ALPHA * np.eye(40), y - y.mean())
    # beyond 4,096 features an iteration replaces the exact solution
    assert got == pytest.approx(expected, abs=1e-8 if features < 4096 else 2e-3)
