import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from panelshock.operators import extra_trees
from panelshock.operators.extra_trees import ExtraTrees, child_keys, drawn, root_keys

SEED, TREES, LEAST = 5, 7, 3


def table(n=240, seed=3):
    """A measure, a repeated whole number, two flags and a constant."""
    r = np.random.default_rng(seed)
    flag = r.integers(0, 2, n)
    x = np.column_stack([r.normal(size=n), r.integers(0, 4, n), flag, 1 - flag, np.full(n, 2.5)]).astype(float)
    y = 3 * x[:, 1] - 2 * x[:, 2] * x[:, 0] + r.normal(scale=0.2, size=n)
    x[:10], y[:10] = x[10:20], y[10:20]  # repeated rows
    return x, y


def vectors_of(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["id", "features", "y"])


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])


def one_tree(x, y, key, tried):
    """Prediction per row by plain recursion, one node and one feature at a time."""
    out = np.full(len(y), y.mean())

    def part(rows, key):
        out[rows] = y[rows].mean()
        if len(rows) < 2 * LEAST or y[rows].min() == y[rows].max():
            return
        keys = np.array([key], np.uint64)
        u, order = drawn(keys, x.shape[1], 0)[0], np.argsort(drawn(keys, x.shape[1], 1)[0])
        found = {}
        for seen, f in enumerate(order):
            if seen >= tried and found:
                break
            low, high = x[rows, f].min(), x[rows, f].max()
            left = x[rows, f] <= low + u[f] * (high - low)
            if low < high and min(left.sum(), (~left).sum()) >= LEAST:
                a, b = y[rows][left], y[rows][~left]
                found[f] = (a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b), left)
        if found:
            most = max(g for g, _ in found.values())
            best = min(f for f, (g, _) in found.items() if g >= most - 1e-9)
            left = found[best][1]
            for side, child in zip((left, ~left), child_keys(keys)):
                part(rows[side], child)

    part(np.arange(len(y)), key)
    return out


def test_trees_equal_plain_recursion(spark):
    x, y = table()
    df = vectors_of(spark, x, y)
    model = ExtraTrees.fit(df, "y", TREES, LEAST, seed=SEED)
    brute = np.mean([one_tree(x, y, k, 4) for k in root_keys(SEED, np.arange(TREES))], axis=0)
    assert np.allclose(predicted(model, df), brute, atol=1e-9)
    assert np.mean((predicted(model, df) - y) ** 2) < 0.1 * y.var()


@pytest.mark.parametrize("node_rows, copied", [(4, 500), (50, 1 << 28)])
def test_upper_nodes_and_waves_change_nothing(spark, monkeypatch, node_rows, copied):
    x, y = table()
    df = vectors_of(spark, x, y)
    whole = predicted(ExtraTrees.fit(df, "y", 3, LEAST, seed=SEED), df)
    monkeypatch.setattr(extra_trees, "COPIED_ROWS", copied)
    parted = predicted(ExtraTrees.fit(df.repartition(5), "y", 3, LEAST, seed=SEED, node_rows=node_rows), df.repartition(3))
    assert whole.tolist() == parted.tolist()


def test_odd_tables(spark):
    x, y = table(30)
    same = ExtraTrees.fit(vectors_of(spark, x, np.full(30, 4.0)), "y", 2)
    assert predicted(same, vectors_of(spark, x, y)).tolist() == [4.0] * 30
    alike = ExtraTrees.fit(vectors_of(spark, np.ones((30, 2)), y), "y", 2, node_rows=10)
    assert math.isclose(predicted(alike, vectors_of(spark, np.ones((1, 2)), [0.0]))[0], y.mean(), abs_tol=1e-9)
    with_null = vectors_of(spark, x, y).selectExpr("id", "features", "IF(id = 3, NULL, y) AS y")
    taught = ExtraTrees.fit(with_null, "y", 2, seed=SEED)
    without = ExtraTrees.fit(with_null.where("id != 3"), "y", 2, seed=SEED)
    assert predicted(taught, with_null).tolist() == predicted(without, with_null).tolist()
    assert predicted(taught, with_null.where("id < 0")).tolist() == []
    with pytest.raises(ValueError, match="no train rows"):
        ExtraTrees.fit(with_null.where("id = 3"), "y", 2)
