import numpy as np
import pytest
from pyspark.sql import functions as F

from panelshock.functions.ordering import exact_quantiles, number_rows, ordered_integers, ranked_values

QUANTILES = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p00": 0.0, "p100": 1.0}


def check(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    found = {r.k: r for r in exact_quantiles(df, ["k"], "v", QUANTILES).collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        for name, q in QUANTILES.items():
            assert found[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12), (k, name)


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    check(
        spark,
        {
            "normal": rng.normal(0, 100, 1500),
            "one": [3.25],
            "two": [-1.0, 1.0],
            "ties": rng.integers(-3, 3, 800),
            "heavy tail": np.exp(rng.normal(0, 6, 900)),
            "narrow": 1e9 + rng.random(700),
            "huge": np.append(rng.normal(0, 1, 50) * 1e300, [1e308, -1e308]),
            "one cell": 1.7e9 + np.arange(500) / 64,
            "tiny": rng.normal(0, 1e-7, 300),
            "zeros": [0.0, -0.0, 0.0, 5.0],
        },
    )


def test_exact_quantiles_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), ("b", None)], "k string, v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0
    assert [tuple(r) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()] == [("a", 1.0)]


def test_hot_group_is_spread_over_cells(spark):
    df = spark.range(30000).select(F.lit("hot").alias("k"), (F.col("id") % 9973).cast("double").alias("v"))
    expected = np.quantile(np.arange(30000) % 9973, 0.5)
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).first()["m"] == expected
    plan = exact_quantiles(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_number_rows_is_a_permutation_in_token_order(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("t"))
    rows = number_rows(df, ["g"], "t", "i").collect()
    for g in range(3):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.t)
        assert [r.i for r in mine] == list(range(len(mine)))


def test_exact_quantiles_of_nan_huge_and_close_values(spark):
    rows = [("n", 1.0), ("n", 2.0), ("n", float("nan")), *[("h", s * 10.0**e) for e in (150, 200, 300) for s in (1, -1)]]
    rows += [("c", 1e9 + k / 1000) for k in range(500)]
    found = {r.k: r.m for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"m": 0.5}).collect()}
    assert found["n"] == 1.5 and found["h"] == 0.0 and found["c"] == pytest.approx(1e9 + 0.2495, abs=1e-6)


def test_ordered_integers_keep_the_order():
    values = np.array([-np.inf, -1e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e308, np.inf])
    bits = ordered_integers(values)
    assert (np.diff(bits) >= 0).all() and bits[4] == bits[5] and len(set(bits.tolist())) == len(values) - 1


def test_a_million_values_in_one_narrow_cell(spark):
    """Distinct values within 1e-10 of each other: the first three rounds see one cell each but
    the last two spread them, and no task orders more than the siblings of one cell."""
    count = 10**6
    df = spark.range(count).select((F.lit(1.0) + F.col("id") * F.lit(2.0**-52)).alias("v"))
    found = exact_quantiles(df, [], "v", {"a": 0.25, "m": 0.5, "z": 1.0}).first()
    expected = 1.0 + np.arange(count) * 2.0**-52
    assert [found["a"], found["m"], found["z"]] == [np.quantile(expected, q) for q in (0.25, 0.5, 1.0)]


def test_many_fractions_at_once(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.pmod(F.col("id") * 7919, F.lit(5000)).cast("double").alias("v"))
    rows = ranked_values(df, ["k"], "v", [i / 100 for i in range(101)]).collect()
    for k in (0, 1):
        mine = sorted(r["value"] for r in rows if r["k"] == k)
        values = sorted(float(i * 7919 % 5000) for i in range(k, 5000, 2))
        wanted = {values[int(f(i / 100 * 2499))] for i in range(101) for f in (np.floor, np.ceil)}
        assert mine == sorted(wanted)
