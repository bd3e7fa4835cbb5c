"""Every registered query against its SQL, value by value, on the smallest tables."""

import functools
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelshock.operators import models
from panelshock.plans import fixtures, queries
from panelshock.plans.oracle import ORACLE
from panelshock.plans.queries import REGISTRY

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """Build each staged input once for all checks."""
    patch = pytest.MonkeyPatch()
    for name in ("panel", "hourly", "event_rows", "saved_run"):
        patch.setattr(fixtures, name, functools.cache(getattr(fixtures, name)))
    yield
    patch.undo()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = REGISTRY[name](spark, sf_dir)
    relation = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == {c: TYPES[str(t)] for c, t in zip(relation.columns, relation.types)}
    mine = df.select(*[f"`{c}`" for c in columns]).collect()
    theirs = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert ordered(mine) == ordered(theirs)


class TrainMean:
    """What a fit that learns nothing predicts."""

    def __init__(self, train, label):
        self.mean = train.agg({label: "avg"}).first()[0]

    def transform(self, df):
        return df.withColumn("prediction", F.lit(self.mean))


@pytest.mark.parametrize("name, model", [
    ("model_grid_linear", "Linear Regression"), ("model_grid_linear", "Ridge"), ("forest_metrics", "forest"),
    ("extra_trees_metrics", "extra_trees"),
    ("squared_boosting_metrics", "squared_boosting"), ("huber_boosting_metrics", "huber_boosting"),
])
def test_a_constant_is_found_out(spark, duck, sf_dir, monkeypatch, name, model):
    if name == "model_grid_linear":
        monkeypatch.setitem(queries.LINEAR, model, TrainMean)
    else:
        monkeypatch.setattr(models, model, TrainMean)
    df = REGISTRY[name](spark, sf_dir)
    relation = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert ordered(df.select(*columns).collect()) != ordered(relation.project(", ".join(columns)).fetchall())


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["disaster_type", "model", "feature_set"]
    assert df.count() > 0
