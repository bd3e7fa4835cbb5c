"""Every registered query of the subpackage that has SQL, against it, value by value."""

from pathlib import Path

import duckdb
import pytest

from panelshock.llm.oracle import ORACLE
from panelshock.llm.queries import REGISTRY

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name, size):
    folder = Path("/root/testdata") / size
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = REGISTRY[name](spark, str(folder))
    relation = con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == {c: TYPES[str(t)] for c, t in zip(relation.columns, relation.types)}
    mine = sorted(tuple(r) for r in df.select(*columns).collect())
    theirs = sorted(relation.project(", ".join(columns)).fetchall())
    assert mine == theirs
