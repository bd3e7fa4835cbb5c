"""Table, exchange and metadata sinks. An existing output is refused unless asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

BOM = "\ufeff"


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Parquet, the form the pipeline steps hand over. Output files follow the partitions of
    ``df``; no step gathers rows to write them."""
    df.write.mode(_mode(overwrite)).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False, order_by: Sequence[str] = (), bom: bool = False) -> None:
    """Header and UTF-8, a folder of part files, ordered across files when keys are given.
    ``bom`` puts a byte order mark before the header of every file, as spreadsheets want it."""
    out = df.orderBy(*order_by) if order_by else df
    if bom:
        out = out.toDF(BOM + df.columns[0], *df.columns[1:])
    out.write.mode(_mode(overwrite)).option("header", True).csv(path)


def write_metadata(row: DataFrame, path: str, overwrite: bool = False) -> None:
    """A one-row table of run facts as JSON."""
    row.coalesce(1).write.mode(_mode(overwrite)).json(path)
