"""Readers of the raw text files and of exchanged result files.

Columns are found by name. The header of the first file gives an all-text schema, and Spark
checks every other file's header against it. Extra columns are kept out by column pruning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelshock.operators.audits import require_columns
from panelshock.operators.flow import FLOW_COLUMNS
from panelshock.operators.weather import COLD_COLUMNS, DAY, HEAT_COLUMNS, STATION

# Encodings and required columns of the raw files.
KOREAN = "x-windows-949"
CARD_COLUMNS = ("TA_YMD", "MCT_SGG_CD", "MCT_RY_CD", "TS_AT", "USE_CNT", "TIME_GB")
STATION_NAME, RAIN = "지점명", "강수량(mm)"
HOURLY_COLUMNS = (STATION, STATION_NAME, DAY, RAIN)
FLOW_READ = ("STD_YM", "BLOCK_CD", *FLOW_COLUMNS)
HEAT_FILES, COLD_FILES = 3, 2
FILE = "source_file"


def header_of(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    return spark.read.options(header=True, sep=sep, encoding=encoding).csv(path).columns


def read_text(
    spark: SparkSession, paths: str | Sequence[str], columns: Iterable[str], sep: str, encoding: str = "UTF-8"
) -> DataFrame:
    """The named columns of delimited files as text, plus the file name in ``source_file``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    columns = list(columns)
    names = header_of(spark, paths[0], sep, encoding)
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{paths[0]}: missing columns {missing}; found {names}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, enforceSchema=False).schema(schema)
    quoted = [F.col(f"`{c}`") for c in columns]
    return reader.csv(paths).select(*quoted, F.col("_metadata.file_name").alias(FILE))


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob on any file system Spark can read."""
    try:
        files = spark.read.format("binaryFile").load(pattern).inputFiles()
    except Exception as error:  # an empty glob is an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    return sorted(files)


def pick_source(spark: SparkSession, folder: str, required: Iterable[str] = CARD_COLUMNS) -> str:
    """First ``*.txt``, then first ``*.tsv`` file, in name order, whose header holds every
    required column."""
    required = set(required)
    for path in list_files(spark, f"{folder}/*.txt") + list_files(spark, f"{folder}/*.tsv"):
        if required <= set(header_of(spark, path, "\t", KOREAN)):
            return path
    raise FileNotFoundError(f"no transaction file with {sorted(required)} in {folder}")


def read_card(spark: SparkSession, path: str) -> DataFrame:
    return read_text(spark, path, CARD_COLUMNS, "\t", KOREAN)


def _exactly(files: list[str], count: int, what: str) -> list[str]:
    if len(files) != count:
        raise FileNotFoundError(f"expected {count} {what} files, found {len(files)}")
    return files


def read_heat_warnings(spark: SparkSession, pattern: str, files: int = HEAT_FILES) -> DataFrame:
    """Heat warning files; another number of files than expected is an error."""
    return read_text(spark, _exactly(list_files(spark, pattern), files, "heat warning"), HEAT_COLUMNS, "\t", KOREAN)


def read_cold_warnings(spark: SparkSession, pattern: str, files: int = COLD_FILES) -> DataFrame:
    return read_text(spark, _exactly(list_files(spark, pattern), files, "cold warning"), COLD_COLUMNS, "\t", KOREAN)


def read_hourly(spark: SparkSession, pattern: str) -> DataFrame:
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no hourly files match {pattern}")
    return read_text(spark, files, HOURLY_COLUMNS, ",", KOREAN)


def read_flow(spark: SparkSession, pattern: str) -> DataFrame:
    """Nine of the columns of the weekday flow files; codes stay text."""
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no flow files match {pattern}")
    return read_text(spark, files, FLOW_READ, "|")


def read_result_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """An exchanged CSV (UTF-8, with or without BOM). ``columns`` maps names to the types
    they are cast to, dates included; a value that does not fit fails the job."""
    df = spark.read.options(header=True).csv(path)
    if columns is None:
        return df
    require_columns(df, columns, path)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def source_manifest(*tables: DataFrame) -> DataFrame:
    """Files behind the given tables, from the scan's file list: no data is read."""
    names = sorted({name for t in tables for name in t.inputFiles()})
    return tables[0].sparkSession.createDataFrame([(n,) for n in names], "file string")
