"""Session settings and the reliable checkpoint used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for this library. On a cluster leave ``shuffle_partitions`` unset:
    AQE coalesces from the cluster's own setting."""
    builder = SparkSession.builder.appName("panelshock")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # cp949 text files need the JVM's own charsets
        "spark.sql.legacy.javaCharsets": "true",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, shared by all executors; where a session
    does not set it, one inside the warehouse, which is shared as well."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_written: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    For results that several later branches use: the inputs are scanned once, each branch
    reads only its columns, and the planner knows the size when it chooses a join."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete one staged table that nothing reads any more."""
    names = {file.rpartition("/")[0].rpartition("/")[2] for file in df.inputFiles()}
    for path in [p for p in _written if p.rpartition("/")[2] in names]:
        _written.remove(path)
        _delete(df.sparkSession, path)


def drop_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this process, once the results that read them are written."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
