"""Tables that one job keeps in the folder all executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshock.session import shared_folder

BATCH_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: a batch that has reached so many bytes is closed, so that long texts do not add up
BATCH_BYTES, BYTES = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


class Workspace:
    """Named Parquet tables of one job. A table is written once and read back, so that a lost
    executor costs its running tasks only and the planner knows the table's size."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._delete(self.path(name))

    def drop_all(self) -> None:
        """Delete the job's folder, once its result has been written elsewhere."""
        self._delete(self.root)

    def forget_shuffles(self) -> None:
        """Let Spark remove the shuffle files of jobs whose results have been written: it does so
        once the driver collects their plans as garbage, for which an idle driver sees no need."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def in_small_batches(operator: Callable) -> Callable:
    """An operator (docs, work, ...) whose own jobs hand Python at most BATCH_ROWS rows at a time,
    and no further row after BATCH_BYTES: texts, sets and pieces are wide, and an executor holds a
    batch of each of its tasks twice, once beside the heap and once in Python. Results do not depend
    on batches; the session gets its settings back."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options):
        conf = docs.sparkSession.conf
        before = {name: conf.get(name, None) for name in (BATCH, BYTES)}
        given = int(conf.get(BATCH))
        conf.set(BATCH, str(min(given, BATCH_ROWS) if given > 0 else BATCH_ROWS))
        conf.set(BYTES, str(BATCH_BYTES))
        try:
            return operator(docs, *args, **options)
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``: the folds of the learned operators. A NULL
    id has no remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
