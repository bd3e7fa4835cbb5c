"""Shards by jump consistent hashing.

A stable key jumps from shard to shard as the number of shards grows; its shard is the last
landing below the wanted number. There is no ring table, and one more shard takes only the rows
that jump into it. Rows are numbered inside their shard in the order of their keys' digests:
distinct keys are ranked in even digest cells, rows of one key in cells of their file part, so
neither a shard nor one frequent key is ever ordered in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.llm.workspace import Workspace

MULTIPLIER = 2862933555777941757
KEY_DIGITS = 15
ROW_BITS = 33


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys in step; about ln(shards) steps."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(keys), dtype=np.int64)
    landing = np.zeros(len(keys), dtype=np.int64)
    going = np.arange(len(keys))
    while len(going):
        shard[going] = landing[going]
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        landing[going] = np.floor((shard[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[landing[going] < shards]
    return shard


def key_token(key: Column) -> Column:
    """Lowercase hex digest of the key as text; a NULL key counts as the empty text."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def key_number(token: Column) -> Column:
    """The first 60 bits of a digest, the number that jumps."""
    return F.conv(F.substring(token, 1, KEY_DIGITS), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a key. The key and the number of shards decide alone."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in numbers:
            yield pd.Series(jump(part.to_numpy(), shards))

    return place(key_number(key_token(key)))


def assign(docs: DataFrame, shards: int, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row of ``docs``.

    ``size`` is the text's bytes of UTF-8 plus 8, a NULL text has none and the checksum 0.
    ``slot`` numbers a shard's rows from 0 without gaps, by the digest of the key, rows of one
    key in the order they are read. ``grown_shard`` is the shard once there is one more. Rows
    with equal or NULL keys share a shard and get slots of their own; extra columns are
    ignored; an empty table gives an empty one."""
    content = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(f"`{key}`").alias("__key"),
        key_token(F.col(f"`{key}`")).alias("__token"),
        (F.octet_length(content).cast("long") + 8).alias("size"),
        F.crc32(content).alias("text_crc32"),
        shard_of(F.col(f"`{key}`"), shards).alias("shard"),
        shard_of(F.col(f"`{key}`"), shards + 1).alias("grown_shard"),
    )
    # written once: row numbers must not change when a task is repeated
    rows = work.table(rows, "rows")
    per_key = rows.groupBy("shard", "__token").agg(F.count(F.lit(1)).alias("__n"))
    firsts = work.table(_starts(per_key, ["shard"], "__token"), "firsts")
    single = rows.join(firsts.where("__n = 1").select("__token", "__start"), "__token").withColumn("slot", F.col("__start"))
    often = rows.join(firsts.where("__n > 1").select("__token", "__start"), "__token")
    part = F.shiftright("__row", ROW_BITS)
    parts = often.groupBy("__token", part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(W.partitionBy("__token").orderBy("__part")) - F.col("__size")
    offsets = parts.select("__token", "__part", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__token", "__part").orderBy("__row")) - 1
    copies = often.withColumn("__part", part).join(offsets, ["__token", "__part"])
    copies = copies.withColumn("slot", F.col("__start") + F.col("__before") + inside).drop("__part", "__before")
    return single.unionByName(copies).select(
        F.col("__key").alias(key), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def _starts(per_key: DataFrame, groups: list[str], token: str) -> DataFrame:
    """Keys with ``__start``, the rows of their group before them in the order of tokens."""
    cell = F.substring(token, 1, 3)
    marked = per_key.withColumn("__cell", cell)
    sizes = marked.groupBy(*groups, "__cell").agg(F.sum("__n").alias("__size"))
    earlier = F.sum("__size").over(W.partitionBy(*groups).orderBy("__cell")) - F.col("__size")
    starts = sizes.select(*groups, "__cell", earlier.alias("__before"))
    inside = F.sum("__n").over(W.partitionBy(*groups, "__cell").orderBy(token)) - F.col("__n")
    return (
        marked.join(starts, [*groups, "__cell"])
        .withColumn("__start", F.col("__before") + inside)
        .drop("__cell", "__before")
    )


def write_shards(docs: DataFrame, shards: int, path: str, key: str = "doc_id", text: str = "text", files: int = 1) -> None:
    """Write ``docs`` as Parquet under ``path``, one folder ``__shard=N`` per non-empty shard
    with up to ``files`` files each, by one shuffle. All columns pass unchanged; rows spread over
    their shard's files by key and text."""
    spread = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(files))
    placed = docs.withColumn("__shard", shard_of(F.col(f"`{key}`"), shards)).withColumn("__file", spread)
    placed.repartition(shards * files, "__shard", "__file").drop("__file").write.partitionBy("__shard").parquet(path)
