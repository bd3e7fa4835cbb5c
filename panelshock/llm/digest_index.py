"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text. New data is
reduced to its distinct digests first, so no digest is frequent when it meets the index; the
sort-merge anti-join reads the index without a shuffle, and the digests it lacks are
appended in the same buckets. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshock.llm.workspace import Workspace

WHITE = " \t\n\x0b\x0c\r"
BUCKETS = 64


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space of ASCII; NULL counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def tagged(docs: DataFrame) -> DataFrame:
    """Row number, id, digest and original length of each row; names are private, so columns
    of the input cannot clash."""
    return docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col("doc_id").alias("__id"),
        text_digest(F.col("text")).alias("__digest"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("__chars"),
    )


class DigestIndex:
    """A table (digest, keep_id, keep_chars, batch) in ``buckets`` files per append, under a
    catalog name and a path in a shared folder. Opening an existing path continues it."""

    def __init__(self, spark, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, keep_chars BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def before(self, batch: str) -> DataFrame:
        """What other batches brought."""
        return self.table().where(F.col("batch") != batch)

    def lacking(self, digests: DataFrame, batch: str = "") -> DataFrame:
        """Rows of ``digests`` (one per digest) that no other batch brought: the anti-join."""
        return digests.hint("merge").join(self.before(batch).select("digest"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add one row per new digest under the batch's name, unless an earlier attempt of the
        batch has. Repartitioned by digest, each bucket gets one file."""
        if not self.table().where(F.col("batch") == batch).isEmpty():
            return
        (
            rows.select("digest", "keep_id", "keep_chars", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest of a tagged table: the row that stays and the group's size. Most
    code points first, then smallest id, NULL ids last, then the first row; partial
    aggregation keeps a huge group of copies small before the shuffle."""
    order = F.struct(-F.col("__chars"), F.col("__id").isNull(), F.col("__id"), F.col("__row"))
    best = F.min(order.alias("best"))
    return rows.groupBy(F.col("__digest").alias("digest")).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest",
        F.col("best.__id").cast("long").alias("keep_id"),
        (-F.col("best.col1")).alias("keep_chars"),
        F.col("best.__row").alias("keep_row"),
        "group_size",
    )


def batch_name(groups: DataFrame) -> str:
    """A name that equal batches share: the number and a checksum of their digests and rows."""
    mixed = F.xxhash64("digest", "keep_id", "keep_chars", "group_size").cast("decimal(38,0)")
    count, total = groups.agg(F.count(F.lit(1)), F.sum(mixed)).first()
    return f"{count}-{total or 0}"


def deduplicate(rows: DataFrame, index: DigestIndex, work: Workspace, batch: str | None = None) -> DataFrame:
    """Decide each row of a written tagged table against the index and append what is new.

    Returns (__row, __id, digest, keep_id, group_size, kept). Of equal texts of this batch the
    best row stays if no earlier batch brought the digest; else none stays and keep_id names the
    row kept earlier. group_size counts this batch. The index notes which batch brought a digest,
    by the name ``batch`` or, unnamed, by a checksum of its rows: a batch that is run again, its
    first result lost, decides as before and appends nothing twice. An append is one commit; one
    that did not end has left nothing. A NULL text equals the empty one; of rows equal in text,
    length and id exactly one stays; a kept row with NULL id has a NULL keep_id. Extra columns
    do not matter; an empty batch appends nothing."""
    groups = work.table(representatives(rows), "groups")
    batch = batch or batch_name(groups)
    fresh = work.table(index.lacking(groups, batch), "fresh")
    known = index.before(batch)
    decided = work.table(
        fresh.select("digest", "keep_id", "keep_row", "group_size").unionByName(
            groups.join(fresh, "digest", "left_anti")
            .join(known.select("digest", F.col("keep_id").alias("old")), "digest")
            .select("digest", F.col("old").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "group_size")
        ),
        "decided",
    )
    index.append(fresh, batch)
    return rows.withColumnRenamed("__digest", "digest").join(decided, "digest").select(
        "__row", "__id", "digest", "keep_id", "group_size", F.coalesce(F.col("__row") == F.col("keep_row"), F.lit(False)).alias("kept")
    )


def new_index(work: Workspace) -> DigestIndex:
    """An empty index in the job's own folder."""
    return DigestIndex(work.spark, "digest_index_" + work.root.rsplit("-", 1)[1], work.path("index"))


def drop_copies(docs: DataFrame, work: Workspace, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    parts = row.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col("__doc.doc_id").alias("__id"),
        text_digest(F.col("__doc.text")).alias("__digest"),
        F.length(F.coalesce(F.col("__doc.text"), F.lit(""))).cast("long").alias("__chars"),
        "__doc",
    )
    stored = work.table(parts, "rows")
    decided = deduplicate(stored.drop("__doc"), index or new_index(work), work)
    out = stored.select("__row", "__doc").join(decided.where("kept").select("__row"), "__row", "left_semi")
    return out.select("__doc.*")
