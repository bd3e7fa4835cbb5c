"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Method: prefixes of several matches. All shingles stand in one order, rare ones first. Of a
set of n shingles, of which ``need`` must be shared by any partner, the first
``n - need + m`` shingles are its m-prefix; partners share at least the smaller of their two
m within their prefixes. Each document takes the m of the least estimated cost: index rows
plus expected candidates, where at most (sum of frequencies) / m documents can share m of its
prefix shingles.

Scale: frequencies come from a count sketch of fixed size over all documents. Equal sets are
one class. Shared prefix shingles are first compared with one hub each, which joins the bulk
of a group of near copies with one pair per row; then only pairs across different components
are compared. Both steps together test every pair that could join two components, so no link
between components is lost, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshock.llm.components import connected
from panelshock.llm.keyfilter import key_filter
from panelshock.llm.textbytes import mix, shingle_sets
from panelshock.llm.workspace import Workspace, in_small_batches

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH_BITS, BLOCK_BITS = 20, 12
MOST_MATCHES = 4
CHECK_COST = 8.0

PROFILE = "doc_id long, n long, s1 long, s2 long, m int, prefix array<long>"


def _sketch(size: int):
    """Count each document's distinct shingles in 2^SKETCH_BITS cells; one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), size):
                if sets:
                    found = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    cells += np.bincount(found, minlength=1 << SKETCH_BITS)
        blocks = cells.reshape(-1, 1 << BLOCK_BITS)
        yield pa.record_batch(
            [pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "cells"]
        )

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the blocks of a partition as they stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(cells.as_buffer(), dtype=np.int64)
            total[block] = total[block] + part if block in total else part.copy()
    yield pa.record_batch(
        [pa.array(list(total), pa.int32()), pa.array([b.tobytes() for b in total.values()], pa.binary())], ["block", "cells"]
    )


def shingle_frequencies(docs: DataFrame, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Cell counts over all documents: 2^SKETCH_BITS numbers whatever the input."""
    schema = "block int, cells binary"
    parts = docs.select("text").mapInArrow(_sketch(size), schema).repartition("block")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    width = 1 << BLOCK_BITS
    for row in parts.mapInArrow(_fold, schema).collect():
        out[row.block * width : (row.block + 1) * width] += np.frombuffer(row.cells, dtype=np.int64)
    return out


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _profiles(size: int, percent: int, frequencies):
    """Set size, 128-bit digest of the set, chosen m and m-prefix of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequencies.value
        base = counts.mean()
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), size):
                n, s1, s2, m, flat, lengths = [], [], [], [], [], []
                for shingles in sets:
                    seen = counts[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    need = -(-percent * len(shingles) // 100)
                    most = min(MOST_MATCHES, need)
                    longest = min(len(shingles), len(shingles) - need + most)
                    if longest:
                        # the order by (count, hash): sort only what the longest prefix can hold
                        key = seen * (1 << 20) + (shingles & np.uint64(0xFFFFF)).astype(np.int64)
                        take = np.argpartition(key, longest - 1)[:longest] if longest < len(key) else np.arange(len(key))
                        edge = key[take].max()
                        take = np.flatnonzero(key <= edge)
                        order = take[np.lexsort((shingles[take], key[take]))][:longest]
                        cost = np.cumsum(1.0 + np.maximum(seen[order] - base, 0.0))
                        upto = np.minimum(len(shingles), len(shingles) - need + np.arange(1, most + 1))
                        scanned = cost[upto - 1]
                        choice = int(np.argmin(scanned + CHECK_COST * (scanned - upto) / np.arange(1, most + 1)))
                        prefix, chosen = shingles[order[: upto[choice]]], choice + 1
                    else:
                        prefix, chosen = shingles[:0], 0
                    n.append(len(shingles))
                    s1.append(np.add.reduce(mix(shingles + np.uint64(1)), dtype=np.uint64) if len(shingles) else np.uint64(0))
                    s2.append(np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) if len(shingles) else np.uint64(0))
                    m.append(chosen)
                    flat.append(prefix)
                    lengths.append(len(prefix))
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(first, len(sets)),
                        pa.array(n, pa.int64()),
                        pa.array(_signed(s1)),
                        pa.array(_signed(s2)),
                        pa.array(m, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(np.concatenate(flat)))),
                    ],
                    ["doc_id", "n", "s1", "s2", "m", "prefix"],
                )

    return run


def similar_sets(percent: int):
    """Keep the pairs whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left_set"), batch.column("right_set")):
                left, right = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                place = np.searchsorted(left, right)
                place[place == len(left)] = 0
                shared = int(np.count_nonzero(left[place] == right)) if len(left) and len(right) else 0
                keep.append(100 * shared >= percent * (len(left) + len(right) - shared) and shared > 0)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _wanted_sets(size: int, wanted):
    """The sets of the documents that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(wanted.value.holds(np.asarray(batch.column("doc_id")))))
            for first, sets in shingle_sets(some.column("text"), size):
                yield pa.record_batch(
                    [some.column("doc_id").slice(first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "members"],
                )

    return run


def _held(wanted):
    """The rows whose id the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.holds(np.asarray(batch.column(0)))))

    return run


def _index(wanted):
    """(token, doc_id, spot) of the prefix shingles that the filter holds. A spot has the
    set's size above 32 bits and the place of the shingle in its prefix below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("prefix").value_lengths()).astype(np.int64)
            tokens = np.asarray(batch.column("prefix").flatten())
            ends = np.cumsum(lengths)
            place = np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)
            keep = wanted.value.holds(tokens)
            spot = (np.repeat(np.asarray(batch.column("n")), lengths) << 32) | place
            owner = np.repeat(np.asarray(batch.column("doc_id")), lengths)
            yield pa.record_batch([pa.array(tokens[keep]), pa.array(owner[keep]), pa.array(spot[keep])], ["token", "doc_id", "spot"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _links(docs: DataFrame, pairs: DataFrame, prefixes: DataFrame, size: int, percent: int, work: Workspace, label: str) -> DataFrame:
    """The pairs (a, b) of representatives that are similar. Pairs must first share as many
    prefix shingles as the smaller m of both; the sets of those that do are rebuilt from their
    texts alone."""
    context = docs.sparkSession.sparkContext
    ends = work.table(_ends(pairs), f"{label}-met")
    wanted = context.broadcast(key_filter(ends, ends.count()))
    held = prefixes.select("doc_id", "m", "prefix").mapInArrow(_held(wanted), "doc_id long, m int, prefix array<long>")
    held = work.table(held, f"{label}-prefixes")
    for side in ("a", "b"):
        pairs = pairs.join(held.select(*[F.col(c).alias(t) for c, t in (("doc_id", side), ("m", f"{side}_m"), ("prefix", f"{side}_prefix"))]), side)
    shared = F.size(F.array_intersect("a_prefix", "b_prefix"))
    pairs = work.table(pairs.where(shared >= F.least("a_m", "b_m")).select("a", "b"), f"{label}-checked")
    ends = work.table(_ends(pairs), f"{label}-ends")
    wanted = context.broadcast(key_filter(ends, ends.count()))
    sets = docs.where("doc_id IS NOT NULL").mapInArrow(_wanted_sets(size, wanted), "doc_id long, members binary")
    sets = work.table(sets.join(ends, "doc_id", "left_semi"), f"{label}-sets")
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left_set")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right_set")), "b")
        .select("a", "b", "left_set", "right_set")
    )
    out = work.table(both.mapInArrow(similar_sets(percent), "a long, b long").distinct(), f"{label}-links")
    work.drop(f"{label}-sets", f"{label}-ends", f"{label}-met", f"{label}-prefixes", f"{label}-checked")
    return out


def _n(spot: str) -> Column:
    return F.shiftright(spot, 32)


def _place(spot: str) -> Column:
    return F.col(spot).bitwiseAND(0xFFFFFFFF)


def _reach(x: str, y: str, percent: int) -> Column:
    """Whether a match at these spots can be the first of a similar pair: all that is shared
    stands from there on. The first common shingle of every similar pair passes."""
    most = F.least(_n(x) - _place(x), _n(y) - _place(y))
    return (
        (100 * F.least(_n(x), _n(y)) >= percent * F.greatest(_n(x), _n(y)))
        & ((100 + percent) * most >= percent * (_n(x) + _n(y)))
    )


@in_small_batches
def similarity_classes(
    docs: DataFrame, work: Workspace, size: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text, ...)``.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    ``size``-word shingles; component_id is the smallest doc_id that links reach. NULL, empty
    and white texts have no shingles and link with nothing; texts of fewer words are one
    shingle. Rows with equal doc_id are one node: what links one links all. A NULL doc_id
    links nothing and has a NULL component. Shingles are told apart by 64-bit hashes, equal
    sets by 128 bits. Extra columns are ignored; an empty table gives an empty table."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    frequencies = spark.sparkContext.broadcast(shingle_frequencies(texts, size))
    profiles = work.table(texts.mapInArrow(_profiles(size, percent, frequencies), PROFILE), "profiles")

    # equal sets are one class, named by its smallest document
    shape = ["n", "s1", "s2"]
    named = profiles.where("n > 0 AND doc_id IS NOT NULL")
    classes = work.table(named.groupBy(*shape).agg(F.min("doc_id").alias("rep")), "classes")
    # a doc_id in several classes ties them together
    shared_ids = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    ties = (
        named.join(shared_ids, "doc_id", "left_semi").select("doc_id", *shape).distinct().join(classes, shape)
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    ties = work.table(ties.where("a != b"), "ties")

    first = named.join(classes.select(*shape, F.col("rep").alias("doc_id")), [*shape, "doc_id"], "left_semi")
    prefixes = work.table(first.select("doc_id", "n", "m", "prefix"), "prefixes")
    # only shingles of several prefixes are worth an index row
    repeated = work.table(
        prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"),
        "repeated",
    )
    wanted = spark.sparkContext.broadcast(key_filter(repeated, repeated.count()))
    index = prefixes.select("doc_id", "n", "prefix").mapInArrow(_index(wanted), "token long, doc_id long, spot long")
    index = work.table(index.join(repeated, "token", "left_semi"), "index")
    # the hub of a token is the document with the fewest rarer shingles
    rank = F.shiftleft(_place("spot"), 40).bitwiseOR(F.xxhash64("doc_id").bitwiseAND((1 << 40) - 1))
    hubs = index.groupBy("token").agg(F.min_by("doc_id", rank).alias("hub"), F.min_by("spot", rank).alias("hub_spot"))
    postings = work.table(index.join(hubs, "token"), "postings")
    work.drop("repeated", "index")

    pairs = work.table(
        postings.where("doc_id != hub")
        .where(_reach("spot", "hub_spot", percent))
        .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
        .distinct(),
        "hub-pairs",
    )
    near_hubs = _links(texts, pairs, prefixes, size, percent, work, "hub")
    found = near_hubs.unionByName(ties)
    groups = connected(found, work, "hub-components")
    placed = postings.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "token", "doc_id", "spot", "hub", F.coalesce("component", "doc_id").alias("component")
    )
    placed = work.table(placed, "placed")
    open_tokens = (
        placed.groupBy("token")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.max(F.when(F.col("doc_id") == F.col("hub"), F.col("component"))).alias("core"),
        )
        .where("low != high")
        .select("token", "core")
    )
    rest = work.table(placed.drop("hub").join(open_tokens, "token"), "open")
    columns = ("doc_id", "spot", "component")
    x = rest.where("component != core").select("token", "core", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = rest.select("token", *[F.col(c).alias(f"y_{c}") for c in columns])
    # each pair of components meets once per token: the side outside the hub's component leads
    across = (
        x.join(y, "token")
        .where("x_component != y_component AND (y_component = core OR x_doc_id < y_doc_id)")
        .where(_reach("x_spot", "y_spot", percent))
        .select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    across = work.table(across, "cross-pairs")
    more = _links(texts, across, prefixes, size, percent, work, "cross")
    final = connected(found.unionByName(more), work, "components")

    naming = work.table(
        classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*shape, F.coalesce("component", "rep").alias("component")),
        "naming",
    )
    work.drop("prefixes", "postings", "placed", "open", "hub-pairs", "cross-pairs")
    return (
        profiles.select("doc_id", *shape)
        .join(naming, shape, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
    )
