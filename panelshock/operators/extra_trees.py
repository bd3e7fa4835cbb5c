"""Extremely randomised regression trees: every node draws one threshold per feature.

A node is named by a 64-bit key made from the seed, its tree and the way to it. Its draws are
digests of the key, so a tree does not depend on partitions, on lost tasks, or on where a node
is grown. Targets are integers of a fixed scale, so that sums are exact in any order.

Nodes above NODE_ROWS rows are grown level by level, all trees of a wave at once, by two passes
over blocks of rows: ranges of every feature, then rows and sums below the thresholds drawn in them.
The rows of smaller nodes meet in one shuffle by (tree, node), and a task grows all that is below
them; a wave is as many trees as copy at most COPIED_ROWS rows there, or one. The driver holds the upper nodes only; the rest of the model is a table, and rows are
scored by a join with it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.operators.blocks import Tree
from panelshock.session import staged, unstage

NODE_ROWS, BLOCK_ROWS, SCORED_ROWS, COPIED_ROWS = 65_536, 16_384, 4_096, 1 << 28
GOLDEN, FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PART = "tree int, node int, x binary, unit binary"
MODEL = "tree int, node int, feature binary, cut binary, below binary, value binary"


def mixed(z: np.ndarray) -> np.ndarray:
    """Digest of 64-bit integers (the finaliser of SplitMix64)."""
    z = z.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * FIRST
    z = (z ^ (z >> np.uint64(27))) * SECOND
    return z ^ (z >> np.uint64(31))


def drawn(keys: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A number from 0 to 1 per node and feature."""
    places = np.arange(1, width + 1, dtype=np.uint64) * GOLDEN + np.uint64(salt)
    return (mixed(keys[:, None] + places[None, :]) >> np.uint64(11)) * 2.0**-53


def root_keys(seed: int, trees: np.ndarray) -> np.ndarray:
    return mixed(mixed(np.array([seed], np.uint64)) + trees.astype(np.uint64) * GOLDEN)


def child_keys(keys: np.ndarray) -> np.ndarray:
    """Left and right child of each node, side by side."""
    return np.stack([mixed(keys ^ FIRST), mixed(keys ^ SECOND)], axis=1).ravel()


def cuts_of(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A threshold per node and feature, below the feature's greatest value in the node."""
    cut = low + drawn(keys, low.shape[1], 0) * (high - low)
    return np.where(cut < high, cut, low)


def chosen(keys, n, total, low, high, left_n, left_sum, tried: int, least: int) -> np.ndarray:
    """The feature whose threshold parts each node best, or -1. ``tried`` features of a drawn
    order compete; where none of them leaves ``least`` rows on both sides, the next one that
    does is taken. Of equals the first feature."""
    fits = (low < high) & (left_n >= least) & (n[:, None] - left_n >= least)
    rank = np.argsort(np.argsort(drawn(keys, low.shape[1], 1), axis=1, kind="stable"), axis=1)
    inside = fits & (rank < tried)
    next_one = np.where(fits, rank, low.shape[1]).min(axis=1)[:, None]
    inside |= fits & (rank == next_one) & ~inside.any(axis=1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = left_sum.astype(np.float64), (total[:, None] - left_sum).astype(np.float64)
        gain = np.where(inside, a * a / left_n + b * b / (n[:, None] - left_n), -np.inf)
    return np.where(inside.any(axis=1), np.argmax(gain, axis=1), -1)


def grown(x: np.ndarray, unit: np.ndarray, key: np.uint64, tried: int, least: int) -> tuple[np.ndarray, ...]:
    """Tests and values of all nodes below one, level by level: feature (-1 in leaves), cut, left
    child (the right one follows it) and mean unit."""
    rows, starts, keys, out, number = np.arange(len(unit)), np.zeros(1, np.int64), np.array([key], np.uint64), [], 1
    while len(starts):
        n, own, xs = np.diff(np.append(starts, len(rows))), unit[rows], x[rows]
        node = np.repeat(np.arange(len(starts)), n)
        total = np.add.reduceat(own, starts)
        low, high = np.minimum.reduceat(xs, starts, axis=0), np.maximum.reduceat(xs, starts, axis=0)
        cut = cuts_of(keys, low, high)
        left = xs <= cut[node]
        left_n = np.add.reduceat(left, starts, axis=0, dtype=np.int64)
        left_sum = np.add.reduceat(np.where(left, own[:, None], 0), starts, axis=0)
        feature = chosen(keys, n, total, low, high, left_n, left_sum, tried, least)
        feature[(n < 2 * least) | (np.minimum.reduceat(own, starts) == np.maximum.reduceat(own, starts))] = -1
        split = feature >= 0
        place = 2 * (np.cumsum(split) - 1)
        at = np.where(split, feature, 0)
        out.append((feature, cut[np.arange(len(n)), at], np.where(split, number + place, 0), np.rint(total / n).astype(np.int64)))
        number += 2 * int(split.sum())
        child = place[node] + ~left[np.arange(len(rows)), at[node]]
        going = split[node]
        order = np.argsort(child[going], kind="stable")
        rows, child = rows[going][order], child[going][order]
        starts, keys = np.flatnonzero(np.append(True, child[1:] != child[:-1])) if len(child) else starts[:0], child_keys(keys[split])
    return tuple(np.concatenate(c) for c in zip(*out))


def _blocks(scale: float):
    """Blocks of rows: features and integer targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                unit = np.rint(np.asarray(part.column(1), np.float64) * scale).astype(np.int64)
                x = np.asarray(part.column(0).flatten(), np.float64)
                yield pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in (x, unit)], ["x", "unit"])

    return run


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, unit in zip(batch.column("x").to_pylist(), batch.column("unit").to_pylist()):
            yield np.frombuffer(x, np.float64).reshape(-1, width), np.frombuffer(unit, np.int64)


def _open_rows(batches, width: int, tops: dict[int, Tree], wanted: dict[int, list[int]]):
    """For each block, tree and wanted node: the node's rows."""
    for x, unit in _arrays(batches, width):
        for tree, nodes in wanted.items():
            place = tops[tree].place(x, binned=False)
            for node in nodes:
                own = np.flatnonzero(place == node)
                if len(own):
                    yield tree, node, x[own], unit[own]


def _by_column(nodes, low, high, kind) -> pa.RecordBatch:
    """Rows (tree, node, place, a, b) of arrays per node."""
    width = len(low[0]) if low else 0
    tree, node = (np.repeat(np.array([m[i] for m in nodes], np.int32), width) for i in range(2))
    place = np.tile(np.arange(width, dtype=np.int32), len(nodes))
    ends = [np.concatenate(c).astype(kind) if c else np.zeros(0, kind) for c in (low, high)]
    return pa.record_batch([pa.array(c) for c in (tree, node, place, *ends)], ["tree", "node", "place", "a", "b"])


def _ranges(width: int, tops, wanted):
    """Least and greatest value of each feature, and of the target behind them, per node."""

    def run(batches):
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for tree, node, x, unit in _open_rows(batches, width, tops, wanted):
            both = np.column_stack([x, unit.astype(np.float64)])
            own = held.setdefault((tree, node), [both[0], both[0]])
            own[0], own[1] = np.minimum(own[0], both.min(axis=0)), np.maximum(own[1], both.max(axis=0))
        yield _by_column(list(held), [h[0] for h in held.values()], [h[1] for h in held.values()], np.float64)

    return run


def _below(width: int, tops, wanted, cuts: dict[tuple[int, int], np.ndarray]):
    """Rows and summed targets up to each feature's threshold, and of all rows behind them."""

    def run(batches):
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for tree, node, x, unit in _open_rows(batches, width, tops, wanted):
            left = np.column_stack([x <= cuts[tree, node], np.ones(len(unit), bool)])
            own = held.setdefault((tree, node), [np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)])
            own[0] = own[0] + left.sum(axis=0)
            own[1] = own[1] + np.where(left, unit[:, None], 0).sum(axis=0)
        yield _by_column(list(held), [h[0] for h in held.values()], [h[1] for h in held.values()], np.int64)

    return run


def _per_node(rows: list, nodes: list[tuple[int, int]], width: int, kind) -> tuple[np.ndarray, np.ndarray]:
    number = {n: i for i, n in enumerate(nodes)}
    a, b = np.zeros((len(nodes), width + 1), kind), np.zeros((len(nodes), width + 1), kind)
    for r in rows:
        a[number[r.tree, r.node], r.place], b[number[r.tree, r.node], r.place] = r.a, r.b
    return a, b


def _upper(blocks: DataFrame, rows: int, width: int, roots: dict[int, np.uint64], tried: int, least: int, node_rows: int):
    """The trees above nodes of at most ``node_rows`` rows, the keys of the nodes where these
    begin, and the values of larger nodes that cannot be parted."""
    tops = {t: Tree() for t in roots}
    ends, values = {}, {}
    open_nodes = {(t, 0): k for t, k in roots.items()}
    if rows <= node_rows:
        return tops, open_nodes, values
    while open_nodes:
        nodes, keys = list(open_nodes), np.array(list(open_nodes.values()), np.uint64)
        wanted: dict[int, list[int]] = {}
        for tree, node in nodes:
            wanted.setdefault(tree, []).append(node)
        found = blocks.mapInArrow(_ranges(width, tops, wanted), "tree int, node int, place int, a double, b double")
        low, high = _per_node(found.groupBy("tree", "node", "place").agg(F.min("a").alias("a"), F.max("b").alias("b")).collect(), nodes, width, np.float64)
        cut = cuts_of(keys, low[:, :-1], high[:, :-1])
        found = blocks.mapInArrow(_below(width, tops, wanted, dict(zip(nodes, cut))), "tree int, node int, place int, a long, b long")
        n, total = _per_node(found.groupBy("tree", "node", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect(), nodes, width, np.int64)
        feature = chosen(keys, n[:, -1], total[:, -1], low[:, :-1], high[:, :-1], n[:, :-1], total[:, :-1], tried, least)
        feature[low[:, -1] == high[:, -1]] = -1
        open_nodes = {}
        for i, (tree, node) in enumerate(nodes):
            f = int(feature[i])
            if f < 0:
                values[tree, node] = int(np.rint(total[i, -1] / n[i, -1]))
                continue
            sizes = (int(n[i, f]), int(n[i, -1] - n[i, f]))
            for child, key, size in zip(tops[tree].split(node, f, 0, float(cut[i, f])), child_keys(keys[i : i + 1]), sizes):
                (open_nodes if size > node_rows else ends)[tree, child] = key
    return tops, ends, values


def _parts(width: int, tops, wanted):
    """The rows of each wanted node, packed."""

    def run(batches):
        for tree, node, x, unit in _open_rows(batches, width, tops, wanted):
            columns = (pa.array([tree], pa.int32()), pa.array([node], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary()))
            yield pa.record_batch(list(columns), ["tree", "node", "x", "unit"])

    return run


def _packed(tree: int, node: int, arrays) -> pa.Table:
    kinds = (np.int32, np.float64, np.int32, np.int64)
    columns = [pa.array([np.asarray(a, k).tobytes()], pa.binary()) for a, k in zip(arrays, kinds)]
    return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int32()), *columns], ["tree", "node", "feature", "cut", "below", "value"])


def _growing(width: int, keys: dict[tuple[int, int], int], tried: int, least: int):
    def run(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), np.float64).reshape(-1, width)
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.int64)
        return _packed(tree, node, grown(x, unit, np.uint64(keys[tree, node]), tried, least))

    return run


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SCORED_ROWS):
            x = np.asarray(batch.column(0).slice(begin, SCORED_ROWS).flatten(), np.float64)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary())], ["x"])


def _placed(width: int, tops):
    """The rows of each block in each node where the table's part of a tree begins."""

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("x").to_pylist()):
                x = np.frombuffer(data, np.float64).reshape(-1, width)
                for tree, top in tops.value.items():
                    place = top.place(x, binned=False)
                    for node in np.unique(place).tolist():
                        own = np.flatnonzero(place == node)
                        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                        columns = (block, tree, node, own.astype(np.int32).tobytes(), x[own].tobytes())
                        yield pa.record_batch([pa.array([c], k) for c, k in zip(columns, kinds)], ["block", "tree", "node", "own", "x"])

    return run


def _valued(width: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"], np.float64).reshape(-1, width)
                feature, below = np.frombuffer(r["feature"], np.int32), np.frombuffer(r["below"], np.int32)
                cut, node = np.frombuffer(r["cut"], np.float64), np.zeros(len(x), np.int64)
                moving = np.flatnonzero(feature[node] >= 0)
                while len(moving):
                    at = node[moving]
                    node[moving] = below[at] + (x[moving, feature[at]] > cut[at])
                    moving = moving[feature[node[moving]] >= 0]
                value = np.frombuffer(r["value"], np.int64)[node]
                columns = (pa.array([r["block"]]), pa.array([r["own"]], pa.binary()), pa.array([value.tobytes()], pa.binary()))
                yield pa.record_batch(list(columns), ["block", "own", "value"])

    return run


def _totals(width: int):
    """Rows of a block with the sum of their values over all trees."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = np.frombuffer(left.column("x")[0].as_py(), np.float64)
        total = np.zeros(len(x) // width, np.int64)
        for own, value in zip(right.column("own").to_pylist(), right.column("value").to_pylist()):
            total[np.frombuffer(own, np.int32)] += np.frombuffer(value, np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x), width).cast(pa.list_(pa.float64()))
        return pa.table([lists, pa.array(total)], ["__x", "__total"])

    return run


@dataclass
class ExtraTrees:
    """Upper nodes of all trees, the table of what is below them, and the scale of its values."""

    tops: dict[int, Tree]
    below: DataFrame
    width: int
    scale: float

    @classmethod
    def fit(
        cls, train: DataFrame, label: str, trees: int = 400, least: int = 3, share: float = 0.8, seed: int = 0, node_rows: int = NODE_ROWS
    ) -> ExtraTrees:
        """``train`` has ``features`` and ``label``; features are finite, rows without a label
        teach nothing. All rows teach every tree. A node is parted while ``least`` rows stay on
        both sides and its targets differ; ``share`` of the features compete in it. Targets are
        rounded to integers as fine as exact sums of all rows allow. Trees are the same for any
        ``node_rows``."""
        rows = train.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
        n, reach, width = rows.agg(F.count("y"), F.max(F.abs("y")), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no train rows")
        # sums of all rows stay exact integers, of doubles too
        scale = 2.0 ** int(52 - np.ceil(np.log2(max(reach, 1e-300))) - np.ceil(np.log2(n + 1)))
        blocks = staged(rows.mapInArrow(_blocks(scale), "x binary, unit binary"))
        tried = max(1, int(share * width))
        tops, tables = {}, []
        wave = max(1, min(trees, COPIED_ROWS // n))
        for begin in range(0, trees, wave):
            numbers = np.arange(begin, min(begin + wave, trees))
            roots = dict(zip(numbers.tolist(), root_keys(seed, numbers)))
            upper, ends, values = _upper(blocks, n, width, roots, tried, least, node_rows)
            wanted: dict[int, list[int]] = {}
            for tree, node in ends:
                wanted.setdefault(tree, []).append(node)
            keys = {k: int(v) for k, v in ends.items()}
            parts = blocks.mapInArrow(_parts(width, upper, wanted), PART)
            tables.append(staged(parts.groupBy("tree", "node").applyInArrow(_growing(width, keys, tried, least), MODEL)))
            if values:
                alone = [(t, m, np.int32([-1]).tobytes(), np.zeros(1).tobytes(), np.int32([0]).tobytes(), np.int64([v]).tobytes()) for (t, m), v in values.items()]
                tables.append(staged(train.sparkSession.createDataFrame(alone, MODEL)))
            tops |= upper
        unstage(blocks)
        return cls(tops, reduce(DataFrame.unionByName, tables), width, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, the mean of all trees. Equal features are scored once; blocks of
        them are written, joined with the model by tree and node, and summed as integers."""
        context, width = df.sparkSession.sparkContext, self.width
        vectors = df.select(vector_to_array("features").alias("x")).where("x IS NOT NULL").distinct()
        blocks = staged(vectors.mapInArrow(_matrices, "x binary").withColumn("block", F.sha2("x", 256)))
        tops = context.broadcast(self.tops)
        placed = blocks.mapInArrow(_placed(width, tops), "block string, tree int, node int, own binary, x binary")
        valued = placed.join(self.below, ["tree", "node"]).drop("tree", "node").mapInArrow(_valued(width), "block string, own binary, value binary")
        totals = blocks.groupBy("block").cogroup(valued.groupBy("block")).applyInArrow(_totals(width), "__x array<double>, __total long")
        scored = totals.select("__x", (F.col("__total") / F.lit(self.scale * len(self.tops))).alias("prediction"))
        return df.withColumn("__x", vector_to_array("features")).join(scored, "__x", "left").drop("__x")
