"""Train rows as blocks of binned arrays, and the passes over them that boosting needs.

A block holds the bins of up to BLOCK_ROWS rows, their targets and their predictions so far. A
pass is one job: tasks place the block's rows in the trees grown since the predictions were last
written, and return counts and sums per cell. Residuals are summed as integers of a fixed scale,
so a sum does not depend on the order or the number of tasks. Where more than DIRECT tasks
return sums, these meet on executors before they reach the driver; what reaches it is bounded by
features, bins and leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.functions.ordering import ordered_integers, ranked_values
from panelshock.session import staged, unstage

BINS, BLOCK_ROWS, PART_ROWS, DIRECT = 255, 16_384, 262_144, 16
# cells and leaves with at most so many rows are listed, not counted any further
LISTED, CELL_BITS, LEAF_ROWS = 4096, 16, 512
TOP = np.uint64(1 << 63)
BLOCK = "x binary, y binary, f binary"


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Rows whose bin (or value) of the node's feature
    is at most ``bin`` (or ``threshold``) go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, threshold: float) -> tuple[int, int]:
        """Turn a leaf into a test with two new leaves."""
        self.feature[node], self.bin[node], self.threshold[node] = feature, bin, threshold
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, blank in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(blank)
        return self.left[node], self.right[node]

    def leaves(self) -> list[int]:
        """Nodes without a test that the root reaches."""
        found, open_nodes = [], [0]
        while open_nodes:
            node = open_nodes.pop()
            if self.feature[node] < 0:
                found.append(node)
            else:
                open_nodes += [self.left[node], self.right[node]]
        return sorted(found)

    def place(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of each row of ``x`` (rows by features)."""
        feature, left, right = (np.array(c) for c in (self.feature, self.left, self.right))
        limit = np.array(self.bin if binned else self.threshold)
        node = np.zeros(len(x), dtype=np.int64)
        moving = np.flatnonzero(feature[node] >= 0)
        while len(moving):
            at = node[moving]
            node[moving] = np.where(x[moving, feature[at]] <= limit[at], left[at], right[at])
            moving = moving[feature[node[moving]] >= 0]
        return node

    def predict(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.array(self.value)[self.place(x, binned)]


@dataclass
class Binning:
    """Ascending thresholds of each feature; a value's bin is the number of thresholds below it."""

    thresholds: list[np.ndarray]

    @classmethod
    def fit(cls, train: DataFrame, bins: int = BINS) -> Binning:
        """Halfway between all distinct values of a feature with at most ``bins`` of them, else
        between the values at equally spaced ranks. One row per distinct value is counted; at
        most two per bin and feature reach the driver."""
        long = train.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
        counted = staged(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
        sizes = {r["feature"]: r["n"] for r in counted.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        many = [f for f, n in sizes.items() if n > bins]
        found = counted.where(~F.col("feature").isin(many)).select("feature", "value").collect()
        if many:
            ranked = ranked_values(long.where(F.col("feature").isin(many)), ["feature"], "value", [k / bins for k in range(bins + 1)])
            found += ranked.select("feature", "value").collect()
        thresholds = []
        for f in range(max(sizes, default=-1) + 1):
            values = np.unique([r["value"] for r in found if r["feature"] == f])
            middle = values[:-1] / 2 + values[1:] / 2
            if len(middle) > bins - 1:  # two ranks a step: every second one
                middle = middle[np.linspace(0, len(middle) - 1, bins - 1).astype(int)]
            thresholds.append(middle)
        return cls(thresholds)

    def offsets(self) -> np.ndarray:
        """First cell of each feature's bins, and the number of all cells."""
        return np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.thresholds])]).astype(np.int64)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, dtype=np.uint8)
        for f, t in enumerate(self.thresholds):
            out[:, f] = np.searchsorted(t, x[:, f], side="left")
        return out


def _pack(binning: Binning, start: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(binning.thresholds)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                x = np.asarray(part.column(0).flatten()).reshape(part.num_rows, width)
                y = np.asarray(part.column(1), dtype=np.float64)
                f = np.full(len(y), start)
                yield pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in (binning.bins(x), y, f)], ["x", "y", "f"])

    return run


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, y, f in zip(*(batch.column(i) for i in range(3))):
            bins = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width)
            yield bins, np.frombuffer(y.as_py(), np.float64), np.frombuffer(f.as_py(), np.float64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal-length integer arrays per key; arrays under negative keys are lists, which
    pass."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(data.as_py(), np.int64)
            if key < 0:
                yield _keyed({key: part})
            else:
                total[key] = total[key] + part if key in total else part
    yield _keyed(total)


def _keyed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(list(total), pa.int32()), pa.array([a.tobytes() for a in total.values()], pa.binary())], ["key", "sums"]
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal cells per key."""
    held: dict[int, list] = {}
    for batch in batches:
        for key, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            parts = held.setdefault(key, [np.zeros(0, np.uint64), np.zeros(0, np.int64)])
            own = np.concatenate([parts[0], np.frombuffer(cells.as_py(), np.uint64)])
            many = np.concatenate([parts[1], np.frombuffer(counts.as_py(), np.int64)])
            parts[0], place = np.unique(own, return_inverse=True)
            parts[1] = np.zeros(len(parts[0]), np.int64)
            np.add.at(parts[1], place, many)
    kinds = (pa.int32(), pa.binary(), pa.binary())
    columns = (list(held), [p[0].tobytes() for p in held.values()], [p[1].tobytes() for p in held.values()])
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "cells", "counts"])


def histogram(x: np.ndarray, unit: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and summed units of every feature's bins."""
    n, g = (np.zeros(int(offsets[-1]), np.int64) for _ in range(2))
    for f in range(x.shape[1]):
        size = int(offsets[f + 1] - offsets[f])
        n[offsets[f] : offsets[f + 1]] = np.bincount(x[:, f], minlength=size)
        g[offsets[f] : offsets[f + 1]] = np.bincount(x[:, f], weights=unit, minlength=size).astype(np.int64)
    return n, g


@dataclass
class Leaf:
    """Rows and sums of a leaf's cells; of a small leaf its rows too, bins and residual."""

    n: np.ndarray
    g: np.ndarray
    rows: np.ndarray | None = None

    @classmethod
    def of(cls, rows: np.ndarray, offsets: np.ndarray) -> Leaf:
        return cls(*histogram(rows[:, :-1], rows[:, -1].astype(np.float64), offsets), rows)

    def without(self, other: Leaf) -> Leaf:
        """The sibling of a child."""
        return Leaf(self.n - other.n, self.g - other.g)

    def parted(self, feature: int, bin: int, offsets: np.ndarray) -> tuple[Leaf, Leaf]:
        """Both children of a listed leaf."""
        left = self.rows[:, feature] <= bin
        return Leaf.of(self.rows[left], offsets), Leaf.of(self.rows[~left], offsets)


class Blocks:
    """Binned train rows with a target, and the running prediction of a boosted model."""

    def __init__(self, train: DataFrame, label: str, start: Callable[[DataFrame], float], rate: float, write_every: int = 10):
        """``start`` gives the first prediction from the rows (features, y)."""
        rows = train.select("features", F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
        self.binning = Binning.fit(rows)
        placed = rows.select("y", F.spark_partition_id().alias("part"))
        self.rows, low, high, parts = placed.agg(F.count("y"), F.min("y"), F.max("y"), F.count_distinct("part")).first()
        if not self.rows:
            raise ValueError("no train rows")
        self.start, self.rate, self.write_every = float(start(rows)), rate, write_every
        self.width, self.offsets = len(self.binning.thresholds), self.binning.offsets()
        # residuals stay within twice the range; a block's sum fits a double's integers exactly
        reach = max(2.0 * (high - low), abs(high), abs(low), 1e-300)
        self.scale = 2.0 ** int(min(52 - np.log2(BLOCK_ROWS), 62 - np.log2(self.rows)) - np.ceil(np.log2(reach)) - 1)
        self.parts = int(max(1, min(parts, -(-self.rows // PART_ROWS))))
        vectors = rows.select(vector_to_array("features").alias("x"), "y").coalesce(self.parts)
        self._set(staged(vectors.mapInArrow(_pack(self.binning, self.start), BLOCK)), None)
        self.trees: list[Tree] = []
        self.fresh: list[Tree] = []

    def _set(self, table: DataFrame, old: DataFrame | None) -> None:
        self.table = table.coalesce(self.parts).persist(StorageLevel.MEMORY_AND_DISK)
        self.written = table
        if old is not None:
            unstage(old)

    def add(self, tree: Tree) -> None:
        """Take a finished tree into the model; its values are scaled by the rate. Predictions
        are written again after ``write_every`` trees, and the last written ones deleted."""
        self.trees.append(tree)
        self.fresh.append(tree)
        if len(self.fresh) == self.write_every:
            now, width = self._now(), self.width

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for x, y, f in _arrays(batches, width):
                    yield pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in (x, y, now(x, f))], ["x", "y", "f"])

            old, held = self.written, self.table
            self._set(staged(held.mapInArrow(run, BLOCK)), old)
            held.unpersist()
            self.fresh = []

    def close(self) -> None:
        self.table.unpersist()
        unstage(self.written)

    def _now(self):
        fresh, rate = list(self.fresh), self.rate

        def predicted(x: np.ndarray, f: np.ndarray) -> np.ndarray:
            for tree in fresh:
                f = f + rate * tree.predict(x, binned=True)
            return f

        return predicted

    def _sums(self, per_block) -> dict[int, np.ndarray]:
        """One pass: ``per_block(x, residual)`` yields (key, integer array). Arrays of one key
        are added up, those of a negative key put behind each other."""
        now, width = self._now(), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for x, y, f in _arrays(batches, width):
                for key, part in per_block(x, y - now(x, f)):
                    if key < 0:
                        yield _keyed({key: part})
                    else:
                        total[key] = total[key] + part if key in total else part
            yield _keyed(total)

        sums = self.table.mapInArrow(run, "key int, sums binary")
        if self.parts > DIRECT:
            sums = sums.repartition("key").mapInArrow(_added, "key int, sums binary")
        out: dict[int, np.ndarray] = {}
        for row in sums.collect():
            part = np.frombuffer(row.sums, np.int64)
            if row.key in out:
                part = np.concatenate([out[row.key], part]) if row.key < 0 else out[row.key] + part
            out[row.key] = part
        return out

    def leaves(self, tree: Tree, counted: list[int], listed: list[int], limit: float = np.inf) -> dict[int, Leaf]:
        """What one pass finds of leaves: histograms of ``counted``, the rows of ``listed``.
        Residuals are cut at +-limit and in units of 1 / scale."""
        offsets, scale, width = self.offsets, self.scale, self.width

        def per_block(x, residual):
            place = tree.place(x, True)
            unit = np.rint(np.clip(residual, -limit, limit) * scale)
            for node in counted:
                own = place == node
                yield node, np.concatenate(histogram(x[own], unit[own], offsets))
            for node in listed:
                own = place == node
                yield -1 - node, np.column_stack([x[own].astype(np.int64), unit[own].astype(np.int64)]).ravel()

        out, cells = {}, int(offsets[-1])
        for key, found in self._sums(per_block).items():
            if key >= 0:
                out[key] = Leaf(found[:cells], found[cells:])
            else:
                out[-1 - key] = Leaf.of(found.reshape(-1, width + 1), offsets)
        return out

    def leaf_means(self, tree: Tree, around: dict[int, float], limit: float) -> dict[int, float]:
        """Mean of the residuals' distance from ``around`` per leaf, cut at +-limit."""
        scale = self.scale

        def per_block(x, residual):
            place = tree.place(x, True)
            for leaf, centre in around.items():
                own = residual[place == leaf]
                yield leaf, np.array([len(own), np.rint(np.clip(own - centre, -limit, limit) * scale).sum()], dtype=np.int64)

        return {k: float(v[1]) / scale / max(1, int(v[0])) for k, v in self._sums(per_block).items()}

    def quantiles(self, tree: Tree, sizes: dict[int, int], fraction: float, absolute: bool = False) -> dict[int, float]:
        """Exact quantile of the (absolute) residuals in each leaf of ``sizes``, leaves with their
        rows, by linear interpolation. Residuals are integers of the same order; cells with a
        wanted rank are cut into 2^16, and listed whole once they have at most LISTED rows."""
        open_cells, values = {}, {}
        for leaf, n in sizes.items():
            position = fraction * (n - 1)
            wanted = sorted({int(np.floor(position)), int(np.ceil(position))})
            open_cells[leaf] = [(0, 64 - CELL_BITS, n, 0, wanted)]  # first integer, width in bits, rows, rows before, ranks
            values[leaf] = {}
        while any(open_cells.values()):
            asked = [(leaf, *cell) for leaf, cells in open_cells.items() for cell in cells]
            found = self._cells(tree, [(leaf, base, shift, rows <= LISTED) for leaf, base, shift, rows, _, _ in asked], absolute)
            open_cells = {leaf: [] for leaf in sizes}
            for key, (leaf, base, shift, rows, before, wanted) in enumerate(asked):
                cells, counts = found[key]
                upto = before + np.cumsum(counts)
                for rank in wanted:
                    i = int(np.searchsorted(upto, rank, side="right"))
                    if rows <= LISTED or shift == 0:
                        values[leaf][rank] = _as_double(int(cells[i]) if rows <= LISTED else base + int(cells[i]))
                    else:
                        first = base + (int(cells[i]) << shift)
                        nested = (first, shift - CELL_BITS, int(counts[i]), int(upto[i] - counts[i]), [rank])
                        same = [c for c in open_cells[leaf] if c[0] == first]
                        if same:
                            same[0][4].append(rank)
                        else:
                            open_cells[leaf].append(nested)
        out = {}
        for leaf, n in sizes.items():
            position = fraction * (n - 1)
            low, high = int(np.floor(position)), int(np.ceil(position))
            a, b = values[leaf][low], values[leaf][high]
            out[leaf] = a if low == high else (high - position) * a + (position - low) * b
        return out

    def _cells(self, tree: Tree, asked: list[tuple[int, int, int, bool]], absolute: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        now, width = self._now(), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts():
                for x, y, f in _arrays(batches, width):
                    residual = y - now(x, f)
                    place = tree.place(x, True)
                    order = ordered_integers(np.abs(residual) if absolute else residual).view(np.uint64) ^ TOP
                    for key, (leaf, base, shift, listed) in enumerate(asked):
                        own = order[place == leaf]
                        own = own[(own >= np.uint64(base)) & (own - np.uint64(base) <= np.uint64((1 << (shift + CELL_BITS)) - 1))]
                        cells, counts = np.unique(own if listed else (own - np.uint64(base)) >> np.uint64(shift), return_counts=True)
                        kinds = (pa.int32(), pa.binary(), pa.binary())
                        columns = ([key], [cells.tobytes()], [counts.astype(np.int64).tobytes()])
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "cells", "counts"])

            yield from _counted(parts())

        counted = self.table.mapInArrow(run, "key int, cells binary, counts binary")
        if self.parts > DIRECT:
            counted = counted.repartition("key").mapInArrow(_counted, "key int, cells binary, counts binary")
        rows = [pa.record_batch([pa.array([r.key], pa.int32()), pa.array([bytes(r.cells)]), pa.array([bytes(r.counts)])], ["key", "cells", "counts"]) for r in counted.collect()]
        merged = next(_counted(iter(rows)))
        return {
            k: (np.frombuffer(c.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64))
            for k, c, n in zip(merged.column(0).to_pylist(), merged.column(1), merged.column(2))
        }


def _as_double(order: int) -> float:
    """The double of an integer of ``quantiles``."""
    bits = np.array([order], dtype=np.uint64) ^ TOP
    signed = bits.view(np.int64)
    return float((signed ^ ((signed >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def best_split(
    leaf: Leaf, binning: Binning, offsets: np.ndarray, penalty: float, least_rows: int
) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best test of a leaf, from the rows and sums of its cells; of
    equal gains the first feature and the lowest bin. None where no test gains."""
    best, n, g = None, leaf.n, leaf.g
    rows, total = int(n[offsets[0] : offsets[1]].sum()), int(g[offsets[0] : offsets[1]].sum())
    for f in range(len(binning.thresholds)):
        left_n = np.cumsum(n[offsets[f] : offsets[f + 1]])[:-1]
        left_g = np.cumsum(g[offsets[f] : offsets[f + 1]])[:-1]
        fits = (left_n >= least_rows) & (rows - left_n >= least_rows)
        if not fits.any():
            continue
        a, b = left_g.astype(np.float64), (total - left_g).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = a * a / (left_n + penalty) + b * b / (rows - left_n + penalty)
            gain = parts - float(total) ** 2 / (rows + penalty)
        # differences within rounding are no gain and no order
        gain = np.where(fits & (gain > 1e-12 * parts), gain, -np.inf)
        i = int(np.argmax(gain >= gain.max() * (1 - 1e-12)))
        if np.isfinite(gain[i]) and (best is None or gain[i] > best[0] * (1 + 1e-12)):
            best = (float(gain[i]), f, i)
    return best
