"""Gradient boosting on blocks of binned rows: Huber loss, and leaf-limited squared loss."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.functions.ordering import exact_quantiles
from panelshock.operators.blocks import LEAF_ROWS, Blocks, Leaf, Tree, best_split

# The library defaults the compared models rely on.
CLIP_QUANTILE = 0.9
LEAST_LEAF_ROWS = 20


@dataclass
class Boosted:
    """Fitted start value, rate and trees."""

    start: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: all trees over one Arrow batch of vectors at a time. One column
        expression per tree would outgrow generated code at 200 stages."""
        start, rate, trees = self.start, self.rate, self.trees

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            total = np.full(len(features), start)
            if len(features):
                x = np.vstack(features.to_numpy())
                for tree in trees:
                    total = total + rate * tree.predict(x)
            return pd.Series(total)

        return df.withColumn("prediction", predict(vector_to_array("features")))


class HuberBoosting(Boosted):
    """Trees of limited depth on clipped residuals, leaves set for the Huber loss."""

    @classmethod
    def fit(cls, train: DataFrame, label: str, stages: int = 200, rate: float = 0.04, depth: int = 2) -> HuberBoosting:
        """``train`` has ``features`` and ``label``. Per stage: residuals are cut at the 0.9
        quantile of their size, a tree is grown to the cut ones level by level, and each leaf
        gets its median residual plus the mean cut distance from it. Quantiles are exact.
        Features are cut at most 255 times, between distinct values where there are no more."""
        blocks = Blocks(train, label, lambda rows: exact_quantiles(rows, [], "y", {"q": 0.5}).first()["q"], rate)
        for _ in range(stages):
            limit = blocks.quantiles(Tree(), {0: blocks.rows}, CLIP_QUANTILE, absolute=True)[0]
            tree, sizes = _level_wise(blocks, limit, depth)
            medians = blocks.quantiles(tree, sizes, 0.5)
            shifts = blocks.leaf_means(tree, medians, limit)
            for leaf, median in medians.items():
                tree.value[leaf] = median + shifts[leaf]
            blocks.add(tree)
        blocks.close()
        return cls(blocks.start, rate, blocks.trees)


def _level_wise(blocks: Blocks, limit: float, depth: int) -> tuple[Tree, dict[int, int]]:
    """A tree grown by at most one pass per level, and the rows of its leaves."""
    tree, sizes = Tree(), {0: blocks.rows}
    known = {} if depth == 0 else _root(blocks, limit)
    for level in range(depth):
        pairs = []
        for node, leaf in known.items():
            chosen = best_split(leaf, blocks.binning, blocks.offsets, 0.0, 1)
            if chosen:
                _split(blocks, tree, node, leaf, chosen, sizes)
                pairs.append((leaf, node))
        if level + 1 == depth or not pairs:
            break
        known = _children(blocks, tree, pairs, sizes, limit)
    return tree, {leaf: sizes[leaf] for leaf in tree.leaves()}


def _root(blocks: Blocks, limit: float = np.inf) -> dict[int, Leaf]:
    small = blocks.rows <= LEAF_ROWS
    return blocks.leaves(Tree(), [] if small else [0], [0] if small else [], limit)


def _split(blocks: Blocks, tree: Tree, node: int, leaf: Leaf, chosen: tuple[float, int, int], sizes: dict[int, int]) -> None:
    _, feature, bin = chosen
    left, right = tree.split(node, feature, bin, float(blocks.binning.thresholds[feature][bin]))
    first = blocks.offsets[feature]
    sizes[left] = int(leaf.n[first : first + bin + 1].sum())
    sizes[right] = sizes[node] - sizes[left]


def _children(blocks: Blocks, tree: Tree, pairs: list[tuple[Leaf, int]], sizes: dict[int, int], limit: float = np.inf) -> dict[int, Leaf]:
    """The children of split leaves (leaf, node). Those of a listed leaf are parted here; of
    others, one pass lists the small ones and counts the smaller sibling of the rest, and
    the larger sibling is what is left of the parent."""
    out, counted, listed, rest = {}, [], [], []
    for leaf, node in pairs:
        children = (tree.left[node], tree.right[node])
        if leaf.rows is not None:
            out.update(zip(children, leaf.parted(tree.feature[node], tree.bin[node], blocks.offsets)))
            continue
        small, large = sorted(children, key=lambda c: (sizes[c], c))
        (listed if sizes[small] <= LEAF_ROWS else counted).append(small)
        if sizes[large] <= LEAF_ROWS:
            listed.append(large)
        else:
            rest.append((leaf, small, large))
    if counted or listed:
        out.update(blocks.leaves(tree, counted, listed, limit))
    for leaf, small, large in rest:
        out[large] = leaf.without(out[small])
    return {c: out[c] for _, node in pairs for c in (tree.left[node], tree.right[node])}


class LeafBoosting(Boosted):
    """Squared loss, best-first trees of a limited number of leaves, L2 penalty on leaf values."""

    @classmethod
    def fit(
        cls, train: DataFrame, label: str, stages: int = 200, rate: float = 0.05, leaves: int = 15, penalty: float = 2.0,
        least_rows: int = LEAST_LEAF_ROWS,
    ) -> LeafBoosting:
        """``train`` has ``features`` and ``label``. The first prediction is the mean; a leaf's
        value is its summed residual over its rows plus the penalty."""
        blocks = Blocks(train, label, lambda rows: rows.agg(F.avg("y")).first()[0], rate)
        for _ in range(stages):
            blocks.add(_best_first(blocks, leaves, penalty, least_rows))
        blocks.close()
        return cls(blocks.start, rate, blocks.trees)


def _best_first(blocks: Blocks, leaves: int, penalty: float, least_rows: int) -> Tree:
    """The tree that always splits the leaf that gains most.

    The order of splits is played through with the leaves known so far; leaves that it would
    have had to know are looked up together in one pass, then it is played again. The last play
    knows every leaf it needed, so the tree is that of a split at a time, in as many passes as
    the part of the tree above small leaves is deep."""
    grown, sizes = Tree(), {0: blocks.rows}  # all nodes ever split, more than the final tree
    known = _root(blocks)
    splits = {0: best_split(known[0], blocks.binning, blocks.offsets, penalty, least_rows)}
    while True:
        heap = [(-splits[0][0], 0)] if splits[0] else []
        order, unknown, needed = [], [], False
        while heap and len(order) + 1 < leaves:
            needed = needed or bool(unknown)
            node = heapq.heappop(heap)[1]
            order.append(node)
            if grown.feature[node] < 0:
                _split(blocks, grown, node, known[node], splits[node], sizes)
            for child in (grown.left[node], grown.right[node]):
                if child not in splits:
                    unknown.append(child)
                elif splits[child]:
                    heapq.heappush(heap, (-splits[child][0], child))
        if not unknown or not (needed or len(order) + 1 < leaves):
            break
        found = _children(blocks, grown, [(known[n], n) for n in order if grown.left[n] in unknown], sizes)
        known.update(found)
        splits.update({c: best_split(leaf, blocks.binning, blocks.offsets, penalty, least_rows) for c, leaf in found.items()})
    return _pruned(blocks, grown, set(order), known, sizes, penalty)


def _pruned(blocks: Blocks, grown: Tree, split: set[int], known: dict[int, Leaf], sizes: dict[int, int], penalty: float) -> Tree:
    """The part of ``grown`` whose tests are in ``split``, with leaf values."""
    tree, end = Tree(), int(blocks.offsets[1])

    def copy(node: int, at: int, total: int) -> None:
        if node not in split:
            tree.value[at] = total / blocks.scale / (sizes[node] + penalty)
            return
        feature, bin = grown.feature[node], grown.bin[node]
        first = int(blocks.offsets[feature])
        left_total = int(known[node].g[first : first + bin + 1].sum())
        left, right = tree.split(at, feature, bin, grown.threshold[node])
        copy(grown.left[node], left, left_total)
        copy(grown.right[node], right, total - left_total)

    copy(0, 0, int(known[0].g[:end].sum()))
    return tree
