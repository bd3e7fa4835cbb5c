"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, learned by cyclic boosting of shallow trees;
the strongest pairs of features get tables as well. A score is the sigmoid of the sum of a
text's table entries. Features come from the text's bytes, words and lines only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshock.llm.textbytes import WHITE, slices, word_hashes, word_spans
from panelshock.llm.workspace import Workspace, id_remainder

TRAIN_ROWS = 10_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 150, 60, 0.1, 3, 5.0
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "stop_share", "beyond_ascii_share",
    "lines_per_word", "distinct_share", "top_share", "repeat_share", "symbol_end_share", "symbol_word_share", "long_share",
    "words_per_stop", "distinct_line_share", "letter_share",
)
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True
_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "high": _BYTES >= 128,
    "stop": np.isin(_BYTES, np.frombuffer(b".,;:?", np.uint8)),
    "white": WHITE,
}
_KINDS["symbol"] = ~np.logical_or.reduce(list(_KINDS.values()))


def _distinct(hashes: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row and the uses of its commonest one."""
    if not len(hashes):
        return np.zeros(count), np.zeros(count)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))
    starts = np.flatnonzero(new)
    uses = np.diff(np.append(starts, len(h)))
    most = np.zeros(count)
    np.maximum.at(most, r[starts], uses)
    return np.bincount(r[starts], minlength=count), most


def slice_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    n = {}
    for kind, mask in _KINDS.items():
        total = np.concatenate([[0], np.cumsum(mask[data])])
        n[kind] = (total[offsets[1:]] - total[offsets[:-1]]).astype(float)
    begins, ends, owner = word_spans(data, offsets)
    hashes = word_hashes(data, begins, ends)
    words = np.bincount(owner, minlength=rows).astype(float)
    distinct, most = _distinct(hashes, owner, rows)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) if len(hashes) else np.zeros(0, bool)
    last = _KINDS["symbol"][data[ends - 1]] if len(ends) else np.zeros(0, bool)
    lb, le, lo = word_spans(data, offsets, NEWLINE)
    lines = np.bincount(lo, minlength=rows).astype(float)
    own_lines, _ = _distinct(word_hashes(data, lb, le), lo, rows)
    per_word = 1.0 / np.maximum(words, 1)
    per_byte = 1.0 / np.maximum(size, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=rows) * per_word

    letters = n["upper"] + n["lower"]
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), (size - n["white"]) * per_word, n["upper"] / np.maximum(letters, 1),
            n["digit"] * per_byte, n["symbol"] * per_byte, n["stop"] * per_byte, n["high"] * per_byte,
            lines * per_word, distinct * per_word, most * per_word, share(again), share(last), share(last & (ends - begins == 1)),
            share(ends - begins > 24), words / (n["stop"] + 1), own_lines / np.maximum(lines, 1), (letters + n["high"]) * per_byte,
        ]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in slices(batch.column(1)):
            found = slice_features(data, offsets)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0).slice(begin, end - begin), listed], ["doc_id", "features"])


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, features) for each row; NULL texts count as empty."""
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return plain.mapInArrow(_features, "doc_id long, features array<double>")


@dataclass(frozen=True)
class AdditiveModel:
    """Cuts of each feature, a table per feature and a table per pair (i, j)."""

    base: float
    cuts: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[_coarse(b[:, i], self.cuts[i]), _coarse(b[:, j], self.cuts[j])]
        return 1.0 / (1.0 + np.exp(-total))


def _coarse(bins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(cuts) + 1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of the best tree with LEAVES leaves over ordered bins."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(leaves):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = _gain(gs[m] - gs[a], hs[m] - hs[a]) + _gain(gs[b] - gs[m], hs[b] - hs[m]) - _gain(gs[b] - gs[a], hs[b] - hs[a])
                if gain.max() > best[0]:
                    best = (float(gain.max()), k, int(m[gain.argmax()]))
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + RIDGE)
    return out


def _best_cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a pair's table into four quadrants."""
    gs, hs = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    best = (0.0, np.zeros_like(g))
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            quads = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            gq = [gs[a, b], gs[a, -1] - gs[a, b], gs[-1, b] - gs[a, b], gs[-1, -1] - gs[a, -1] - gs[-1, b] + gs[a, b]]
            hq = [hs[a, b], hs[a, -1] - hs[a, b], hs[-1, b] - hs[a, b], hs[-1, -1] - hs[a, -1] - hs[-1, b] + hs[a, b]]
            gain = sum(x * x / (y + RIDGE) for x, y in zip(gq, hq))
            if gain > best[0]:
                step = np.zeros_like(g)
                for q, x, y in zip(quads, gq, hq):
                    step[q] = x / (y + RIDGE)
                best = (gain, step)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost on rows of features and 0/1 labels. Without rows, or with one label only, the
    model is a constant near the labels' rate."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(rate / (1.0 - rate)))
    cuts = tuple(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES)))
    model = AdditiveModel(base, cuts, tuple(np.zeros(len(c) + 1) for c in cuts), ())
    if len(y) == 0 or y.min() == y.max():
        return model
    b, total = model.bins(x), np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1.0 / (1.0 + np.exp(-total))
            step = RATE * _shallow(np.bincount(b[:, j], y - p, len(table)), np.bincount(b[:, j], p * (1 - p), len(table)))
            table += step
            total += step[b[:, j]]
    coarse = np.column_stack([_coarse(b[:, j], c) for j, c in enumerate(cuts)])

    def grids(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
        return tuple(np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (y - p, p * (1 - p)))

    p = 1.0 / (1.0 + np.exp(-total))
    ranked = sorted(
        ((-_best_cross(*grids(i, j, p))[0], i, j) for i in range(len(cuts)) for j in range(i + 1, len(cuts)))
    )[:PAIRS]
    pairs = tuple((i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked)
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            p = 1.0 / (1.0 + np.exp(-total))
            step = RATE * _best_cross(*grids(i, j, p))[1]
            table += step
            total += step[coarse[:, i], coarse[:, j]]
    return AdditiveModel(base, cuts, model.tables, pairs)


def held_out() -> Column:
    return F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))


def train(features: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labelled texts, the first by a hash of the id, of those whose
    crc32 of doc_id modulo 3 is not 1. Labels that are NULL or without a text teach nothing;
    repeated labels count each."""
    taught = labels.where(F.col("quality").isNotNull() & (id_remainder("doc_id", 3) != 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("label")
    )
    sample = features.join(taught, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows).collect()
    x = np.array([r["features"] for r in sample], dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in sample], dtype=float))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = model.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(learned.scores(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, work: Workspace, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text, ...)``: the probability of label 1.

    Only the text is an input. Empty and NULL texts are scored like any other, equal texts
    alike; extra columns are ignored; without usable labels every score is 0.5."""
    features = work.table(text_features(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(train(features, labels, rows))
    return features.mapInArrow(_score(model), "doc_id long, score double")
