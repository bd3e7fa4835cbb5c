"""Masked pseudo-likelihood of texts under a bidirectional window network.

Each token is predicted from the two tokens on each side: log p(token | left, right) is the
network's log-probability of the token's class plus the log share of the token in its class.
The sum over all tokens scores a text. The commonest words are classes of their own; the rest
share classes by their last two bytes. Word counts cover every text and go through a shuffle.
Each word has the share its count gives it: the commonest are looked up in a table of fixed size,
the others, folded per text, are joined with the counts. The network, a few ten thousand numbers, learns on all partitions at once from every text,
and the partitions' weights are averaged after each round."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.llm.textbytes import LOWER_VALUES, UPPER, slices, word_hashes, word_spans
from panelshock.llm.workspace import Workspace

HOT_WORDS, OWN_CLASSES, SUFFIX_CLASSES = 65_536, 80, 48
CLASSES = OWN_CLASSES + SUFFIX_CLASSES
HIDDEN, SIDES = 32, (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 2048, 0.003
CHUNK = 1 << 12  # rows whose class scores stay in a core's cache
FLUSH = 1_500_000
UNIT = 1e-9  # logarithms of counts are added as integers, whose sums do not depend on order


def tokens(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: rows, word hashes, suffix classes and rows of the words."""
    for begin, end, data, offsets in slices(column):
        begins, ends, rows = word_spans(data, offsets)
        last = UPPER[data[ends - 1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        before = np.where(ends - begins > 1, UPPER[data[np.maximum(ends - 2, 0)]], 0).astype(np.int64) if len(ends) else last
        yield begin, end, word_hashes(data, begins, ends, LOWER_VALUES), OWN_CLASSES + (last * 31 + before * 17) % SUFFIX_CLASSES, rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with class and count; folded before they leave."""
    held: list[tuple] = []

    def folded():
        words, suffix, uses = (np.concatenate(x) for x in zip(*held))
        found, where, inverse = np.unique(words, return_index=True, return_inverse=True)
        return found, suffix[where], np.bincount(inverse, weights=uses).astype(np.int64)

    def out(found, suffix, uses):
        return pa.record_batch([pa.array(found.view(np.int64)), pa.array(suffix, pa.int32()), pa.array(uses)], ["word", "suffix", "uses"])

    for batch in batches:
        for _, _, words, suffix, _ in tokens(batch.column(0)):
            if len(words):
                found, where, uses = np.unique(words, return_index=True, return_counts=True)
                held.append((found, suffix[where], uses))
            if sum(len(h[0]) for h in held) > FLUSH:
                held = [folded()]
                if len(held[0][0]) > FLUSH // 2:
                    yield out(*held.pop())
    if held:
        yield out(*folded())


@dataclass(frozen=True)
class WordTable:
    """The OWN_CLASSES commonest words and their classes; hot words with their log counts; the
    log of each class's total and its log share of all tokens. Hashes ascend."""

    own: np.ndarray
    own_classes: np.ndarray
    hot: np.ndarray
    log_uses: np.ndarray
    log_total: np.ndarray
    unigram: np.ndarray

    def classes(self, words: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        place, known = _places(self.own, words)
        return np.where(known, self.own_classes[place], suffix) if len(self.own) else suffix

    def shares(self, words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log share in its class of each word, and whether the word is hot. Of another word it
        is the share of a single use, to which the log of its count must be added."""
        place, known = _places(self.hot, words)
        uses = np.where(known, self.log_uses[place], 0.0) if len(self.hot) else np.zeros(len(words))
        return uses - self.log_total[classes], known


def _places(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    place = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return place, table[place] == words


def word_table(docs: DataFrame, work: Workspace) -> tuple[WordTable, DataFrame]:
    """The table and the counts (word, suffix, uses) of all words of all texts. The HOT_WORDS
    commonest reach the driver; they save shuffle and decide nothing, and any other word holds
    less than one in HOT_WORDS of all tokens, so none is a hot key of the join."""
    counts = docs.select(F.col("text").cast("binary")).mapInArrow(_counted, "word long, suffix int, uses long")
    counts = work.table(counts.groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("uses").alias("uses")), "words")
    top = counts.orderBy(F.desc("uses"), "word").limit(max(HOT_WORDS, OWN_CLASSES)).collect()
    mass = np.zeros(CLASSES)
    for r in counts.groupBy("suffix").agg(F.sum("uses").alias("uses")).collect():
        mass[r["suffix"]] = r["uses"]
    words = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    uses = np.array([r["uses"] for r in top], dtype=float)
    for i, r in enumerate(top[:OWN_CLASSES]):
        mass[r["suffix"]] -= r["uses"]
        mass[i] = r["uses"]
    total = mass + 1.0  # one use is left for words never seen
    order, own = np.argsort(words), np.argsort(words[:OWN_CLASSES])
    return WordTable(words[own], own, words[order], np.log(uses[order]), np.log(total), np.log(total / total.sum())), counts


def initial_weights() -> np.ndarray:
    """Flat weights: inputs by side and class (one more for beyond the text), hidden bias,
    outputs, output bias."""
    inputs, outputs = len(SIDES) * (CLASSES + 1) * HIDDEN, HIDDEN * CLASSES
    draw = np.random.default_rng(7)
    return np.concatenate(
        [draw.normal(0, 0.3, inputs), np.zeros(HIDDEN), draw.normal(0, 0.1, outputs), np.zeros(CLASSES)]
    ).astype(np.float32)


def _parts(flat: np.ndarray) -> tuple[np.ndarray, ...]:
    a = len(SIDES) * (CLASSES + 1) * HIDDEN
    b, c = a + HIDDEN, a + HIDDEN + HIDDEN * CLASSES
    return flat[:a].reshape(len(SIDES), CLASSES + 1, HIDDEN), flat[a:b], flat[b:c].reshape(HIDDEN, CLASSES), flat[c:]


def contexts(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Class at each side of each token; CLASSES where the text has ended."""
    out = np.full((len(SIDES), len(classes)), CLASSES, dtype=np.int64)
    for k, side in enumerate(SIDES):
        a, b = (slice(side, None), slice(None, -side)) if side > 0 else (slice(None, side), slice(-side, None))
        same = rows[a] == rows[b]
        out[k, b][same] = classes[a][same]
    return out


def _forward(flat: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inputs, bias, outputs, base = _parts(flat)
    hidden = np.tanh(sum(inputs[k][around[k]] for k in range(len(SIDES))) + bias)
    logits = hidden @ outputs + base
    logits -= logits.max(axis=1, keepdims=True)
    return hidden, logits


def class_log_probabilities(flat: np.ndarray, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each token's class given its context."""
    out = np.empty(len(target))
    for a in range(0, len(target), CHUNK):
        part = slice(a, a + CHUNK)
        _, logits = _forward(flat, around[:, part])
        picked = logits[np.arange(len(logits)), target[part]]
        out[part] = picked - np.log(np.exp(logits).sum(axis=1))
    return out


class Learner:
    """Adam steps on one partition, from shared weights."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.steps = flat.copy(), 0
        self.mean, self.square = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        hidden, logits = _forward(self.flat, around)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(target)), target] -= 1.0
        p /= len(target)
        grad = np.zeros_like(self.flat)
        g_in, g_bias, g_out, g_base = _parts(grad)
        _, _, outputs, _ = _parts(self.flat)
        back = (p @ outputs.T) * (1.0 - hidden * hidden)
        for k in range(len(SIDES)):
            order = np.argsort(around[k].astype(np.int16), kind="stable")
            classes = around[k][order]
            first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
            g_in[k][classes[first]] = np.add.reduceat(back[order], first, axis=0)
        g_bias[:], g_out[:], g_base[:] = back.sum(axis=0), hidden.T @ p, p.sum(axis=0)
        self.steps += 1
        self.mean += 0.1 * (grad - self.mean)
        self.square += 0.001 * (grad * grad - self.square)
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.flat -= rate * self.mean / (np.sqrt(self.square) + 1e-7)


def targets(count: int, turn: int) -> np.ndarray:
    """Which of the tokens of a slice a round teaches; the rounds together teach each once."""
    return np.arange(turn, count, ROUNDS)


def _learn(table, weights, turn: int):
    """One round on a partition: every ROUNDS-th token of every text, other ones each round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Learner(weights.value), 0
        for batch in batches:
            for _, _, words, suffix, rows in tokens(batch.column(0)):
                classes = table.value.classes(words, suffix)
                around = contexts(classes, rows)
                picked = targets(len(words), turn)
                picked = np.random.default_rng(turn).permutation(picked)
                for a in range(0, len(picked), BATCH):
                    part = picked[a : a + BATCH]
                    learner.step(around[:, part], classes[part])
                seen += len(picked)
        if seen:
            yield pa.record_batch(
                [pa.array([seen], pa.int64()), pa.array([learner.flat.tolist()], pa.list_(pa.float32()))], ["seen", "weights"]
            )

    return run


@dataclass(frozen=True)
class MaskedModel:
    """``counts`` holds (word, uses) of every word of the corpus."""

    table: WordTable
    weights: np.ndarray
    counts: DataFrame


def train(docs: DataFrame, work: Workspace) -> MaskedModel:
    """Learn from every text of ``docs``. Partitions start each round from the average of the
    last, weighted by their tokens; without any token the first weights stay."""
    context = docs.sparkSession.sparkContext
    (table, counts), weights = word_table(docs, work), initial_weights()
    spread = context.broadcast(table)
    texts = docs.select(F.col("text").cast("binary"))
    for turn in range(ROUNDS):
        learned = texts.mapInArrow(_learn(spread, context.broadcast(weights), turn), "seen long, weights array<float>")
        learned = work.table(learned, f"round-{turn}")
        total = learned.agg(F.sum("seen")).first()[0]
        if total:
            mean = learned.select("seen", F.posexplode("weights").alias("place", "weight")).groupBy("place").agg(
                (F.sum(F.col("weight").cast("double") * F.col("seen")) / total).alias("weight")
            )
            weights = weights.copy()
            for r in mean.collect():
                weights[r["place"]] = r["weight"]
        work.drop(f"round-{turn}")
    return MaskedModel(table, weights, counts)


def _scored(model):
    """Tokens of each text, their summed log-probability as if words that are not hot were used
    once, and those words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, flat = model.value
        for batch in batches:
            for begin, end, words, suffix, rows in tokens(batch.column(1)):
                classes = table.classes(words, suffix)
                share, hot = table.shares(words, classes)
                found = class_log_probabilities(flat, contexts(classes, rows), classes) + share
                n = np.bincount(rows, minlength=end - begin)
                total = np.bincount(rows, weights=found, minlength=end - begin)
                word, row = words[~hot], rows[~hot]
                order = np.lexsort((word, row))
                word, row = word[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])[: len(word)])
                pairs = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(np.diff(np.append(first, len(word))))], ["word", "n"])
                cuts = np.searchsorted(row[first], np.arange(end - begin + 1)).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(total), pa.ListArray.from_arrays(cuts, pairs)],
                    ["doc_id", "n_tokens", "hot_sum", "others"],
                )

    return run


def score(docs: DataFrame, model: MaskedModel) -> DataFrame:
    """(doc_id, n_tokens, log_prob, per_token) for each row of ``docs(doc_id, text, ...)``: the
    sum and the mean of the tokens' log-probabilities. Tokens are words between white space of
    ASCII, A-Z lowered; a word that the model's corpus lacks counts as used once. Texts without
    tokens, NULL ones too, have 0 in all three; equal texts score alike but for
    rounding; extra columns are ignored."""
    work = Workspace(docs.sparkSession, "masked-lm-score")
    spread = docs.sparkSession.sparkContext.broadcast((model.table, model.weights))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    scored = plain.mapInArrow(_scored(spread), "doc_id long, n_tokens long, hot_sum double, others array<struct<word: long, n: long>>")
    # written, so that a row keeps its number
    scored = work.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # the log of one use is 0
    logs = model.counts.where("uses > 1").select("word", F.round(F.log("uses") / UNIT).cast("long").alias("log_uses"))
    others = scored.select("row", F.inline("others")).join(logs, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("log_uses")).alias("units"))
    whole = scored.drop("others").join(others, "row", "left")
    total = F.col("hot_sum") + F.coalesce("units", F.lit(0)) * UNIT
    return whole.select("doc_id", "n_tokens", total.alias("log_prob"), (total / F.greatest("n_tokens", F.lit(1))).alias("per_token"))
