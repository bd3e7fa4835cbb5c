"""Token counts by greedy longest match, without building the pieces.

The vocabulary trie is completed with failure links: where no piece goes on, the tokens that
are already certain are popped and the match continues with what is left of them. The numbers
popped are tabulated per state and byte, so a text costs one table step per byte. Pieces that
begin with a space open a word, all others continue it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.llm.vocabulary import DEFAULT_MODEL, LongestMatch, lanes, read_vocabulary, units, worker_automaton

CELLS = 200_000


def unit_tokens(matcher: LongestMatch, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of greedy pieces of each unit."""
    out = np.zeros(len(begins), dtype=np.int64)
    for take, running in lanes(lengths, CELLS, width=1):
        state, total = np.zeros(len(take), dtype=np.int64), np.zeros(len(take), dtype=np.int64)
        for i, live in enumerate(running):
            c = text[begins[take[:live]] + i]
            total[:live] += matcher.popped[state[:live], c]
            state[:live] = matcher.step[state[:live], c]
        out[take] = total + matcher.rest[state]
    return out


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = worker_automaton(LongestMatch, vocabulary.value)
        for batch in batches:
            for begin, end, text, begins, lengths, unit, rows in units(batch.column(1)):
                tokens = unit_tokens(matcher, text, begins, lengths)
                words = np.bincount(rows, minlength=end - begin)
                total = np.bincount(rows, weights=tokens[unit], minlength=end - begin).astype(np.int64)
                yield pa.record_batch(
                    [batch.column(0).slice(begin, end - begin), pa.array(words, pa.int64()), pa.array(total, pa.int64())],
                    ["doc_id", "n_units", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_units, n_tokens) for each row of ``docs(doc_id, text, ...)``: runs of spaces
    with the word after them, and greedy pieces. NULL and empty texts have none; any other
    text has a space put in front. Repeated rows count each, extra columns are ignored."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return plain.mapInArrow(_count(vocabulary), "doc_id long, n_units long, n_tokens long")
