"""Periodic runs of words by a dictionary of basic factors.

For each power-of-two length the dictionary names every factor of a text: equal names, equal
words. A factor is a pair of names of half its length. Where three successive occurrences of a
factor lie equally far apart, within twice its length, they form an arithmetic progression
and its difference is proposed as a period. A factor at least as long as the difference cannot
recur earlier inside a run, so each period belongs to one length, and every place of a run from
its first word on proposes it; neighbouring proposals of one difference are one run, whose first
place is its start and whose last gives its end. Factors that occur fewer than three times in
their text name nothing longer, so most texts end after two or three lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.llm.sentencepiece_codec import extended, numbered
from panelshock.llm.textbytes import PLACES, mix, slices, word_hashes, word_spans

LEAST_WORDS, LEAST_EXPONENT = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal run of consecutive equal-period
    words inside a row, at least LEAST_WORDS and LEAST_EXPONENT periods long, by start, then
    period. ``words`` are word hashes, ``rows`` their rows, ascending."""
    # a factor never equals one of another row
    key = mix(words + rows.astype(np.uint64) * PLACES[0])
    at = np.arange(len(words))
    names = np.empty(len(words), dtype=np.int64)
    found = []
    size = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        same = key[1:] == key[:-1]
        step = place[1:] - place[:-1]
        even = same[:-1] & same[1:] & (step[:-1] == step[1:]) & (2 * step[:-1] > size) & (step[:-1] <= size)
        hit = np.flatnonzero(even)
        found.append((step[hit], place[hit], np.full(len(hit), size)))
        group = np.concatenate([[0], np.cumsum(~same)])
        often = np.bincount(group)[group] >= 3
        names.fill(-1)
        names[place[often]] = group[often]
        at = np.sort(place[often])
        at = at[at + size < len(words)]
        at = at[names[at + size] >= 0]
        key = names[at].astype(np.uint64) * np.uint64(len(words)) + names[at + size].astype(np.uint64)
        size *= 2
    period, place, size_of = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((place, period))
    period, place, size_of = period[order], place[order], size_of[order]
    first = np.ones(len(place), dtype=bool)
    first[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    last = np.roll(first, -1) if len(first) else first
    start, period = place[first], period[first]
    length = place[last] + 2 * period + size_of[last] - start
    long = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeated_words(count: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words lie in some run behind its first period."""
    change = np.zeros(count + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def joined_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the given words, joined by one space inside a row."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = data.copy()
    behind = np.flatnonzero(rows[1:] == rows[:-1]) + 1  # white space stands in front of these
    keep[begins[behind] - 1] = True
    out[begins[behind] - 1] = 0x20
    size = ends - begins
    size[behind] += 1
    per_row = np.bincount(rows, weights=size, minlength=count).astype(np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(per_row)])


def _runs(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in slices(batch.column(source)):
                begins, ends, rows = word_spans(data, offsets)
                start, length, period = find_runs(word_hashes(data, begins, ends), rows)
                kept = ~repeated_words(len(rows), start, length, period)
                text, places = joined_words(data, begins[kept], ends[kept], rows[kept], end - begin)
                per_row = np.bincount(rows[start], minlength=end - begin)
                inside = start - np.searchsorted(rows, rows[start])
                parts = [pa.array(x, pa.int64()) for x in (inside, length, period)]
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()),
                    pa.StructArray.from_arrays(parts, ["start", "length", "period"]),
                )
                cleaned = pa.Array.from_buffers(
                    pa.binary(), end - begin, [None, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())]
                )
                own = batch.slice(begin, end - begin)
                yield pa.record_batch([*own.columns, listed, cleaned], [*own.schema.names, "__runs", "__text"])

    return run


def periodic_runs(docs: DataFrame, column: str = "text", out: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each text, by start, then period, and its words without those
    that lie in a run behind its first period, joined by one space.

    Words are runs of bytes other than ASCII white space, case matters, words are numbered from
    0. NULL, empty and white texts have no runs and an empty collapsed text. Rows are independent:
    repeated rows give equal results, an empty table an empty one. Columns named as ``out`` or
    ``collapsed`` are replaced, all others pass unchanged, whatever their names."""
    plain, names = numbered(docs)
    done = plain.mapInArrow(_runs(names[column]), extended(plain, __runs=RUNS, __text="binary"))
    kept = [F.col(c).alias(name) for name, c in names.items() if name not in (out, collapsed)]
    return done.select(*kept, F.col("__runs").alias(out), F.col("__text").cast("string").alias(collapsed))
