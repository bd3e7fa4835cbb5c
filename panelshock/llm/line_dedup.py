"""Removal of runs of lines that occurred before, by winnowing over line hashes.

A line is what stands between newlines, compared without white space of ASCII at its ends;
lines of white space alone do not count. Every later occurrence of a run of at least RUN
consecutive lines, or of at least LONG words, is deleted. Such runs are unions of runs of one
or two lines with LONG words, and of RUN lines. Short lines are winnowed: of each WINDOW
consecutive hashes of GRAM lines the least is a fingerprint, so every run of RUN = GRAM +
WINDOW - 1 lines holds one that depends on the run alone, and a repeated run repeats it. A run
with LONG words is a fingerprint of its own. Only around fingerprints that occur twice are
runs compared; matches that follow each other join to longer ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.llm.keyfilter import key_filter
from panelshock.llm.textbytes import PLACES, WHITE, mix, slices, word_hashes, word_spans
from panelshock.llm.workspace import Workspace

GRAM, WINDOW = 2, 2
RUN = GRAM + WINDOW - 1
LONG = 13
STRIP = bytes(np.flatnonzero(WHITE).astype(np.uint8))
BREAK = np.zeros(256, dtype=bool)
BREAK[0x0A] = True


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each line that is not empty."""
    begins, ends, rows = word_spans(data, offsets, BREAK)
    solid = np.append(np.flatnonzero(~WHITE[data]), len(data))
    first = solid[np.searchsorted(solid, begins)] if len(begins) else begins
    last = solid[np.maximum(np.searchsorted(solid, ends) - 1, 0)] + 1 if len(ends) else ends
    keep = first < ends
    return first[keep], last[keep], rows[keep]


def _grams(lines: np.ndarray, size: int) -> np.ndarray:
    total = max(0, len(lines) - size + 1)
    out = np.zeros(total, dtype=np.uint64)
    for j in range(size):
        out += lines[j : j + total] * PLACES[j]
    return mix(out + PLACES[size + 8])


def _follow(flags: np.ndarray, step: int, rows: np.ndarray) -> np.ndarray:
    """Flags of the places ``step`` further on, False beyond the row."""
    out = np.zeros(len(flags), dtype=bool)
    out[: len(flags) - step] = flags[step:] & (rows[step:] == rows[: len(rows) - step])
    return out


def _runs(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice the first row, and row, first line, lines, hash and fingerprint of each
    run. A run whose lines all lie in shorter runs of LONG words is left out: where it is
    repeated, those are."""
    for begin, _, data, offsets in slices(column):
        b, e, rows = text_lines(data, offsets)
        if not len(rows):
            continue
        starts = word_spans(data, offsets)[0]
        words = np.searchsorted(starts, e) - np.searchsorted(starts, b)
        lines = word_hashes(data, b, e)
        everywhere = np.ones(len(rows), dtype=bool)
        has_two, has_three = _follow(everywhere, 1, rows), _follow(everywhere, 2, rows)
        one = words >= LONG
        two = has_two & (words + np.append(words[1:], 0) >= LONG)
        next_one, next_two = _follow(one, 1, rows), _follow(two, 1, rows)
        in_shorter = (one | two) & (two | next_one | next_two) & (next_two | _follow(one, 2, rows))
        number = np.arange(len(rows)) - np.searchsorted(rows, rows)
        pairs = _grams(lines, GRAM)
        found = []
        for size, wanted in ((1, one), (2, two & ~(one & next_one)), (RUN, has_three & ~in_shorter)):
            at = np.flatnonzero(wanted)
            runs = _grams(lines, size)[at]
            prints = runs
            if size == RUN:
                prints = pairs[at]
                for j in range(1, WINDOW):
                    prints = np.minimum(prints, pairs[at + j])
                prints = mix(prints + PLACES[size + 16])
            found.append((rows[at], number[at], np.full(len(at), size), runs, prints))
        yield begin, *(np.concatenate(c) for c in zip(*found))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with the number of runs it stands for."""
    for batch in batches:
        for *_, prints in _runs(batch.column(0)):
            found, uses = np.unique(prints, return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(uses)], ["print", "uses"])


def _candidates(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, rows, number, sizes, runs, prints in _runs(batch.column(1)):
                keep = wanted.value.holds(prints.view(np.int64))
                ids = batch.column(0).take(pa.array(begin + rows[keep]))
                yield pa.record_batch(
                    [ids, *(pa.array(c[keep].view(np.int64)) for c in (number, sizes, runs, prints))],
                    ["doc_id", "line", "n", "run", "print"],
                )

    return run


def repeated_runs(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, line, n, first_doc_id, first_line) for each run of n lines of
    ``docs(doc_id, text, ...)`` that occurred before: of RUN lines, or fewer with LONG words.
    Lines count from 0, those of white space alone are left out; the first occurrence is the
    least by (doc_id, line).

    Runs may overlap, so a longer repeated passage is many rows; runs whose lines all lie in
    shorter repeated ones have none. NULL and empty texts have no runs. Rows without doc_id are left out; rows with equal
    doc_id are one document and do not repeat each other at the same line. Runs are told
    apart by 64-bit hashes; extra columns are ignored."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    repeated = work.table(
        texts.select("text").mapInArrow(_prints, "print long, uses long").groupBy("print").agg(F.sum("uses").alias("k")).where("k > 1").select("print"),
        "prints",
    )
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(repeated, repeated.count()))
    runs = texts.mapInArrow(_candidates(wanted), "doc_id long, line long, n long, run long, print long")
    runs = work.table(runs.join(repeated, "print", "left_semi").drop("print"), "runs")
    # the least place of each run, in two steps that both fold before the shuffle
    owner = runs.groupBy("run").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    known = work.table(runs.join(owner, "run"), "known")
    first = known.where("doc_id = first_doc_id").groupBy("run").agg(F.min("line").alias("first_line"))
    return (
        known.join(first, "run")
        .where("doc_id != first_doc_id OR line != first_line")
        .select("doc_id", "line", "n", "first_doc_id", "first_line")
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source, gone = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for begin, end, data, offsets in slices(source):
            total = np.bincount(text_lines(data, offsets)[2], minlength=end - begin)
            removed = np.zeros(end - begin, dtype=np.int64)
            texts = []
            for i in range(end - begin):
                text, starts = source[begin + i].as_py(), gone[begin + i].as_py()
                if starts:
                    first, size = np.divmod(np.asarray(starts, dtype=np.int64), RUN + 1)
                    drop = np.zeros(total[i], dtype=bool)
                    for j in range(RUN):
                        drop[first[size > j] + j] = True
                    removed[i] = drop.sum()
                    text = _cut(text, drop)
                texts.append(text)
            own = [c.slice(begin, end - begin) for c in batch.columns[:-2]]
            yield pa.record_batch(
                [*own, pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                [*batch.schema.names[:-2], "__text", "__lines", "__removed"],
            )


def _cut(text: bytes, drop: np.ndarray) -> bytes:
    """A text without the flagged ones of its lines that are not empty; all else stays."""
    kept, line = [], 0
    for raw in text.split(b"\n"):
        solid = bool(raw.strip(STRIP))
        if not (solid and drop[line]):
            kept.append(raw)
        line += solid
    return b"\n".join(kept)


def without_runs(docs: DataFrame, repeated: DataFrame, lines: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """``docs`` with the lines of repeated runs cut out of ``text``, and the numbers of lines
    and of deleted ones. The lines that stay, empty ones among them, stay byte for byte, so a
    text that loses nothing is unchanged; a NULL text stays NULL. Columns of the new names are
    replaced."""
    place = (F.col("line") * (RUN + 1) + F.col("n")).alias("place")
    starts = repeated.select(F.col("doc_id").alias("__id"), place).groupBy("__id").agg(F.collect_set("place").alias("__starts"))
    names = [c for c in docs.columns if c not in ("text", lines, removed)]
    row = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").alias("__key"), F.col("text").cast("binary").alias("__text"))
    joined = row.join(starts, F.col("__key") == F.col("__id"), "left").drop("__key", "__id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "__starts") + ", __lines long, __removed long"
    out = joined.mapInArrow(_kept, kinds)
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("__text").cast("string").alias("text"),
        F.col("__lines").alias(lines), F.col("__removed").alias(removed),
    )
