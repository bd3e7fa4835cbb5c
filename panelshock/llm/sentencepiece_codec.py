"""SentencePiece encoding and decoding with a public vocabulary.

One pass of an Aho-Corasick automaton over a unit's bytes; at each place the output links give
all pieces that end there, and the best score of the place is relaxed from where each begins.
The model file is a merge list, whose scores are ranks; a piece of rank r scores as
log(1 / (r + 1)), normalised, and a byte piece below every other, so that a text takes the
most probable pieces. All distinct units of a slice advance together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshock.llm.textbytes import SLICE_BYTES, row_bytes
from panelshock.llm.vocabulary import DEFAULT_MODEL, AhoCorasick, Vocabulary, lanes, read_vocabulary, units, worker_automaton

CELLS = 400_000
BYTE_SCORE = -30.0


def piece_scores(vocabulary: Vocabulary) -> np.ndarray:
    """Score of each id."""
    rank = np.arange(len(vocabulary)) - vocabulary.first_piece
    weight = np.where(rank >= 0, 1.0 / (np.maximum(rank, 0) + 1.0), 0.0)
    with np.errstate(divide="ignore"):
        return np.where(rank >= 0, np.log(weight / weight.sum()), BYTE_SCORE)


def _automaton(vocabulary: Vocabulary) -> tuple[AhoCorasick, np.ndarray]:
    automaton = worker_automaton(AhoCorasick, vocabulary)
    return automaton, piece_scores(vocabulary)[automaton.piece]


def best_pieces(automaton: AhoCorasick, scores: np.ndarray, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of each unit, flat, and their numbers. Of equal scores the
    longer last piece wins."""
    count = np.zeros(len(begins), dtype=np.int64)
    found = []
    for take, running in lanes(lengths, CELLS):
        width = len(running) + 1
        best = np.full((len(take), width), -np.inf)
        back = np.zeros((len(take), width), dtype=np.int32)
        best[:, 0] = 0.0
        state = np.zeros(len(take), dtype=np.int64)
        for i, live in enumerate(running):
            state = automaton.step[state[:live], text[begins[take[:live]] + i]].astype(np.int64)
            out, who = automaton.longest[state], np.arange(live)
            while len(who):
                score = best[who, i + 1 - automaton.depth[out]] + scores[out]
                better = score > best[who, i + 1]
                best[who[better], i + 1] = score[better]
                back[who[better], i + 1] = out[better]
                out = automaton.shorter[out]
                more = out > 0
                who, out = who[more], out[more]
        place, who = lengths[take].copy(), np.arange(len(take))
        while len(who):
            out = back[who, place[who]]
            found.append((take[who], automaton.piece[out]))
            count[take[who]] += 1
            place[who] -= automaton.depth[out]
            who = who[place[who] > 0]
    starts = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(int(starts[-1]), dtype=np.int32)
    left = starts[1:].copy()
    for who, pieces in found:  # from the last piece of a unit to its first
        left[who] -= 1
        ids[left[who]] = pieces
    return ids, count


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: ``counts[i]`` places from ``starts[i]`` on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _encode(vocabulary, source: str, check: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, scores = _automaton(vocabulary.value)
        for batch in batches:
            for begin, end, text, begins, lengths, unit, rows in units(batch.column(source)):
                ids, count = best_pieces(automaton, scores, text, begins, lengths)
                starts = np.cumsum(count) - count
                per_unit = count[unit]
                flat = ids[spread(starts[unit], per_unit)]
                per_row = np.bincount(rows, weights=per_unit, minlength=end - begin).astype(np.int64)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), pa.array(flat, pa.int32())
                )
                own = batch.slice(begin, end - begin)
                columns, names = [*own.columns, listed], [*own.schema.names, "__ids"]
                if check:
                    back, ends = decoded_bytes(vocabulary.value, flat, per_row)
                    columns.append(_same_rows(own.column(source), back, ends))
                    names.append("__same")
                yield pa.record_batch(columns, names)

    return run


def encode(docs: DataFrame, column: str = "text", out: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` with the ids of its texts, array<int>, in column ``out``.

    NULL and empty texts have no pieces. Every other text is exactly its pieces' bytes with a
    space in front. A column of that name is replaced; equal texts get equal ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    plain, names = numbered(docs)
    ids = plain.mapInArrow(_encode(vocabulary, names[column]), extended(plain, __ids="array<int>"))
    return ids.select(*[F.col(c).alias(name) for name, c in names.items() if name != out], F.col("__ids").alias(out))


def encode_checked(
    docs: DataFrame, column: str = "text", out: str = "piece_ids", check: str = "round_trip", model: str = DEFAULT_MODEL
) -> DataFrame:
    """``encode`` with a further column: whether the ids decode to the text again, where a NULL
    text decodes to the empty one. Both ways run in one worker, slice by slice."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    plain, names = numbered(docs)
    ids = plain.mapInArrow(_encode(vocabulary, names[column], True), extended(plain, __ids="array<int>", __same="boolean"))
    kept = [F.col(c).alias(name) for name, c in names.items() if name not in (out, check)]
    return ids.select(*kept, F.col("__ids").alias(out), F.col("__same").alias(check))


def _same_rows(source: pa.Array, back: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Whether each text's bytes are those decoded."""
    data, offsets = row_bytes(source)
    if len(data) == len(back) and np.array_equal(offsets, ends) and np.array_equal(data, back):
        return pa.array(np.ones(len(offsets) - 1, dtype=bool))
    return pa.array([np.array_equal(data[a:b], back[c:d]) for a, b, c, d in zip(offsets, offsets[1:], ends, ends[1:])], pa.bool_())


def decoded_bytes(vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of consecutive runs of ids, ``sizes`` ids each; the space
    in front of each text does not belong to it."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    lengths = vocabulary.lengths
    shift = np.zeros(len(ids), dtype=np.int64)
    heads = upto[:-1][sizes > 0]
    shift[heads] = (lengths[ids[heads]] > 0).astype(np.int64)
    taken = lengths[ids] - shift
    data = np.frombuffer(vocabulary.joined, dtype=np.uint8)[spread((np.cumsum(lengths) - lengths)[ids] + shift, taken)]
    return data, np.concatenate([[0], np.cumsum(taken)])[upto]


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under private names, so that no name of the caller's can clash."""
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.select(*[F.col(f"`{name}`").alias(c) for name, c in names.items()]), names


def extended(df: DataFrame, **columns: str) -> str:
    """The schema of a table with further columns behind it, as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {c} {t}" for c, t in columns.items())


def _decode(vocabulary, source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(source)
            sizes = np.asarray(listed.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(listed.flatten())
            upto = np.concatenate([[0], np.cumsum(sizes)])
            done = 0
            while done < len(sizes):
                last = max(done + 1, int(np.searchsorted(upto, upto[done] + SLICE_BYTES // 4, side="right")) - 1)
                data, ends = decoded_bytes(vocabulary.value, flat[upto[done] : upto[last]], sizes[done:last])
                text = pa.Array.from_buffers(
                    pa.binary(), last - done, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
                )
                own = batch.slice(done, last - done)
                yield pa.record_batch([*own.columns, text], [*own.schema.names, "__text"])
                done = last

    return run


def decode(encoded: DataFrame, column: str = "piece_ids", out: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with the texts of its ids in column ``out``: the exact inverse of ``encode``.
    No ids give the empty text; ids of control pieces stand for nothing."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    plain, names = numbered(encoded)
    text = plain.mapInArrow(_decode(vocabulary, names[column]), extended(plain, __text="binary"))
    return text.select(*[F.col(c).alias(name) for name, c in names.items() if name != out], F.col("__text").cast("string").alias(out))
