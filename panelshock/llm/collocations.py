"""Collocated phrases of two to four words, found by Misra-Gries summaries.

Keys are 64-bit hashes of (language, words). Each task counts its keys and sends them, sorted, to
the cells of the key space they fall in; a cell merges what it gets into one Misra-Gries summary
of more than (mass of the cell / threshold) counters. Every merge that overflows subtracts its
(capacity + 1)-th largest count from all, so what a key can have lost stays below the threshold,
and every phrase at least that frequent survives. Words and pairs come first; a phrase of three
or four words enters its summary only if all its pairs survived. A second pass counts the
survivors exactly, as text. The bit filters between the passes have a bounded size and only save
shuffle: whatever passes one wrongly is counted and dropped by its exact count."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.llm.keyfilter import KeyFilter, key_filter
from panelshock.llm.sentencepiece_codec import spread
from panelshock.llm.textbytes import LOWER_VALUES, PLACES, UPPER, mix, slices, word_hashes, word_spans
from panelshock.llm.workspace import Workspace

THRESHOLD, LONGEST, KEPT = 30, 4, 2000
INSIDE_PERCENT, SCALE = 80, 2_000_000
# a summary holds so many times the counters its guarantee needs: fewer false survivors
ROOM = 4
CELL_BYTES, BUFFER_KEYS, BUFFER_PHRASES, CHUNK, SALTS = 16_000_000, 2_000_000, 400_000, 512, 64
NO_LANGUAGE = "und"
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True


@dataclass
class Words:
    """Words of one slice: where they lie, their hashes, and the piece of text each is in."""

    begins: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> Words:
        """``codes`` are the language hashes of the slice's rows."""
        begins, ends, rows = word_spans(data, offsets, SEPARATORS)
        # both terms never fall, so equal sums mean the same row and no break between
        piece = np.cumsum(BREAKS[data])[begins] + rows if len(begins) else rows
        return cls(begins, ends, rows, word_hashes(data, begins, ends, LOWER_VALUES), piece, codes[rows] * PLACES[60])

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and key of every phrase of ``size`` words."""
        count = max(0, len(self.hashes) - size + 1)
        at = np.flatnonzero(self.piece[:count] == self.piece[size - 1 : size - 1 + count])
        key = self.codes[at] + PLACES[32 + size]
        for j in range(size):
            key += self.hashes[at + j] * PLACES[j]
        return at, mix(key)

    def within(self, pairs: KeyFilter, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of ``size`` words all of whose pairs are in the filter."""
        common = np.zeros(len(self.hashes) + LONGEST, dtype=bool)
        first, key = self.phrases(2)
        common[first] = pairs.holds(key)
        at, key = self.phrases(size)
        whole = np.ones(len(at), dtype=bool)
        for j in range(size - 1):
            whole &= common[at + j]
        return at[whole], key[whole]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Words]]:
    """Languages, bytes and words of each slice of batches (language, its hash, text)."""
    for batch in batches:
        codes = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
        for begin, end, data, offsets in slices(batch.column(2)):
            yield batch.column(0).slice(begin, end - begin), data, offsets, Words.of(data, offsets, codes[begin:end])


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def cell_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of the key space a key lies in: its first bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class Summary:
    """A Misra-Gries summary: no count is short by more than ``lost``, which stays below
    mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = [], []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self.capacity + CHUNK:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = counted(np.concatenate(self.keys), np.concatenate(self.counts))
        if len(keys) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            more = counts > least
            keys, counts = keys[more], counts[more] - least
            self.lost += least
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may have reached the threshold."""
        keys, counts = self.fold()
        return keys[counts + self.lost >= threshold]


def _sent(sizes: tuple[int, ...], bits: int, pairs=None):
    """Counted keys of a task, as chunks of cells: (cell, mass, keys, counts)."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(cell_of(keys, bits), np.arange((1 << bits) + 1))
        out = []
        for c in range(1 << bits):
            for a in range(cuts[c], cuts[c + 1], CHUNK):
                b = min(a + CHUNK, cuts[c + 1])
                out.append((c, int(counts[a:b].sum()), keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()))
        for a in range(0, len(out), CHUNK):
            parts = list(zip(*out[a : a + CHUNK]))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(p, k) for p, k in zip(parts, kinds)], ["cell", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for _, _, _, words in _slices(batches):
            for size in sizes:
                key = words.within(pairs.value, size)[1] if pairs else words.phrases(size)[1]
                held.append(key)
                total += len(key)
            if total >= BUFFER_KEYS:
                yield from flush(held)
                held, total = [], 0
        if total:
            yield from flush(held)

    return run


def _merge(threshold: int):
    """Survivors of cells whose chunks come one cell after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, summary = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array(summary.survivors(threshold).view(np.int64), pa.int64())], ["key"])

        for batch in batches:
            for c, keys, counts, mass in zip(*(batch.column(i) for i in range(4))):
                if c.as_py() != cell:
                    if summary is not None:
                        yield done()
                    cell, summary = c.as_py(), Summary(ROOM * mass.as_py() // threshold + 1)
                summary.add(
                    np.frombuffer(keys.as_buffer(), np.uint64).copy(), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
                )
        if summary is not None:
            yield done()

    return run


def _survivors(texts: DataFrame, sizes: tuple[int, ...], bits: int, threshold: int, work: Workspace, name: str, pairs=None) -> KeyFilter:
    sent = texts.mapInArrow(_sent(sizes, bits, pairs), "cell int, mass long, keys binary, counts binary")
    whole = sent.withColumn("mass", F.sum("mass").over(W.partitionBy("cell"))).select("cell", "keys", "counts", "mass")
    keys = work.table(whole.mapInArrow(_merge(threshold), "key long"), name)
    return key_filter(keys, keys.count())


def _text_of(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The slice's words in lower case, one space behind each, and where each begins."""
    size = words.ends - words.begins + 1
    starts = np.cumsum(size) - size
    out = UPPER[data[np.minimum(spread(words.begins, size), len(data) - 1)]]
    out[starts + size - 1] = 0x20
    return out, np.append(starts, len(out))


def _count(filters, bits: int):
    """Counted phrases of a task that pass the filters, as chunks of one cell and language:
    (cell, lang, keys, counts, words, texts), the texts in order, parted by line ends, compressed.
    A phrase of 0 words stands for all word occurrences of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = filters.value
        known, packer = np.zeros(0, np.uint64), zstandard.ZstdCompressor()
        keys, counts, fresh, langs, texts, sizes = [], [], [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            own = np.concatenate(fresh)
            order = np.argsort(own)
            place = np.searchsorted(own, np.concatenate(keys), sorter=order)
            total = np.bincount(order[place], weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)
            lang, text, size = pa.concat_arrays(langs).dictionary_encode(), pa.concat_arrays(texts), np.concatenate(sizes)
            code, cell = lang.indices.to_numpy(), cell_of(own, bits)
            order = np.lexsort((own, code, cell))
            code, cell, out = code[order], cell[order], []
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(code) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(own)]):
                for x in range(begin, end, CHUNK):
                    at = order[x : min(x + CHUNK, end)]
                    listed = sorted(zip(text.take(pa.array(at)).to_pylist(), at.tolist()))
                    at = np.array([i for _, i in listed])
                    joined = packer.compress(b"\n".join(t for t, _ in listed))
                    out.append((
                        int(cell[x]), lang.dictionary[code[x]].as_py(), own[at].tobytes(), total[at].astype(np.uint32).tobytes(),
                        size[at].astype(np.int8).tobytes(), joined,
                    ))
            for part in (keys, counts, fresh, langs, texts, sizes):
                part.clear()
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            for x in range(0, len(out), CHUNK):
                parts = zip(*out[x : x + CHUNK])
                yield pa.record_batch([pa.array(p, k) for p, k in zip(parts, kinds)], ["cell", "lang", "keys", "counts", "words", "texts"])

        def gather(key: np.ndarray, n: np.ndarray, size: int, written) -> None:
            """``written`` gives the languages and texts of the new ones among distinct keys."""
            nonlocal known
            keys.append(key)
            counts.append(n)
            place = np.searchsorted(known, key)
            new = np.ones(len(key), dtype=bool)
            new[place < len(known)] = known[place[place < len(known)]] != key[place < len(known)]
            if new.any():
                lang, text = written(new)
                langs.append(lang)
                texts.append(text)
                sizes.append(np.full(int(new.sum()), size))
                fresh.append(key[new])
                known = np.insert(known, place[new], key[new])

        for lang, data, offsets, words in _slices(batches):
            if not len(words.hashes):
                continue
            text, starts = _text_of(data, words)

            def phrase(at: np.ndarray, size: int):
                length = starts[at + size] - 1 - starts[at] if size else np.zeros(len(at), np.int64)
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                body = text[spread(starts[at], length)].tobytes()
                return lang.take(pa.array(words.rows[at])), pa.Array.from_buffers(
                    pa.binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(body)]
                )

            for size in range(LONGEST + 1):
                if size == 0:
                    at, key = np.arange(len(words.codes)), mix(words.codes)
                else:
                    at, key = words.phrases(size) if size <= 2 else words.within(short, size)
                    passed = (short if size <= 2 else long).holds(key)
                    at, key = at[passed], key[passed]
                if len(key):
                    key, first, n = np.unique(key, return_index=True, return_counts=True)
                    at = at[first]
                    gather(key, n, size, lambda new: phrase(at[new], size))
            if len(known) >= BUFFER_PHRASES or sum(map(len, keys)) >= BUFFER_KEYS:
                yield from flush()
                known = np.zeros(0, np.uint64)
        if fresh:
            yield from flush()

    return run


def _total(threshold: int):
    """Summed counts of cells whose chunks come one cell after the other: phrases that reach
    the threshold, and all of 0 words. A cell's phrases are those its summary let through, so
    their number is bounded by its counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, total, known, unpacker = None, {}, {}, zstandard.ZstdDecompressor()

        def done() -> pa.RecordBatch:
            rows = [(*known[k], n) for k, n in total.items() if n >= threshold or known[k][2] == 0]
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
            parts = zip(*rows) if rows else [()] * 4
            return pa.record_batch([pa.array(p, k) for p, k in zip(parts, kinds)], ["lang", "phrase", "words", "a"])

        for batch in batches:
            for c, lang, keys, counts, words, texts in zip(*(batch.column(i) for i in range(6))):
                if c.as_py() != cell:
                    if cell is not None:
                        yield done()
                    cell, total, known = c.as_py(), {}, {}
                own = np.frombuffer(keys.as_buffer(), np.uint8).view(np.uint64).tolist()
                many = np.frombuffer(counts.as_buffer(), np.uint8).view(np.uint32).tolist()
                name = lang.as_py()
                for k, n, size, text in zip(own, many, words.as_py(), unpacker.decompress(texts.as_py()).split(b"\n")):
                    if k in total:
                        total[k] += n
                    else:
                        total[k], known[k] = n, (name, text, size)
        if cell is not None:
            yield done()

    return run


def frequent_phrases(docs: DataFrame, work: Workspace, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, words, a): the exact count of every phrase of one to four words that
    occurs at least ``threshold`` times in its language, and one row of 0 words per language
    with all its word occurrences. Written once."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("code"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    mass = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.ceil(np.log2(max(1, mass / CELL_BYTES))))
    context = docs.sparkSession.sparkContext
    short = _survivors(texts, (1, 2), bits, threshold, work, "pairs")
    shared = context.broadcast(short)
    long = _survivors(texts, (3, 4), bits, threshold, work, "longer", shared)
    shared.unpersist()
    chunks = texts.mapInArrow(
        _count(context.broadcast((short, long)), bits), "cell int, lang string, keys binary, counts binary, words binary, texts binary"
    )
    dealt = chunks.repartition("cell").sortWithinPartitions("cell")
    exact = dealt.mapInArrow(_total(threshold), "lang string, phrase binary, words int, a long")
    return work.table(exact.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def _cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the cut that scores least, the first of equals."""
    places = F.sequence(F.lit(1), F.col("words") - 1)
    cut = candidates.select("lang", "phrase", "words", "a", F.explode(places).alias("k"))
    front = F.expr("substring_index(phrase, ' ', k)")
    cut = cut.withColumn("front", front).withColumn("back", F.expr("substring(phrase, length(front) + 2)"))
    sides = cut.select(
        "lang", "phrase", "words", "a", F.inline(F.array(
            F.struct((2 * F.col("k")).alias("slot"), F.col("front").alias("part")),
            F.struct((2 * F.col("k") + 1).alias("slot"), F.col("back").alias("part")),
        ))
    )
    part = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("count"))
    met = sides.join(part, ["lang", "part"]).groupBy("lang", "phrase", "words", "a").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("count"))).alias(f"c{s}") for s in range(2, 2 * LONGEST)]
    )
    scored = []
    for k in range(1, LONGEST):
        left, right = f"c{2 * k}", f"c{2 * k + 1}"
        score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0)))")
        one = F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
        scored.append(F.when(F.col(left).isNotNull(), one))
    best = F.array_min(F.filter(F.array(*scored), lambda x: x.isNotNull()))
    return met.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _inside_longer(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the count of the most frequent longer candidate around each."""
    parts = []
    for size in range(3, LONGEST + 1):
        for inner in range(2, size):
            for i in range(1, size - inner + 2):
                listed = F.array_join(F.slice(F.split("phrase", " "), i, inner), " ")
                parts.append(F.when(F.col("words") == size, listed))
    inner = candidates.where("words > 2").select("lang", "a", F.explode(F.array(*parts)).alias("phrase")).where("phrase IS NOT NULL")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame, work: Workspace, threshold: int = THRESHOLD, kept: int = KEPT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``kept`` best phrases of each language.

    A-Z count as a-z, texts end pieces at ``.,;:!?`` and line ends, and words at spaces and tabs;
    a NULL text is empty, a NULL language ``und``, which joins rows that say so. The score is
    that of the worst cut, 2,000,000 a / (l + r) rounded down. A phrase inside a longer one that has
    at least 80 % of its count is dropped. Equal scores rank by count, then by the phrase's bytes.
    Repeated rows count each; extra columns are ignored; a language without a frequent phrase,
    and an empty table, give no rows."""
    counts = frequent_phrases(docs, work, threshold)
    candidates = counts.where("words >= 2")
    longer = _inside_longer(candidates)
    free = candidates.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (100 * _wide("longest") < INSIDE_PERCENT * _wide("a"))
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each share first: no language is ordered in one task
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = _cuts(free.drop("longest"), counts).withColumn("salt", salt)
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= kept)
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= kept)
    total = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
