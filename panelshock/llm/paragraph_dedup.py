"""Removal of passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph is a line, and long lines are cut by content: before each word whose bigram hash is
the least within ``RADIUS`` words on both sides. Paragraphs with equal sets of 5-word shingles
are one; others meet where one of BANDS minima agrees, are verified by exact Jaccard, and
clustered. Of each cluster the first occurrence stays; later ones go.

Passages that were copied into other lines share no paragraph. Of each ANCHOR_WINDOW hashes of
ANCHOR_WORDS words the least is an anchor, so any 13 words in common hold one. An anchor that
repeats is matched to its first occurrence and extended both ways, over changed words too, to
the span in common, which is verified by exact Jaccard like a paragraph.

One minimum a band finds a pair of similarity 0.8 with probability 1 - 0.2^5 = 0.9997. Band keys
and anchors that occur once never leave the scan, groups are linked through hubs first, and
only pairs across components are compared further."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.llm.components import connected
from panelshock.llm.jaccard_join import similar_sets
from panelshock.llm.keyfilter import key_filter
from panelshock.llm.textbytes import LOWER_VALUES, PLACES, SMALL_SLICE, mix, row_bytes, shingle_hashes, slices, stream, word_hashes, word_spans
from panelshock.llm.workspace import Workspace, in_small_batches

SHINGLE_WORDS, PERCENT = 5, 80
RADIUS, LEAST_WORDS, SPAN_WORDS = 30, 7, 14
BANDS = 5
ANCHOR_WORDS, ANCHOR_WINDOW = 8, 6
#: words around a chain of anchors, also the most between two of one chain; words that end a change
MARGIN, AGREE = 40, 3
SEEDS = stream(11, BANDS)

UNITS = "doc_id long, number int, n_words int, first_byte long, last_byte long, s1 long, n int, bits long, keys array<long>"
SPANS = (
    "doc_id long, number int, n_words int, first_byte long, last_byte long, "
    "keep_doc_id long, keep_number int, keep_words int, keep_first_byte long, keep_last_byte long"
)

PIECE = (
    "doc_id long, word int, byte long, piece binary, keep_doc_id long, keep_low int, keep_high int, "
    "anchors array<struct<place:int,keep_place:int>>"
)


def paragraph_starts(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a paragraph begins at each word; ``rows`` are lines."""
    n = len(words)
    pair = words.copy()
    pair[:-1] += words[1:] * np.uint64(3)
    pair = mix(pair)
    least = np.ones(n, dtype=bool)
    for shift in range(1, min(RADIUS, n - 1) + 1 if n else 0):
        near = rows[shift:] == rows[:-shift]
        least[shift:] &= ~near | (pair[shift:] < pair[:-shift])
        least[:-shift] &= ~near | (pair[:-shift] <= pair[shift:])
    if n:
        least[0] = True
        least[1:] |= rows[1:] != rows[:-1]
    return least


def _cut(column) -> Iterator[tuple]:
    """For each slice: first row, paragraph row, first word, words, byte range, and shingle hashes
    with the paragraph they belong to. Paragraphs below LEAST_WORDS have no shingles."""
    for begin, end, data, offsets in slices(column, SMALL_SLICE):
        begins, ends, rows = word_spans(data, offsets)
        hashes = word_hashes(data, begins, ends, LOWER_VALUES)
        breaks = np.cumsum(data == 0x0A)[begins] if len(begins) else begins
        starts = np.flatnonzero(paragraph_starts(hashes, rows + breaks))
        stops = np.append(starts[1:], len(rows))[: len(starts)]
        paragraph = np.repeat(np.arange(len(starts)), stops - starts)
        owner = rows[starts]
        number = starts - np.searchsorted(rows, owner)
        long_enough = (stops - starts) >= LEAST_WORDS
        kept = long_enough[paragraph]
        shingles, of = shingle_hashes(hashes[kept], paragraph[kept], len(starts), SHINGLE_WORDS)
        low = offsets[owner]
        yield begin, end, owner, number, stops - starts, begins[starts] - low, ends[stops - 1] - low, shingles, of


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paragraphs in ``of`` with the place of their first shingle."""
    new = np.append(True, of[1:] != of[:-1])
    places = np.flatnonzero(new)
    return of[places], places


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs with the digest, size and bitmap of their shingle set and their band keys."""
    for batch in batches:
        for begin, end, owner, number, words, low, high, shingles, of in _cut(batch.column(1)):
            if not len(shingles):
                continue
            order = np.lexsort((shingles, of))
            shingles, of = shingles[order], of[order]
            first = np.append(True, (of[1:] != of[:-1]) | (shingles[1:] != shingles[:-1]))
            shingles, of = shingles[first], of[first]
            unit, places = _runs(of)
            mixed = mix(shingles)
            digest = np.add.reduceat(mixed, places)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (mixed >> np.uint64(58)), places)
            sizes = np.diff(np.append(places, len(of)))
            keys = np.stack([mix(np.minimum.reduceat(mix(shingles ^ seed), places) + seed) for seed in SEEDS], axis=1)
            ids = batch.column(0).slice(begin, end - begin).take(pa.array(owner[unit]))
            yield pa.record_batch(
                [
                    ids, pa.array(number[unit], pa.int32()), pa.array(words[unit], pa.int32()), pa.array(low[unit], pa.int64()),
                    pa.array(high[unit], pa.int64()), pa.array(digest.view(np.int64)),
                    pa.array(sizes, pa.int32()), pa.array(bits.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                ],
                ["doc_id", "number", "n_words", "first_byte", "last_byte", "s1", "n", "bits", "keys"],
            )


def _banded(wanted):
    """(key, s1, n, bits) of the band keys that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("keys").flatten())
            keep = wanted.value.holds(keys)
            own = [pa.array(np.repeat(np.asarray(batch.column(c)), BANDS)[keep]) for c in ("s1", "n", "bits")]
            yield pa.record_batch([pa.array(keys[keep]), *own], ["key", "s1", "n", "bits"])

    return run


def _may_agree(x: str, y: str) -> Column:
    """Whether two sets can reach the similarity, from their sizes and bitmaps of 64 bits. A bit
    that differs takes a shingle that only one set has, and a similar pair has at most
    (100 - PERCENT) of (100 + PERCENT) of both sizes of them: every similar pair passes."""
    both, apart = F.col(f"{x}n") + F.col(f"{y}n"), F.bit_count(F.col(f"{x}bits").bitwiseXOR(F.col(f"{y}bits")))
    near = 100 * F.least(f"{x}n", f"{y}n") >= PERCENT * F.greatest(f"{x}n", f"{y}n")
    return near & ((100 + PERCENT) * apart <= (100 - PERCENT) * both)


def _sets(wanted):
    """Shingle sets of the paragraphs whose digest the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, shingles, of in _cut(batch.column(1)):
                if not len(shingles):
                    continue
                order = np.lexsort((shingles, of))
                shingles, of = shingles[order], of[order]
                first = np.append(True, (of[1:] != of[:-1]) | (shingles[1:] != shingles[:-1]))
                shingles, of = shingles[first], of[first]
                _, places = _runs(of)
                digest = np.add.reduceat(mix(shingles), places).view(np.int64)
                stops = np.append(places[1:], len(of))
                keep = np.flatnonzero(wanted.value.holds(digest))
                yield pa.record_batch(
                    [pa.array(digest[keep]), pa.array([shingles[places[k] : stops[k]].tobytes() for k in keep], pa.binary())],
                    ["s1", "members"],
                )

    return run


def _links(texts: DataFrame, pairs: DataFrame, work: Workspace, label: str) -> DataFrame:
    ends = work.table(pairs.select(F.col("a").alias("s1")).unionByName(pairs.select(F.col("b").alias("s1"))).distinct(), f"{label}-ends")
    wanted = texts.sparkSession.sparkContext.broadcast(key_filter(ends, ends.count()))
    found = texts.mapInArrow(_sets(wanted), "s1 long, members binary")
    # equal sets are one: any copy will do
    sets = work.table(found.join(ends, "s1", "left_semi").groupBy("s1").agg(F.min("members").alias("members")), f"{label}-sets")
    both = (
        pairs.join(sets.select(F.col("s1").alias("a"), F.col("members").alias("left_set")), "a")
        .join(sets.select(F.col("s1").alias("b"), F.col("members").alias("right_set")), "b")
        .select("a", "b", "left_set", "right_set")
    )
    out = work.table(both.mapInArrow(similar_sets(PERCENT), "a long, b long").distinct(), f"{label}-links")
    work.drop(f"{label}-sets", f"{label}-ends")
    return out


def _anchor_places(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice the first row, and row, word place and key of each anchor."""
    span = ANCHOR_WORDS + ANCHOR_WINDOW - 1
    for begin, _, data, offsets in slices(column, SMALL_SLICE):
        begins, ends, rows = word_spans(data, offsets)
        words = word_hashes(data, begins, ends, LOWER_VALUES)
        total = len(words) - span + 1
        if total <= 0:
            continue
        grams = np.zeros(len(words) - ANCHOR_WORDS + 1, dtype=np.uint64)
        for j in range(ANCHOR_WORDS):
            grams += words[j : j + len(grams)] * PLACES[j]
        grams = mix(grams + PLACES[ANCHOR_WORDS])
        least, place = grams[:total].copy(), np.arange(total)
        for j in range(1, ANCHOR_WINDOW):
            lower = grams[j : j + total] < least
            least[lower] = grams[j : j + total][lower]
            place[lower] = np.flatnonzero(lower) + j
        place = np.unique(place[rows[:total] == rows[span - 1 :]])
        yield begin, rows[place], place - np.searchsorted(rows, rows[place]), grams[place].view(np.int64)


def _anchor_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, keys in _anchor_places(batch.column(0)):
            found, uses = np.unique(keys, return_counts=True)
            yield pa.record_batch([pa.array(found), pa.array(uses)], ["key", "uses"])


def _anchor_hits(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, rows, place, keys in _anchor_places(batch.column(1)):
                keep = wanted.value.holds(keys)
                ids = batch.column(0).take(pa.array(begin + rows[keep]))
                yield pa.record_batch([ids, pa.array(place[keep], pa.int32()), pa.array(keys[keep])], ["doc_id", "place", "key"])

    return run


def _holding(wanted, held: bool = True):
    """Rows whose first column the filter holds, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.holds(np.asarray(batch.column(0))) == held))

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text MARGIN words around each wanted range of words, with the word and the byte it
    begins at: of a text's own chains with what they are matched to, of a text kept by its range."""
    for batch in batches:
        owns, spans = batch.column("owns"), batch.column("spans")
        own, kept, found = owns.flatten(), spans.flatten(), []
        cuts = [np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(x).fill_null(0)))]) for x in (owns, spans)]
        lows = [np.asarray(x.field(c)) for x, c in ((own, "own_low"), (kept, "low"))]
        highs = [np.asarray(x.field(c)) for x, c in ((own, "own_high"), (kept, "high"))]
        size = 0
        for i in range(batch.num_rows):
            data, offsets = row_bytes(batch.column("text").slice(i, 1))
            begins, ends, _ = word_spans(data, offsets)
            for side in range(2):
                for k in range(int(cuts[side][i]), int(cuts[side][i + 1])):
                    low, high = max(0, int(lows[side][k]) - MARGIN), min(len(begins), int(highs[side][k]) + MARGIN)
                    if low < high:
                        found.append((side, i, k, low, int(begins[low]), data[begins[low] : ends[high - 1]].tobytes()))
                        size += len(found[-1][-1])
            if found and (size >= SMALL_SLICE or i == batch.num_rows - 1):
                yield from _piece_rows(batch.column("doc_id"), own, kept, found)
                found, size = [], 0
        if found:
            yield from _piece_rows(batch.column("doc_id"), own, kept, found)


def _piece_rows(ids: pa.Array, own: pa.Array, kept: pa.Array, found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of PIECE; those of texts kept have no doc_id."""
    for side in range(2):
        rows = [x[1:] for x in found if x[0] == side]
        if not rows:
            continue
        row, place, word, byte, piece = zip(*rows)
        doc, place = ids.take(pa.array(row)), pa.array(place)
        text = [pa.array(word, pa.int32()), pa.array(byte, pa.int64()), pa.array(piece, pa.binary())]
        if side == 0:
            columns = [doc, *text, *[own.field(c).take(place) for c in ("keep_doc_id", "keep_low", "keep_high", "anchors")]]
        else:
            none = [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), own.field("anchors").type)]
            columns = [none[0], *text, doc, *[kept.field(c).take(place) for c in ("low", "high")], none[1]]
        yield pa.record_batch(columns, ["doc_id", "word", "byte", "piece", "keep_doc_id", "keep_low", "keep_high", "anchors"])


def _resume(a: list, b: list) -> tuple[int, int, int]:
    """Words of a and b to skip until they agree again, and for how long they agree; the words
    in agreement are at least AGREE and as many as are skipped."""
    own, other = (list(zip(*(w[k : MARGIN + k + 1] for k in range(AGREE)))) for w in (a, b))
    if set(other).isdisjoint(own):
        return 0, 0, 0
    known: dict[tuple, int] = {}
    for t, words in enumerate(other):
        known.setdefault(words, t)
    best = None
    for s, words in enumerate(own):
        if best and s >= best[0] + best[1]:
            break
        t = known.get(words)
        if t is not None and (best is None or s + t < best[0] + best[1]):
            run = AGREE + _agreeing(a, s + AGREE, b, t + AGREE)
            if run >= max(s, t):
                best = (s, t, run)
    return best or (0, 0, 0)


def _agreeing(a: list, i: int, b: list, j: int, step: int = 32) -> int:
    """Words from a[i] and b[j] on that are equal, compared ``step`` at a time."""
    n = 0
    while True:
        x, y = a[i + n : i + n + step], b[j + n : j + n + step]
        if x != y or len(x) < step:
            return n + next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        n += step


def _walk(a: list, b: list) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the stretches that agree, from the start of both on."""
    i = j = _agreeing(a, 0, b, 0)
    found = [(0, 0, i)]
    while True:
        s, t, run = _resume(a[i : i + 3 * MARGIN], b[j : j + 3 * MARGIN])
        if not run:
            return found
        i, j = i + s, j + t
        run = _agreeing(a, i, b, j)
        found.append((i, j, run))
        i, j = i + run, j + run


def _shingles(words: np.ndarray) -> np.ndarray:
    """The shingle that begins at each word but the last ones."""
    return shingle_hashes(words, np.zeros(len(words), np.int64), 1, SHINGLE_WORDS)[0]


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets of these shingles agree by Jaccard."""
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def shared_spans(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of a and b, of at least SPAN_WORDS words, that agree by Jaccard around anchors
    (place in a, place in b). A stretch that does not agree as a whole is divided at its widest
    change."""
    x, y, out, upto, sets = a.tolist(), b.tolist(), [], 0, []

    def divide(runs):
        i0, j0, (i1, j1) = runs[0][0], runs[0][1], (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2])
        if min(i1 - i0, j1 - j0) < SPAN_WORDS:
            return
        if len(runs) > 1 and not sets:
            sets.extend((_shingles(a), _shingles(b)))
        last = SHINGLE_WORDS - 1
        if len(runs) == 1 or _similar(sets[0][i0 : i1 - last], sets[1][j0 : j1 - last]):
            out.append((i0, i1, j0, j1))
            return
        middle = (i0 + i1) / 2
        gap = [max(n[0] - p[0] - p[2], n[1] - p[1] - p[2]) for p, n in zip(runs, runs[1:])]
        at = max(range(len(gap)), key=lambda k: (gap[k], -abs(runs[k + 1][0] - middle))) + 1
        divide(runs[:at])
        divide(runs[at:])

    for i, j in anchors:
        if i < upto or x[i : i + ANCHOR_WORDS] != y[j : j + ANCHOR_WORDS]:
            continue
        left = [(i - p - n, j - q - n, n) for p, q, n in _walk(x[:i][::-1], y[:j][::-1]) if n][::-1]
        right = [(i + p, j + q, n) for p, q, n in _walk(x[i:], y[j:])]
        if left and left[-1][0] + left[-1][2] == i and left[-1][1] + left[-1][2] == j:
            p, q, n = left.pop()
            right[0] = (p, q, n + right[0][2])
        upto = right[-1][0] + right[-1][2]
        divide(left + right)
    return out


def _piece_words(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, ...]:
    """Hashes and byte places of the words of all pieces of a side, and where each piece begins."""
    data, offsets = row_bytes(batch.column(f"{side}_piece"))
    begins, ends, rows = word_spans(data, offsets)
    move = (np.asarray(batch.column(f"{side}_byte")) - offsets[:-1])[rows]
    return word_hashes(data, begins, ends, LOWER_VALUES), begins + move, ends + move, np.searchsorted(rows, np.arange(batch.num_rows + 1))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of two pieces that agree: places of words and bytes in both documents."""
    names = ["doc_id", "keep_doc_id", "own_word", "keep_word"]
    for whole in batches:
        out = []
        for batch in (whole.slice(begin, end - begin) for begin, end, *_ in slices(whole.column("own_piece"), SMALL_SLICE)):
            own_words, own_begins, own_ends, own_cuts = _piece_words(batch, "own")
            keep_words, keep_begins, keep_ends, keep_cuts = _piece_words(batch, "keep")
            lists, places = batch.column("anchors"), batch.column("anchors").flatten()
            own_places, keep_places = (np.asarray(places.field(i)).tolist() for i in range(2))
            ends = np.cumsum(np.asarray(pc.list_value_length(lists))).tolist()
            for k, r in enumerate(batch.select(names).to_pylist()):
                x, y, mine = int(own_cuts[k]), int(keep_cuts[k]), slice(ends[k - 1] if k else 0, ends[k])
                anchors = sorted((p - r["own_word"], q - r["keep_word"]) for p, q in zip(own_places[mine], keep_places[mine]))
                for i0, i1, j0, j1 in shared_spans(own_words[x : own_cuts[k + 1]], keep_words[y : keep_cuts[k + 1]], anchors):
                    own, keep = i0 + r["own_word"], j0 + r["keep_word"]
                    if (r["keep_doc_id"], keep) < (r["doc_id"], own):
                        place = (own, i1 - i0, own_begins[x + i0], own_ends[x + i1 - 1])
                        out.append((r["doc_id"], *place, r["keep_doc_id"], keep, j1 - j0, keep_begins[y + j0], keep_ends[y + j1 - 1]))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds * 2)], [f.split()[0] for f in SPANS.split(", ")])


def shared_with_earlier(texts: DataFrame, work: Workspace) -> DataFrame:
    """Spans of ``texts(doc_id, text)`` that agree with an earlier span, and that one."""
    context = texts.sparkSession.sparkContext
    uses = texts.select("text").mapInArrow(_anchor_uses, "key long, uses long")
    repeated = work.table(uses.groupBy("key").agg(F.sum("uses").alias("k")).where("k > 1").select("key"), "anchors")
    wanted = context.broadcast(key_filter(repeated, repeated.count()))
    hits = texts.mapInArrow(_anchor_hits(wanted), "doc_id long, place int, key long")
    hits = work.table(hits.join(repeated, "key", "left_semi").distinct(), "hits")
    first = hits.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    # what returns at once, like one word over and over, is matched to its last occurrence only
    before = F.lag("place").over(W.partitionBy("key", "doc_id").orderBy("place"))
    hits = hits.withColumn("before", before)
    again = hits.where("before IS NOT NULL").select(
        "doc_id", "place", F.col("doc_id").alias("keep_doc_id"), F.col("before").alias("keep_place"), F.lit(True).alias("again")
    )
    met = (
        hits.where(F.col("before").isNull() | (F.col("place") - F.col("before") > ANCHOR_WORDS))
        .join(first, "key")
        .where("doc_id != first.doc_id OR place != first.place AND (before IS NULL OR before != first.place)")
        .select("doc_id", "place", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.place").alias("keep_place"), F.lit(False).alias("again"))
        .unionByName(again)
    )
    # a text that repeats itself meets its first occurrence and its last one, in chains of their
    # own: in one, neighbours would jump between both, and a chain's range hold all that lies between
    order = W.partitionBy("doc_id", "keep_doc_id", "again").orderBy("place", "keep_place")
    step, keep_step = F.col("place") - F.lag("place").over(order), F.col("keep_place") - F.lag("keep_place").over(order)
    starts = F.when((step <= MARGIN) & (keep_step > 0) & (keep_step <= MARGIN), 0).otherwise(1)
    chains = (
        met.withColumn("starts", starts)
        .withColumn("chain", F.sum("starts").over(order))
        .groupBy("doc_id", "keep_doc_id", "again", "chain")
        .agg(
            F.min("place").alias("own_low"), (F.max("place") + ANCHOR_WORDS).alias("own_high"), F.min("keep_place").alias("keep_low"),
            (F.max("keep_place") + ANCHOR_WORDS).alias("keep_high"), F.collect_list(F.struct("place", "keep_place")).alias("anchors"),
        )
        .drop("again", "chain")
    )
    chains = work.table(chains, "chains")
    work.drop("hits", "anchors")
    work.forget_shuffles()
    # a text has no more chains of its own than anchors; those that it is kept for count by range
    owns = chains.groupBy("doc_id").agg(
        F.collect_list(F.struct("own_low", "own_high", "keep_doc_id", "keep_low", "keep_high", "anchors")).alias("owns")
    )
    spans = chains.groupBy(F.col("keep_doc_id").alias("doc_id")).agg(
        F.collect_set(F.struct(F.col("keep_low").alias("low"), F.col("keep_high").alias("high"))).alias("spans")
    )
    ranges = work.table(owns.join(spans, "doc_id", "full"), "ranges")
    work.drop("chains")
    work.forget_shuffles()
    ids = ranges.select("doc_id")
    holding = context.broadcast(key_filter(ids, ids.count()))
    found = texts.mapInArrow(_holding(holding), "doc_id long, text binary").join(ranges, "doc_id").select("doc_id", "text", "owns", "spans")
    pieces = work.table(found.mapInArrow(_pieces, PIECE), "pieces")
    work.drop("ranges", "texts")
    work.forget_shuffles()

    def side(name: str, rows: Column, *columns: str) -> DataFrame:
        own = [F.col(c).alias(f"{name}_{c}") for c in ("word", "byte", "piece")]
        return pieces.where(rows).select("keep_doc_id", "keep_low", "keep_high", *columns, *own)

    both = side("own", F.col("doc_id").isNotNull(), "doc_id", "anchors").join(
        side("keep", F.col("doc_id").isNull()), ["keep_doc_id", "keep_low", "keep_high"]
    )
    spans = work.table(both.mapInArrow(_extended, SPANS), "spans")
    work.drop("pieces")
    return spans.distinct()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The span from the first word of a copy to its last, which is the same in the text kept."""
    for batch in batches:
        out = []
        for begin, end, data, offsets in slices(batch.column("text")):
            begins, ends, rows = word_spans(data, offsets)
            cuts = np.searchsorted(rows, np.arange(end - begin + 1))
            for i in np.flatnonzero(np.diff(cuts) >= SPAN_WORDS):
                first, last = int(cuts[i]), int(cuts[i + 1])
                span = (0, last - first, int(begins[first] - offsets[i]), int(ends[last - 1] - offsets[i]))
                own, keep = batch.column("doc_id")[int(begin + i)].as_py(), batch.column("keep_doc_id")[int(begin + i)].as_py()
                out.append((own, *span, keep, *span))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds * 2)], [f.split()[0] for f in SPANS.split(", ")])


def _folded(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """One row per different text, of the least doc_id that has it, and the whole spans of its
    copies in other documents. Copies are found by digest before anything is compared; texts that
    occur once stay in their partitions."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = texts.select(F.xxhash64("text").alias("key"), "doc_id", "text")
    digest = F.sha2("text", 256).alias("digest")
    owners = texts.select("key", digest, "doc_id").groupBy("digest", "key").agg(F.min("doc_id").alias("keep_doc_id"), F.count(F.lit(1)).alias("k"))
    owners = work.table(owners.where("k > 1").drop("k"), "owners")
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(owners.select("key"), owners.count()))
    kind = "key long, doc_id long, text binary"
    met = texts.mapInArrow(_holding(wanted), kind).select("doc_id", "text", digest).join(owners.drop("key"), "digest", "left")
    met = work.table(met, "met-texts")
    once = texts.mapInArrow(_holding(wanted, False), kind).select("doc_id", "text")
    alone = met.where("keep_doc_id IS NULL").select("doc_id", "text")
    # of rows that share the kept doc_id and the text one is enough
    kept = met.where("doc_id = keep_doc_id").groupBy("digest", "doc_id").agg(F.any_value("text").alias("text")).select("doc_id", "text")
    copies = met.where("doc_id != keep_doc_id").select("doc_id", "keep_doc_id", "text").mapInArrow(_whole, SPANS)
    copies, folded = work.table(copies.distinct(), "copies"), work.table(once.unionByName(alone).unionByName(kept), "texts")
    work.drop("met-texts", "owners")
    work.forget_shuffles()
    return folded, copies


@in_small_batches
def repeated_paragraphs(docs: DataFrame, work: Workspace) -> DataFrame:
    """The repeated passages of ``docs(doc_id, text, ...)`` and the ones that stay for them:
    (doc_id, number, n_words, first_byte, last_byte, class_id, keep_doc_id, keep_number, removed).

    A passage is a paragraph, a span around anchors, or a whole text that an earlier document
    has as well; such copies are compared with nothing else. Passages may overlap.
    number is the place of its first word, from 0, the bytes are UTF-8 places in the text.
    class_id names a cluster of paragraphs linked by 100 * |A and B| >= 80 * |A or B|, whose
    first one by (doc_id, number) stays, or an earlier span with the later ones that agree with
    it likewise; words of an earlier span may be removed themselves for one still earlier.
    removed marks later passages of at least SPAN_WORDS words; shorter ones stay and have no
    row, nor have clusters of nothing else. NULL, empty and short texts repeat nothing. Rows
    without doc_id are left out; rows with equal doc_id are one document, which does not repeat
    itself at the same place. Extra columns are ignored."""
    texts, copies = _folded(docs, work)
    units = work.table(texts.mapInArrow(_units, UNITS), "units")
    spark = docs.sparkSession

    repeated = work.table(
        units.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "keys"
    )
    wanted = spark.sparkContext.broadcast(key_filter(repeated, repeated.count()))
    banded = units.select("s1", "n", "bits", "keys").mapInArrow(_banded(wanted), "key long, s1 long, n int, bits long")
    # equal paragraphs count once per band
    banded = work.table(banded.join(repeated, "key", "left_semi").distinct(), "banded")
    hubs = (
        banded.groupBy("key")
        .agg(F.min("s1").alias("hub"), *[F.min_by(c, "s1").alias(f"hub_{c}") for c in ("n", "bits")], F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        .drop("k")
    )
    met = work.table(banded.join(hubs, "key"), "met")
    pairs = work.table(met.where("s1 != hub").where(_may_agree("", "hub_")).select(F.col("hub").alias("a"), F.col("s1").alias("b")).distinct(), "hub-pairs")
    found = _links(texts, pairs, work, "hub")
    groups = connected(found, work, "hub-components")
    placed = work.table(
        met.join(groups.withColumnRenamed("node", "s1"), "s1", "left").select("key", "s1", "n", "bits", "hub", F.coalesce("component", "s1").alias("component")),
        "placed",
    )
    cores = (
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("s1") == F.col("hub"), F.col("component"))).alias("core"))
        .where("low != high")
        .select("key", "core")
    )
    rest = work.table(placed.drop("hub").join(cores, "key"), "open")
    x = rest.where("component != core").select("key", "core", F.col("s1").alias("x"), F.col("component").alias("x_in"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits"))
    y = rest.select("key", F.col("s1").alias("y"), F.col("component").alias("y_in"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits"))
    across = (
        x.join(y, "key")
        .where("x_in != y_in AND (y_in = core OR x < y)")
        .where(_may_agree("x_", "y_"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    across = work.table(across, "cross-pairs")
    links = found.unionByName(_links(texts, across, work, "cross"))
    classes = connected(links, work, "components")

    # paragraphs alone with their set and unlinked drop out before the classes are looked up
    seen = units.groupBy("s1").agg(F.count(F.lit(1)).alias("k"))
    shared = work.table(
        seen.join(classes.withColumnRenamed("node", "s1"), "s1", "left")
        .where("k > 1 OR component IS NOT NULL")
        .select("s1", F.coalesce("component", "s1").alias("class_id")),
        "shared",
    )
    members = work.table(units.drop("keys", "n", "bits").join(shared, "s1").drop("s1"), "members")
    # the place of an occurrence in (doc_id, number) order; equal places are ties of repeated rows
    first = members.groupBy("class_id").agg(F.min("doc_id").alias("keep_doc_id"))
    first = (
        members.join(first, "class_id").where("doc_id = keep_doc_id").groupBy("class_id", "keep_doc_id").agg(F.min("number").alias("keep_number"))
    )
    later = members.join(first, "class_id").withColumn("later", (F.col("doc_id") != F.col("keep_doc_id")) | (F.col("number") != F.col("keep_number")))
    columns = ["doc_id", "number", "n_words", "first_byte", "last_byte", "class_id", "keep_doc_id", "keep_number", "removed"]
    marked = work.table(later.withColumn("removed", F.col("later") & (F.col("n_words") >= SPAN_WORDS)).select(*columns, "later"), "marked")
    # short ones that stay on both sides are no repeats
    touched = marked.where("removed").select("class_id").distinct()
    paragraphs = marked.where("removed OR NOT later").join(touched, "class_id", "left_semi").select(*columns)
    work.drop("units", "keys", "banded", "met", "hub-pairs", "placed", "open", "cross-pairs", "shared", "members")
    work.forget_shuffles()
    spans = shared_with_earlier(texts, work).unionByName(copies).withColumn(
        "class_id", F.xxhash64("keep_doc_id", "keep_number", "keep_words", "keep_first_byte", "keep_last_byte")
    )
    kept = spans.select(
        F.col("keep_doc_id").alias("doc_id"), F.col("keep_number").alias("number"), F.col("keep_words").alias("n_words"),
        F.col("keep_first_byte").alias("first_byte"), F.col("keep_last_byte").alias("last_byte"), "class_id", "keep_doc_id", "keep_number",
        F.lit(False).alias("removed"),
    ).distinct()
    return paragraphs.unionByName(spans.withColumn("removed", F.lit(True)).select(*columns)).unionByName(kept)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()):
            if text is not None and spans:
                parts, done = [], 0
                for low, high in sorted((s["first_byte"], s["last_byte"]) for s in spans):
                    parts.append(text[done : max(done, low)])
                    done = max(done, high)
                text = b"".join([*parts, text[done:]])
            out.append(text)
        yield pa.record_batch([*batch.columns[:-2], pa.array(out, pa.binary())], [*batch.schema.names[:-2], "__text"])


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the removed paragraphs of ``found`` cut out of the texts."""
    spans = found.where("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("first_byte", "last_byte")).alias("__spans"))
    joined = docs.join(spans, docs["doc_id"] == spans["__id"], "left").drop("__id")
    names = [c for c in docs.columns if c != "text"]
    plain = joined.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").cast("binary").alias("__text"), "__spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "__spans")
    out = plain.mapInArrow(_cut_out, kinds)
    return out.select(*[(F.col("__text").cast("string") if c == "text" else F.col(f"c{names.index(c)}")).alias(c) for c in docs.columns])
