"""Language identification by unigram piece models with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a unit of text is the sum over all ways to cut it into pieces, by the forward algorithm
over the automaton's matches; a text's is the product over its units. Models are learned by
expectation maximisation over the counted units of a bounded sample of labelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshock.llm.sentencepiece_codec import extended, numbered, piece_scores
from panelshock.llm.vocabulary import DEFAULT_MODEL, AhoCorasick, Vocabulary, lanes, read_vocabulary, units, worker_automaton
from panelshock.llm.workspace import Workspace, id_remainder

UNDETERMINED = "und"
SAMPLE_PER_LANGUAGE = 4000
ROUNDS = 3
BACKGROUND = 2000.0
LONGEST_TAUGHT = 40
CELLS = 400_000


def _automaton(vocabulary: Vocabulary) -> AhoCorasick:
    return worker_automaton(AhoCorasick, vocabulary)


def log_probabilities(automaton: AhoCorasick, model: np.ndarray, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log-probability of each unit under each language; ``model`` has a row per id."""
    languages = model.shape[1]
    by_state = model[automaton.piece]  # rows of states without a piece are never read
    ring = int(automaton.depth.max()) + 1
    out = np.zeros((len(begins), languages))
    for take, running in lanes(lengths, CELLS, width=ring * languages):
        reach = np.zeros((len(take), ring, languages))
        reach[:, 0] = 1.0
        scale = np.zeros((len(take), languages))
        state = np.zeros(len(take), dtype=np.int64)
        size = lengths[take]
        for i, live in enumerate(running):
            state = automaton.step[state[:live], text[begins[take[:live]] + i]].astype(np.int64)
            total = np.zeros((live, languages))
            node, who = automaton.longest[state], np.arange(live)
            while len(who):
                total[who] += reach[who, (i + 1 - automaton.depth[node]) % ring] * by_state[node]
                node = automaton.shorter[node]
                more = node > 0
                who, node = who[more], node[more]
            reach[:live, (i + 1) % ring] = total
            if i % 8 == 7:  # keep the numbers in range
                np.maximum(total, 1e-280, out=total)
                reach[:live] /= total[:, None, :]
                scale[:live] += np.log(total)
                total = np.ones_like(total)
            done = np.searchsorted(-size[:live], -(i + 1))
            if done < live:
                out[take[done:live]] = np.log(np.maximum(total[done:], 1e-280)) + scale[done:live]
    return out


def expected_counts(automaton: AhoCorasick, model: np.ndarray, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, language: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each id by language over all segmentations of weighted units."""
    out = np.zeros(model.shape)
    by_state = model[automaton.piece]
    for take, running in lanes(lengths, CELLS):
        width, tongue = len(running) + 1, language[take]
        forward, back = np.zeros((len(take), width)), np.zeros((len(take), width))
        forward[:, 0] = 1.0
        state, edges = np.zeros(len(take), dtype=np.int64), []
        for i, live in enumerate(running):
            state = automaton.step[state[:live], text[begins[take[:live]] + i]].astype(np.int64)
            node, who = automaton.longest[state], np.arange(live)
            while len(who):
                forward[who, i + 1] += forward[who, i + 1 - automaton.depth[node]] * by_state[node, tongue[who]]
                edges.append((i + 1, who, node))
                node = automaton.shorter[node]
                more = node > 0
                who, node = who[more], node[more]
        size = lengths[take]
        rows = np.arange(len(take))
        total = forward[rows, size]
        back[rows, size] = np.where(total > 0, weight[take] / np.maximum(total, 1e-300), 0.0)
        for end, who, node in reversed(edges):
            begin = end - automaton.depth[node]
            through = by_state[node, tongue[who]] * back[who, end]
            np.add.at(out, (automaton.piece[node], tongue[who]), forward[who, begin] * through)
            back[who, begin] += through
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Probabilities by id and language, log priors and the sorted languages."""

    languages: tuple[str, ...]
    pieces: np.ndarray
    priors: np.ndarray


def taught_parts(unit: bytes) -> list[bytes]:
    """A unit in parts of at most LONGEST_TAUGHT bytes, cut between characters: languages
    written without spaces teach their sentences this way."""
    out, begin = [], 0
    while len(unit) - begin > LONGEST_TAUGHT:
        end = begin + LONGEST_TAUGHT
        while end > begin + 1 and unit[end] & 0xC0 == 0x80:
            end -= 1
        out.append(unit[begin:end])
        begin = end
    return [*out, unit[begin:]]


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tongue = np.asarray(batch.column(0))
        for begin, end, text, begins, lengths, unit, rows in units(batch.column(1)):
            pairs, counts = np.unique(np.stack([tongue[begin:end][rows], unit], axis=1), axis=0, return_counts=True)
            parts = [taught_parts(bytes(text[begins[u] : begins[u] + lengths[u]])) for u in pairs[:, 1]]
            many = [len(p) for p in parts]
            found = [part for p in parts for part in p]
            yield pa.record_batch(
                [pa.array(np.repeat(pairs[:, 0], many), pa.int32()), pa.array(found, pa.binary()), pa.array(np.repeat(counts, many), pa.int64())],
                ["language", "unit", "uses"],
            )


def _expect(vocabulary, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, total = _automaton(vocabulary.value), np.zeros(model.shape)
        for batch in batches:
            found = batch.column(1).to_pylist()
            lengths = np.array([len(u) for u in found], dtype=np.int64)
            text = np.frombuffer(b"".join(found), dtype=np.uint8)
            begins = np.cumsum(lengths) - lengths
            total += expected_counts(
                automaton, model, text, begins, lengths, np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(2)).astype(float)
            )
        piece, language = np.nonzero(total)
        yield pa.record_batch(
            [pa.array(piece, pa.int32()), pa.array(language, pa.int32()), pa.array(total[piece, language])], ["piece", "language", "uses"]
        )

    return run


def _smoothed(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Each language's shares, drawn to the pooled ones, which are drawn to the prior."""
    pooled = (counts.sum(axis=1) + BACKGROUND * prior) / (counts.sum() + BACKGROUND)
    return (counts + BACKGROUND * pooled[:, None]) / (counts.sum(axis=0) + BACKGROUND)


def train(docs: DataFrame, work: Workspace, per_language: int = SAMPLE_PER_LANGUAGE, model: str = DEFAULT_MODEL) -> LanguageModel:
    """Learn from ``text`` and non-NULL ``lang`` of the rows whose crc32 of doc_id modulo 4 is
    not 2. The sample holds about ``per_language`` texts of each language, chosen by a hash of
    the id; units above 40 bytes are taught in parts. Rows without id or text are left out."""
    spark = docs.sparkSession
    spread_vocabulary = spark.sparkContext.broadcast(read_vocabulary(model))
    vocabulary = spread_vocabulary.value
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", 4) != 2))
    known = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(known))
    prior = np.exp(piece_scores(vocabulary))
    prior[: vocabulary.first_piece] = np.where(vocabulary.lengths[: vocabulary.first_piece] > 0, 1e-7, 0.0)
    prior /= prior.sum()
    if not languages:
        return LanguageModel((), prior[:, None][:, :0], np.zeros(0))
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, per_language / known[name]))) for name in languages])
    place = F.coalesce(*[F.when(F.col("lang") == name, F.lit(i)) for i, name in enumerate(languages)])
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(lot < share).select(place.cast("int").alias("language"), F.col("text").cast("binary").alias("text"))
    lexicon = sample.mapInArrow(_units_of, "language int, unit binary, uses long").groupBy("language", "unit").agg(F.sum("uses").alias("uses"))
    lexicon = work.table(lexicon, "lexicon")
    pieces = np.repeat(prior[:, None], len(languages), axis=1)
    for _ in range(ROUNDS):
        uses = lexicon.mapInArrow(_expect(spread_vocabulary, pieces), "piece int, language int, uses double")
        counts = np.zeros(pieces.shape)
        for row in uses.groupBy("piece", "language").agg(F.sum("uses").alias("uses")).orderBy("piece", "language").collect():
            counts[row["piece"], row["language"]] = row["uses"]
        pieces = _smoothed(counts, prior)
    work.drop("lexicon")
    total = sum(known.values())
    return LanguageModel(languages, pieces, np.log(np.array([known[name] / total for name in languages])))


def _predict(vocabulary, model, source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, learned = _automaton(vocabulary.value), model.value
        for batch in batches:
            letters = np.asarray(batch.column("__letters").fill_null(False), dtype=bool)
            for begin, end, text, begins, lengths, unit, rows in units(batch.column(source)):
                by_unit = log_probabilities(automaton, learned.pieces, text, begins, lengths)
                total = np.repeat(learned.priors[None, :], end - begin, axis=0)
                for k in range(len(learned.languages)):
                    total[:, k] += np.bincount(rows, weights=by_unit[unit, k], minlength=end - begin)
                best = total.argmax(axis=1)
                share = 1.0 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
                real = letters[begin:end]
                named = [learned.languages[b] if r else UNDETERMINED for b, r in zip(best, real)]
                own = batch.slice(begin, end - begin)
                yield pa.record_batch(
                    [*own.columns, pa.array(named, pa.string()), pa.array(np.where(real, share, 0.0))], [*own.schema.names, "__lang", "__score"]
                )

    return run


def predict(docs: DataFrame, model: LanguageModel, path: str = DEFAULT_MODEL, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with a predicted language and its posterior probability, from ``text`` alone.

    NULL texts and texts without a letter are ``und`` with score 0; ties go to the first
    language in order. Without any learned language every text is ``und``. Columns of the
    names of the results are replaced."""
    plain, columns = numbered(docs)
    own = [F.col(c).alias(name) for name, c in columns.items() if name not in names]
    if not model.languages:
        return plain.select(*own, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]))
    context = docs.sparkSession.sparkContext
    vocabulary, spread_model = context.broadcast(read_vocabulary(path)), context.broadcast(model)
    source = columns["text"]
    marked = plain.withColumn("__letters", F.coalesce(F.col(source).rlike(r"\p{L}"), F.lit(False)))
    found = marked.mapInArrow(
        _predict(vocabulary, spread_model, source), extended(marked, __lang="string", __score="double")
    )
    return found.select(*own, F.col("__lang").alias(names[0]), F.col("__score").alias(names[1]))


def held_out() -> Column:
    return F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
