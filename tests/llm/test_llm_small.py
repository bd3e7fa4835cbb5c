"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables; results
against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from panelshock.llm import (
    decontaminate, digest_index, jaccard_join, language_id, line_dedup, masked_lm, paragraph_dedup, quality,
    sentencepiece_codec, textbytes, vocabulary, wordpiece_counts,
)
from panelshock.llm.components import connected
from panelshock.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, score double, digest string, `a.b` int, place int, component string"


def rows_of(texts, start=0):
    return [(start + i, t, "en", 0.5, "x", 1, 2, "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(5)
    syllables = ["ka", "to", "mi", "re", "su", "no", "lé", "ß", "X"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    base = [word() for _ in range(120)]
    near = [" ".join(w if draw.random() > 0.02 else word() for w in base) for _ in range(25)]
    passage = " ".join(word() for _ in range(60))
    host = [" ".join(word() for _ in range(40)) for _ in range(4)]
    inside = [f"{h} {passage} {g}" for h, g in zip(host[:2], host[2:])]
    return [
        None, "", "  \t\n ", "one", "One", "two words", "12345 !!! 999", "ab\x00c d", "▁ x▁ y", "日本語 テスト です", "é" * 3000,
        "word " * 4000, "x" * 20000, "a b c d e", "A  B\tC d E\n", "a b c d e", "l1\nl2\nl3\nl4", "l0\nl2\nl3\nl4\nl9", "l2\nl3\nl4",
        " ".join(base), *near, *inside, passage,
    ]


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    return spark.createDataFrame(rows_of(odd_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_slices_of_long_texts(monkeypatch):
    monkeypatch.setattr(textbytes, "SLICE_BYTES", 50)
    texts = ["a bb " * 40, "", None, "ccc", "d" * 200 + " e"]
    words = []
    for begin, end, data, offsets in textbytes.slices(pa.array(texts).slice(0)):
        b, e, rows = textbytes.word_spans(data, offsets)
        hashes = textbytes.word_hashes(data, b, e)
        words += [(begin + r, bytes(data[x:y]).decode(), h) for r, x, y, h in zip(rows, b, e, hashes)]
    assert [(r, w) for r, w, _ in words] == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    assert len({(w, h) for _, w, h in words}) == len({w for _, w, _ in words}) == len({h for _, _, h in words})


def test_components(spark):
    draw = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 40)] + [(7, 7), (None, 3)]
    pairs += [tuple(sorted(draw.sample(range(200, 260), 2))) for _ in range(40)]
    root = {n: n for p in pairs for n in p if n is not None}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    linked = {n for a, b in pairs if a is not None and a != b for n in (a, b)}
    out = connected(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t"), "c").collect()
    assert {r["node"]: r["component"] for r in out} == {n: find(n) for n in linked} and len(out) == len(linked)
    assert connected(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t"), "c").count() == 0


def test_jaccard_join(spark, docs, odd_texts, nothing):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(docs, Workspace(spark, "t")).collect()}
    assert out == brute.similarity_components(dict(enumerate(odd_texts)))
    assert jaccard_join.similarity_classes(nothing, Workspace(spark, "t")).count() == 0


def test_jaccard_join_of_chains_and_many_near_copies(spark):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for i in range(160):  # mostly unlike each other, tied through the base and through chains
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = f"v{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    for step in range(30):  # a chain whose ends share nothing
        texts.append(" ".join(f"c{k}" for k in range(step * 3, step * 3 + 40)))
    docs = spark.createDataFrame(rows_of(texts, 1000), SCHEMA)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(docs, Workspace(spark, "t")).collect()}
    assert out == brute.similarity_components({1000 + i: t for i, t in enumerate(texts)})


def test_jaccard_join_of_odd_ids(spark):
    rows = [(None, "a b c d e f", *[None] * 6), (4, "a b c d e f", *[None] * 6), (2, "q r s t u", *[None] * 6), (2, "a b c d e f", *[None] * 6), (9, "q r s t u", *[None] * 6)]
    out = jaccard_join.similarity_classes(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "t")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out if r["doc_id"]) == [(2, 2), (2, 2), (4, 2), (9, 2)]
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]


def test_exact_dedup_against_an_index(spark, nothing):
    work = Workspace(spark, "t")
    index = digest_index.new_index(work)
    first = [(5, "a b", *[None] * 6), (3, "ab", *[None] * 6), (4, " a\tb", *[None] * 6), (8, None, *[None] * 6), (7, "", *[None] * 6), (1, "z", *[None] * 6), (1, "z", *[None] * 6), (None, "z", *[None] * 6), (None, "y", *[None] * 6)]
    rows = work.table(digest_index.tagged(spark.createDataFrame(first, SCHEMA)), "first")
    out = digest_index.deduplicate(rows, index, Workspace(spark, "t")).collect()
    by = sorted(((r["__id"], r["keep_id"], r["group_size"], r["kept"], r["digest"]) for r in out), key=str)
    ab, empty, z, y = (brute.digest(t) for t in ("ab", "", "z", "y"))
    assert by == sorted(
        [(5, 4, 3, False, ab), (3, 4, 3, False, ab), (4, 4, 3, True, ab), (8, 7, 2, False, empty), (7, 7, 2, True, empty), (1, 1, 3, True, z), (1, 1, 3, False, z), (None, 1, 3, False, z), (None, None, 1, True, y)],
        key=str,
    )
    assert index.table().count() == 4
    second = work.table(digest_index.tagged(spark.createDataFrame([(50, "a b ", *[None] * 6), (51, "new", *[None] * 6)], SCHEMA)), "second")
    again = {r["__id"]: (r["keep_id"], r["kept"]) for r in digest_index.deduplicate(second, index, Workspace(spark, "t")).collect()}
    assert again == {50: (4, False), 51: (51, True)} and index.table().count() == 5
    assert digest_index.drop_copies(nothing, Workspace(spark, "t")).count() == 0
    kept = digest_index.drop_copies(spark.createDataFrame(first, SCHEMA), Workspace(spark, "t"))
    assert kept.columns == nothing.columns and sorted(kept.select("doc_id").collect(), key=str) == sorted([(4,), (7,), (1,), (None,)], key=str)
    plan = index.lacking(index.table().select("digest"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, docs, odd_texts, nothing, short):
    passage = odd_texts[-1].split()
    items = [(1, " ".join(passage[5:40])), (2, " ".join(passage[30:43])), (3, None), (4, "!!"), (5, " ".join(passage[5:40])), (1, "word word word " * 6)]
    items += [(6, "two words"), (7, "d"), (None, "l2 l3 l4"), (8, " ".join(passage[50:58]))] * short
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    out = decontaminate.contamination(docs, bench, Workspace(spark, "t")).orderBy("doc_id").collect()
    expected = brute.contamination(odd_texts, items)
    assert [(r["n_words"], r["n_hit"], r["item_ids"]) for r in out] == expected
    assert [r["contaminated"] for r in out] == [h > 0 and 20 * h >= n for n, h, _ in expected]
    if short:
        assert decontaminate.contamination(docs, bench.limit(0), Workspace(spark, "t")).where("n_hit > 0").count() == 0
        assert decontaminate.contamination(nothing, bench, Workspace(spark, "t")).count() == 0
        twice = decontaminate.contamination(docs.union(docs), bench, Workspace(spark, "t"))
        assert twice.count() == 2 * len(expected) and twice.where("contaminated").count() == 2 * sum(r["contaminated"] for r in out)


def test_codec_and_token_counts(spark, docs, odd_texts, nothing):
    vocab = vocabulary.read_vocabulary()
    entries, scores, surface = dict(vocab.entries), sentencepiece_codec.piece_scores(vocab), vocab.surface
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).orderBy("doc_id").collect()
    tokens = wordpiece_counts.token_counts(docs).orderBy("doc_id").collect()
    for text, c, t in zip(odd_texts, coded, tokens):
        assert c["decoded"] == (text or "") and c["score"] == 0.5
        assert b"".join(surface[i] for i in c["piece_ids"]) == (b" " + text.encode() if text else b"")
        parts = brute.unit_bytes(text)
        assert t["n_units"] == len(parts)
        if len(text or "") < 2000:
            assert t["n_tokens"] == sum(brute.greedy(u, entries) for u in parts)
            assert sum(scores[i] for i in c["piece_ids"]) == pytest.approx(sum(brute.best_score(u, entries, scores) for u in parts))
    checked = sentencepiece_codec.encode_checked(docs).orderBy("doc_id").collect()
    assert all(c["round_trip"] for c in checked) and [c["piece_ids"] for c in checked] == [c["piece_ids"] for c in coded]
    data, ends = sentencepiece_codec.decoded_bytes(vocab, np.array(coded[3]["piece_ids"]), np.array([len(coded[3]["piece_ids"])]))
    wrong = sentencepiece_codec._same_rows(pa.array(["One", ""]), data, np.array([*ends, ends[-1]]))
    assert wrong.to_pylist() == [False, True]
    assert sentencepiece_codec.encode(nothing).count() == 0 and wordpiece_counts.token_counts(nothing).count() == 0


def test_language_model_sums_all_segmentations(spark, nothing):
    vocab = vocabulary.read_vocabulary()
    automaton, entries = vocabulary.AhoCorasick(vocab), dict(vocab.entries)
    share = np.random.default_rng(2).random((len(vocab), 3)) * 1e-3
    parts = [b" the", b" interesting", b" " + "éß日".encode(), b" x" * 3, b"  ", b" " + b"ab" * 60]
    text = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    found = language_id.log_probabilities(automaton, share, text, np.cumsum(lengths) - lengths, lengths)
    for k in range(3):
        assert found[:, k] == pytest.approx([np.log(brute.summed(p, entries, share[:, k])) for p in parts])
    weight, tongue = np.array([2.0, 3.0, 1.0, 1.0, 5.0, 0.0]), np.array([0, 1, 2, 0, 1, 1])
    uses = language_id.expected_counts(automaton, share, text, np.cumsum(lengths) - lengths, lengths, tongue, weight)
    size = np.array([len(s) for s in vocab.surface])
    # expected pieces of a unit cover its bytes exactly
    assert (uses * size[:, None]).sum(axis=0) == pytest.approx([weight[tongue == k] @ lengths[tongue == k] for k in range(3)])
    rows = [(i, "the cat and the dog were there" if i % 2 else "der hund und die katze waren dort", "en" if i % 2 else "de", *[None] * 5) for i in range(60)]
    rows += [(100, None, "en", *[None] * 5), (101, "123 !", "en", *[None] * 5), (102, "", None, *[None] * 5), (None, "the dog", "en", *[None] * 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs, Workspace(spark, "t"))
    out = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language_id.predict(docs, model).collect()}
    assert all((i, "en" if i % 2 else "de") in out for i in range(60)) and (None, "en") in out
    assert [out[i, "und"] for i in (100, 101, 102)] == [0.0] * 3 and all(0 <= s <= 1 for s in out.values())
    empty = language_id.train(nothing, Workspace(spark, "t"))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_quality_needs_text_only(spark, docs, nothing):
    good = ["The river ran slowly past the old mill, and nobody spoke of it again."] * 40
    bad = ["$$$ BUY %%% NOW %%% $$$ !!! WIN WIN WIN"] * 40
    rows = [(i, t, str(i), *[None] * 5) for i, t in enumerate([*good, *bad])]
    train_docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(0, None), (999, 1), (3, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in quality.score(train_docs, labels, Workspace(spark, "t")).collect()}
    assert len(out) == 80 and min(out[i] for i in range(40)) > 0.8 and max(out[i] for i in range(40, 80)) < 0.2
    assert len({out[i] for i in range(40)}) == 1
    odd = quality.score(docs, labels.limit(0), Workspace(spark, "t")).collect()
    assert {r["score"] for r in odd} == {0.5} and len(odd) == docs.count()
    assert quality.score(nothing, labels, Workspace(spark, "t")).count() == 0


def test_additive_model_learns_a_pair():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0) ^ (x[:, 5] > 0)).astype(float)  # no feature alone tells anything
    model = quality.fit(x, y)
    assert (2, 5) in {(i, j) for i, j, _ in model.pairs}
    assert ((model.scores(x) >= 0.5) == (y == 1)).mean() > 0.9


def _without_repeats(texts):
    """Text, lines and removed lines of each text, by trying every run of one to three lines."""
    seen, expected = set(), []
    for text in texts:
        raws = (text or "").split("\n")
        solid = [i for i, raw in enumerate(raws) if raw.strip(" \t\n\x0b\x0c\r")]
        own = [raws[i].strip(" \t\n\x0b\x0c\r") for i in solid]
        gone = set()
        for size in (1, 2, 3):
            for i in range(len(own) - size + 1):
                run = tuple(own[i : i + size])
                if size == 3 or sum(len(brute.white_words(s)) for s in run) >= 13:
                    gone |= set(range(i, i + size)) if run in seen else set()
                    seen.add(run)
        cut = {solid[i] for i in gone}
        expected.append((None if text is None else "\n".join(r for i, r in enumerate(raws) if i not in cut), len(own), len(gone)))
    return expected


def test_line_runs(spark, docs, odd_texts, nothing):
    expected = _without_repeats(odd_texts)
    found = line_dedup.repeated_runs(docs, Workspace(spark, "t"))
    out = line_dedup.without_runs(docs, found).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in out] == expected and sum(e[2] for e in expected) >= 6
    assert line_dedup.repeated_runs(nothing, Workspace(spark, "t")).count() == 0


def test_line_runs_by_words_and_layout(spark):
    long, half, other = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("p", 60), ("h", 7), ("k", 6)))
    code = "def f():\n\n    return 1\n\t# end \n"
    texts = [
        f"intro\n{long}\nbody\n", code, f"new head\n  {long}\t\n\n  indented tail", long, f"{half}\n{other}", f"x y\n{half}\n \n{other}\nrest",
        f"{half}\nno repeat of two", "a\nb\nc", " a\n b\n\n c\nd", "a\nb", "z\nz\nz\nz\nz", f"{long}\n{long}", f"{half}\n{long}\n{half}", f"q\n{half}\n{long}\n{half}\nr",
    ]
    draw = np.random.default_rng(5)
    pool = [half, other, long, "a", "b b", "  c", "", "\t"]
    texts += ["\n".join(pool[i] for i in draw.integers(0, len(pool), draw.integers(0, 9))) for _ in range(120)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    out = line_dedup.without_runs(table, line_dedup.repeated_runs(table, Workspace(spark, "t"))).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in out] == _without_repeats(texts)
    assert out[1]["text"] == code and out[2]["text"] == "new head\n\n  indented tail" and out[3]["text"] == ""
    assert out[5]["text"] == "x y\n \nrest" and out[6]["n_removed"] == 0 and out[8]["text"] == "\nd" and out[9]["n_removed"] == 0


def test_paragraphs(spark, docs, odd_texts, nothing):
    found = paragraph_dedup.repeated_paragraphs(docs, Workspace(spark, "t"))
    rows = found.collect()
    passage = len(odd_texts) - 1
    assert {(r["doc_id"], r["keep_doc_id"]) for r in rows if r["removed"] and r["doc_id"] >= passage - 2} == {(passage - 1, passage - 2), (passage, passage - 2)}
    for r in rows:  # a member is like some other member of its class
        own = odd_texts[r["doc_id"]].encode()[r["first_byte"] : r["last_byte"]].decode()
        others = [odd_texts[q["doc_id"]].encode()[q["first_byte"] : q["last_byte"]].decode() for q in rows if q["class_id"] == r["class_id"] and q is not r]
        mine = brute.shingles(own)
        assert any(100 * len(mine & brute.shingles(o)) >= 80 * len(mine | brute.shingles(o)) for o in others), (r, others[:3])
        assert r["removed"] <= ((r["keep_doc_id"], r["keep_number"]) < (r["doc_id"], r["number"]))
    cleaned = {r["doc_id"]: r["text"] for r in paragraph_dedup.without_repeats(docs, found).collect()}
    clean = [i for i in range(len(odd_texts)) if i not in {r["doc_id"] for r in rows if r["removed"]}]
    assert all(cleaned[i] == odd_texts[i] for i in clean) and len(cleaned[passage]) < len(odd_texts[passage]) / 2
    assert paragraph_dedup.repeated_paragraphs(nothing, Workspace(spark, "t")).count() == 0


def test_near_copies_inside_other_text(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    texts, planted = [], []
    for size, changes in ((51, 0), (60, 1), (100, 2), (200, 4)):
        for _ in range(12):
            passage = words(size)
            copy = list(passage)
            for k in range(changes):
                copy[(k + 1) * size // (changes + 1)] = word()
            before, after = words(40), words(40)
            planted.append((len(texts) + 1, len(" ".join(before)) + 1, " ".join(copy)))
            texts += [" ".join(words(30) + passage + words(30)), " ".join(before + copy + after)]
    table = spark.createDataFrame(rows_of(texts), SCHEMA)
    found = paragraph_dedup.repeated_paragraphs(table, Workspace(spark, "t")).where("removed").collect()
    assert {r["doc_id"] for r in found} <= {i for i, _, _ in planted}
    for i, begin, copy in planted:
        gone = set()
        for r in found:
            if r["doc_id"] == i:
                gone |= set(range(r["first_byte"], r["last_byte"]))
        assert gone == set(range(begin, begin + len(copy))), (i, begin, len(copy), len(gone))


def test_masked_model(spark, docs, odd_texts, nothing):
    model = masked_lm.train(docs, Workspace(spark, "t"))
    out = {r["doc_id"]: r for r in masked_lm.score(docs, model).collect()}
    for i, text in enumerate(odd_texts):
        words = brute.white_words(text)
        assert out[i]["n_tokens"] == len(words) and (out[i]["log_prob"] < 0) == bool(words)
    # shares in a class sum to one over all words and one never seen
    table, rows = model.table, model.counts.collect()
    words = np.array([r["word"] for r in rows]).view(np.uint64)
    classes = table.classes(words, np.array([r["suffix"] for r in rows]))
    shares = np.exp(np.log([r["uses"] for r in rows]) - table.log_total[classes])
    assert np.bincount(classes, weights=shares, minlength=masked_lm.CLASSES) + np.exp(-table.log_total) == pytest.approx(1.0)
    assert np.exp(table.unigram).sum() == pytest.approx(1.0)
    assert masked_lm.score(nothing, masked_lm.train(nothing, Workspace(spark, "t"))).count() == 0


def test_masked_scores_by_hand(spark, docs, odd_texts, monkeypatch):
    """Every word counts with its own share, hot or not."""
    wide = masked_lm.train(docs, Workspace(spark, "t"))
    monkeypatch.setattr(masked_lm, "HOT_WORDS", 90)
    (table, counts), texts = masked_lm.word_table(docs, Workspace(spark, "t")), ["", None, "never seen words", "a never", *odd_texts, *odd_texts]
    assert len(table.hot) == 90 < counts.where("uses > 1").count()
    uses = Counter(w.encode() for t in odd_texts for w in brute.white_words(t))
    assert sorted(uses.values()) == sorted(r["uses"] for r in counts.collect())
    few = masked_lm.MaskedModel(table, wide.weights, counts)
    asked = spark.createDataFrame([(7, t, i) for i, t in enumerate(texts)], "doc_id long, text string, word int").repartition(3)
    found = [sorted(tuple(r) for r in masked_lm.score(asked, m).collect()) for m in (wide, few)]
    assert [r[1] for r in found[0]] == [r[1] for r in found[1]] and np.allclose(found[0], found[1], rtol=0, atol=1e-6)
    expected = []
    for text in texts:
        own = [w.encode() for w in brute.white_words(text)]
        column = pa.array([text], pa.string())
        for _, _, words, suffix, rows in masked_lm.tokens(column):
            classes = table.classes(words, suffix)
            chance = masked_lm.class_log_probabilities(wide.weights, masked_lm.contexts(classes, rows), classes)
            share = [np.log(max(1, uses[w])) for w in own] - table.log_total[classes]
            expected.append((7, len(own), float((chance + share).sum()), float((chance + share).sum() / max(1, len(own)))))
    assert np.allclose(found[1], sorted(expected), rtol=0, atol=1e-4)


@pytest.mark.parametrize("count", [0, 1, 7, 5000])
def test_every_token_is_taught_once(count):
    taught = np.concatenate([masked_lm.targets(count, turn) for turn in range(masked_lm.ROUNDS)])
    assert sorted(taught) == list(range(count))


def test_network_learns_both_sides():
    draw = np.random.default_rng(1)
    classes = draw.integers(0, 6, 60_000)
    classes[2::4] = np.maximum(classes[1::4], classes[3::4])  # told by both neighbours
    rows = np.zeros(len(classes), dtype=np.int64)
    around = masked_lm.contexts(classes, rows)
    learner = masked_lm.Learner(masked_lm.initial_weights())
    for turn in range(20):
        for part in np.array_split(draw.permutation(np.arange(2, len(classes), 4)), 8):
            learner.step(around[:, part], classes[part])
    some = np.arange(2, len(classes), 4)
    found = masked_lm.class_log_probabilities(learner.flat, around[:, some], classes[some])
    assert found.mean() > -0.5
    full = np.exp([masked_lm.class_log_probabilities(learner.flat, around[:, :1], np.array([k]))[0] for k in range(masked_lm.CLASSES)])
    assert full.sum() == pytest.approx(1.0, abs=1e-4)
