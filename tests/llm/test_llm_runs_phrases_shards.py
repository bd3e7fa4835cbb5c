"""Periodic runs, collocations and shards: odd input, ties, skew, and plain Python results."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelshock.llm import collocations, periodic_runs, sharding
from panelshock.llm.queries import with_periods
from panelshock.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, runs int, collapsed string, shard string, slot double, n int, `a.b` int"
ODD = [
    None, "", " \t\n ", "one", "a b c d e", "a b a b a b", "a b a b a b a b", "A a A a A a A a A a", "x x x x x", "x x x x x x", "x " * 5000,
    "p q r " * 4 + "p z", "pre " + "u v u v u v u v w " * 4, "日本 語 " * 6, "tail\x00 " * 7, "é" * 30000, "a a a a a a b b b b b b a a a a a a",
    "one two. one two! one two; one two", "over the moon\tover  the moon\nover the moon", "l.m l.m l.m",
]


def rows_of(texts, start=0, lang="en"):
    return [(start + i, t, lang, 1, "c", "s", 0.5, 3, 4) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(ODD), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_hand(w):
    found = {}
    for q in range(len(w) // 4, 0, -1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found[i, j - i + q] = q  # smaller periods come later
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_by_hand(w):
    gone = {i for s, n, q in runs_by_hand(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_odd_texts(docs, nothing):
    out = periodic_runs.periodic_runs(docs)
    assert out.columns == [c for c in docs.columns if c not in ("runs", "collapsed")] + ["runs", "collapsed"]
    for r in out.collect():
        w = split_words(ODD[r["doc_id"]])
        assert ([tuple(x) for x in r["runs"]], r["collapsed"]) == (sorted(runs_by_hand(w), key=lambda x: (x[0], x[2])), collapsed_by_hand(w))
        assert (r["text"], r["slot"], r["a.b"]) == (ODD[r["doc_id"]], 0.5, 4)
    assert periodic_runs.periodic_runs(nothing).count() == 0


def test_runs_of_random_words():
    draw = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 4)):
            w = []
            for _ in range(draw.randint(0, 5)):
                part = [draw.randint(0, draw.randint(1, 3)) for _ in range(draw.randint(1, 7))]
                w += (part * 8)[: draw.randint(1, 45)]
            texts.append(w)
        words = np.array([x for w in texts for x in w], dtype=np.uint64)
        rows = np.array([i for i, w in enumerate(texts) for _ in w], dtype=np.int64)
        before = np.cumsum([0, *map(len, texts)])
        wanted = [(s + before[i], n, q) for i, w in enumerate(texts) for s, n, q in sorted(runs_by_hand(w), key=lambda x: (x[0], x[2]))]
        assert list(zip(*(x.tolist() for x in periodic_runs.find_runs(words, rows)))) == wanted


def test_periodic_ends(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = ["", None, "one", "a b c", " ".join(f"w{k}" for k in range(50))]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(ids)] + [(None, "x y"), (ids[0] + 10**6, None)]
    for r in with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = split_words(dict(rows)[r["doc_id"]])
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
        assert split_words(r["text"]) == w


def phrases_by_hand(rows, threshold, kept):
    lower = {i: i + 32 for i in range(65, 91)}
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    hidden = set()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            hidden |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * a >= 80 * often[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in hidden:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, i + 1, w.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items() for i, (score, a, w, left, right) in enumerate(sorted(found)[:kept])
    )


def odd_speech():
    draw = random.Random(4)
    vocabulary = ["The", "the", "of", "état", "zu", "Γ", "x1", "-", "日本"]
    rows = []
    for lang in ("en", "und", None, "de,x\n"):
        for _ in range(60):
            words = [draw.choice(vocabulary[: draw.randint(2, 9)]) for _ in range(draw.randint(0, 40))]
            rows.append((lang, "".join(w + draw.choice([" ", " ", "\t", "  ", ", ", "\n", "! "]) for w in words)))
    rows += [("en", "new york city hall " * 2)] * 40 + [("en", None), ("fr", ""), ("fr", "rare words")]
    return rows


@pytest.mark.parametrize("threshold, kept, cell_bytes", [(5, 2000, 1000), (30, 7, 16_000_000), (1, 10**6, 100), (10**6, 10, 100)])
def test_collocations(spark, monkeypatch, threshold, kept, cell_bytes):
    monkeypatch.setattr(collocations, "CELL_BYTES", cell_bytes)
    rows = odd_speech()
    table = spark.createDataFrame([(i, t, lang, 1, "c", "s", 0.5, 3, 4) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(4)
    out = collocations.collocations(table, Workspace(spark, "t"), threshold, kept)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == phrases_by_hand(rows, threshold, kept)


def test_collocations_of_nothing(spark, nothing):
    assert collocations.collocations(nothing, Workspace(spark, "t")).count() == 0
    blank = nothing.sparkSession.createDataFrame(rows_of([None, "", " .,!\n"]), SCHEMA)
    assert collocations.collocations(blank, Workspace(spark, "t"), 1).count() == 0


def test_a_summary_never_loses_a_frequent_key():
    draw = random.Random(2)
    for threshold in (3, 30):
        keys = [draw.randrange(10**6) for _ in range(20_000)] + [7] * threshold + [8] * (threshold - 1) + [9] * 900
        draw.shuffle(keys)
        summary = collocations.Summary(len(keys) // threshold + 1)
        for i in range(0, len(keys), 300):
            summary.add(*collocations.counted(np.array(keys[i : i + 300], dtype=np.uint64), np.ones(len(keys[i : i + 300]), np.int64)))
        left = set(summary.survivors(threshold).tolist())
        assert {k for k, n in Counter(keys).items() if n >= threshold} <= left
        assert summary.lost < threshold and len(left) <= summary.capacity


def jump_by_hand(key, shards):
    shard, landing = -1, 0
    while landing < shards:
        shard = landing
        key = (key * 2862933555777941757 + 1) % 2**64
        landing = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


def test_jump():
    draw = random.Random(9)
    keys = np.array([draw.getrandbits(60) for _ in range(6000)])
    for shards in (1, 2, 24, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump_by_hand(int(k), shards) for k in keys]
    now, grown = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(grown[now != grown]) == {24} and 150 < (now != grown).sum() < 350
    assert np.bincount(now, minlength=24).min() > 180


def test_shards_of_odd_rows(spark, nothing):
    rows = rows_of(ODD) + rows_of(["copy"] * 700, 5)[:1] * 700 + [(None, t, None, 1, "c", "s", 0.5, 3, 4) for t in ["a", None, "a"] * 50]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = sharding.assign(table, 3, Workspace(spark, "t")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    for of in ("shard", "grown_shard"):
        assert all(len({r[of] for r in out if r["doc_id"] == i}) == 1 for i in {r["doc_id"] for r in out})
    assert all(r["grown_shard"] in (r["shard"], 3) for r in out)
    again = sharding.assign(table.repartition(2), 3, Workspace(spark, "t")).collect()
    once = {i for i, n in Counter(r["doc_id"] for r in out).items() if n == 1}
    assert {r["doc_id"]: r["slot"] for r in out if r["doc_id"] in once} == {r["doc_id"]: r["slot"] for r in again if r["doc_id"] in once}
    assert sharding.assign(nothing, 3, Workspace(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), 0)


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, 4, str(tmp_path / "shards"), files=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    wanted = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 4, Workspace(spark, "t")).collect()}
    assert {r["doc_id"]: r["__shard"] for r in back.collect()} == wanted
    assert sorted(map(str, back.drop("__shard").collect())) == sorted(map(str, docs.collect()))
