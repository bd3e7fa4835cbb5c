"""The learned queries on held-out rows of the test tables, and the pipeline against Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from panelshock.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.01"


def table(name):
    return duckdb.sql(f"select * from '{FOLDER}/{name}.parquet'").fetchall()


def test_quality_on_held_out_rows(spark):
    out = {r["doc_id"]: r for r in REGISTRY["op1_quality_classifier"](spark, FOLDER).collect()}
    held = [(out[i], q) for i, q, _ in table("labels") if out[i]["held_out"]]
    assert len(out) == len(table("documents")) and len(held) > 50
    assert sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())


def test_language_on_held_out_rows(spark):
    out = {r["doc_id"]: r for r in REGISTRY["op10_language_id"](spark, FOLDER).collect()}
    held = [(out[d[0]]["lang_pred"], d[2]) for d in table("documents") if out[d[0]]["held_out"]]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_language_model_scores_every_text(spark):
    out = REGISTRY["op2_lm_scoring"](spark, FOLDER).collect()
    words = {d[0]: len(brute.white_words(d[1])) for d in table("documents")}
    assert {r["doc_id"]: r["n_tokens"] for r in out} == words
    # text is better predicted than by shares of classes alone would allow for shuffled junk
    assert sum(r["log_prob"] for r in out) / sum(words.values()) > -11


def test_round_trip_and_counts(spark):
    coded = REGISTRY["op8_sentencepiece"](spark, FOLDER)
    assert coded.where("NOT round_trip").count() == 0 and coded.count() == len(table("documents"))
    counts = REGISTRY["op3_token_counts"](spark, FOLDER).collect()
    units = {d[0]: len(brute.unit_bytes(d[1])) for d in table("documents")}
    assert {r["doc_id"]: r["n_units"] for r in counts} == units


def test_repeated_passages(spark):
    rows = REGISTRY["op4_paragraph_dedup"](spark, FOLDER).collect()
    texts = {d[0]: d[1] for d in table("documents")}
    removed = {r["doc_id"] for r in rows if r["removed"]}
    windows = {}
    for i, t in sorted(texts.items()):
        w = brute.white_words(t)
        for k in range(len(w) - 59):
            windows.setdefault(tuple(w[k : k + 60]), []).append(i)
    later = {i for ids in windows.values() for i in set(ids) if i != min(ids)}
    assert later and len(later - removed) <= 0.05 * len(later)
    short = {}
    for i, t in texts.items():
        w = brute.white_words(t)
        for k in range(len(w) - 13):
            short.setdefault(tuple(w[k : k + 14]), []).append(i)
    repeating = {i for ids in short.values() if len(ids) > 1 for i in ids}
    assert {r["doc_id"] for r in rows if r["removed"]} - repeating == set()


def test_pipeline_equals_python(spark):
    docs = {d[0]: d[1] for d in table("documents") if any(c.isalpha() for c in d[1] or "")}
    best = {}
    for i, t in docs.items():
        best.setdefault(brute.digest(t), []).append((-len(t or ""), i))
    docs = {min(g)[1]: docs[min(g)[1]] for g in best.values()}
    # only texts that share a shingle can be similar
    owners = {}
    for i, t in docs.items():
        for s in brute.shingles(t):
            owners.setdefault(s, set()).add(i)
    sets, pairs = {i: brute.shingles(t) for i, t in docs.items()}, set()
    for ids in owners.values():
        pairs |= {(a, b) for a in ids for b in ids if a < b}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    docs = {i: t for i, t in docs.items() if find(i) == i}
    hits = brute.contamination(list(docs.values()), table("benchmark"))
    kept = {i for i, (n, h, _) in zip(docs, hits) if not (h > 0 and 20 * h >= n)}
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    found = out.select("doc_id", "text", "round_trip", F.size("piece_ids").alias("n")).collect()
    assert {r["doc_id"] for r in found} == kept and len(found) == len(kept)
    texts = {d[0]: d[1] for d in table("documents")}
    assert all(r["round_trip"] and r["text"] == texts[r["doc_id"]] and r["n"] > 0 for r in found)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, `__row` int, id int, gone int"
    rows = [(1, "the same text here", "en", "s", 1, 0.1, 1, 1, 1), (1, "the same text here", "en", "s", 1, 0.1, 1, 1, 1), (None, "der text hier", "de", None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None), (4, "", "en", "s", 0, 0.0, 0, 0, 0)]
    full = spark.createDataFrame(rows, schema)
    out = stage(spark, full, FOLDER)
    assert out.columns[: len(full.columns)] == full.columns and 2 <= out.count() <= 5
    assert stage(spark, full.limit(0), FOLDER).count() == 0
