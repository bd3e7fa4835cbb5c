"""Batches that run twice, and languages without spaces."""

import random

from panelshock.llm import digest_index, language_id
from panelshock.llm.workspace import Workspace


def test_a_batch_whose_result_was_lost_decides_as_before(spark):
    work = Workspace(spark, "t")
    index = digest_index.new_index(work)
    schema = "doc_id long, text string"

    def batch(rows):
        return Workspace(spark, "t").table(digest_index.tagged(spark.createDataFrame(rows, schema)), "rows")

    def kept(rows, name=None):
        out = digest_index.deduplicate(batch(rows), index, Workspace(spark, "t"), name).collect()
        return {r["__id"]: (r["kept"], r["keep_id"], r["group_size"]) for r in out}

    one = [(1, "a b"), (2, "ab"), (3, None), (4, "c")]
    first = kept(one)
    assert first == {1: (True, 1, 2), 2: (False, 1, 2), 3: (True, 3, 1), 4: (True, 4, 1)}
    assert kept(one) == first and index.table().count() == 3
    two = [(5, "c"), (6, "d"), (7, "d d")]
    second = kept(two, "monday")
    assert second == {5: (False, 4, 1), 6: (True, 6, 1), 7: (True, 7, 1)}
    assert kept(two, "monday") == second and kept(one) == first and index.table().count() == 5
    # the same rows under another name are copies of what is there
    assert {k: v[0] for k, v in kept(two, "tuesday").items()} == {5: False, 6: False, 7: False}
    assert kept([], "nothing") == {} and index.table().count() == 5


def test_languages_without_spaces_are_told_apart(spark):
    draw = random.Random(8)
    letters = {"zh": [chr(0x4E00 + 7 * i) for i in range(300)], "th": [chr(0x0E01 + i) for i in range(46)], "ja": [chr(0x3041 + i) for i in range(80)]}
    rows = [(i, "".join(draw.choice(letters[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(letters) * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.predict(docs, language_id.train(docs, Workspace(spark, "t"))).withColumn("held", language_id.held_out()).collect()
    held = [r for r in found if r["held"]]
    assert len(held) > 50 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_parts_of_long_units():
    for text in ("x" * 100, "日本語" * 30, "é" * 41, "ab", "", "𝄞" * 25):
        parts = language_id.taught_parts(text.encode())
        assert b"".join(parts).decode() == text and all(len(p) <= language_id.LONGEST_TAUGHT and p.decode() is not None for p in parts)
