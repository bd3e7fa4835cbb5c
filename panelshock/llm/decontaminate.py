"""Benchmark decontamination by winnowed fingerprints. SQL functions only.

Words are runs of digits, a-z (A-Z lowered) and characters beyond ASCII. A window is 13
consecutive words of an item, or a shorter item as a whole. Of every 6 consecutive 8-gram
hashes the least is a fingerprint, so each run of 13 words, in a document as in an item,
holds a fingerprint that depends on the run alone: equal windows share it. Documents that
share fingerprints with the benchmark are extended around each hit to all windows that hold
it, and windows are compared word by word. Items below 13 words are looked up by the hashes
of all runs of their length; documents pay for that only where such items exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelshock.llm.workspace import Workspace

WINDOW, GRAM = 13, 8
SPAN = WINDOW - GRAM + 1
UPPER = "".join(map(chr, range(0x41, 0x5B)))
# all of ASCII but digits and letters ends a word
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    plain = F.translate(text, UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), "")


def _paired(df: DataFrame, column: str, shift: int, function) -> DataFrame:
    """Combine each element with the one ``shift`` places on; what lacks a partner goes or,
    for ``least``, stays alone."""
    return df.withColumn(
        column, F.zip_with(F.col(column), F.slice(F.col(column), shift + 1, F.greatest(F.size(column), F.lit(0))), function)
    )


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds the word count ``count`` and ``grams``, the hash of each run of 8 words: hashes of
    1, 2, 4 and 8 words, each from two of the one before."""
    out = df.withColumn("count", F.size("words")).withColumn("grams", F.transform("words", lambda w: F.xxhash64(w)))
    for shift in (1, 2, 4):
        out = _paired(out, "grams", shift, lambda a, b: F.xxhash64(a, b))
    return out.withColumn("grams", F.slice("grams", 1, F.greatest(F.col("count") - GRAM + 1, F.lit(0))))


def _with_prints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``prints``: the distinct winnowed hashes, and the hashes of all runs of the short
    item lengths. The least of 6 is that of two overlapping fours."""
    out = df.withColumn("prints", F.col("grams"))
    for shift in (1, 2, 2):
        out = _paired(out, "prints", shift, lambda a, b: F.least(a, b))
    out = out.withColumn("prints", F.array_distinct(F.slice("prints", 1, F.greatest(F.col("count") - WINDOW + 1, F.lit(0)))))
    for length in short:
        out = out.withColumn("prints", F.concat("prints", F.array_distinct(_runs(F.col("words"), F.col("count"), length))))
    return out


def _starts(count: Column, length: int) -> Column:
    """1-based starts of the runs of ``length`` words; none if there are fewer words."""
    return F.when(count >= length, F.sequence(F.lit(1), count - length + 1)).otherwise(F.array().cast("array<int>"))


def _runs(run_words: Column, count: Column, length: int) -> Column:
    return F.transform(_starts(count, length), lambda i: F.xxhash64(F.slice(run_words, i, length)))


def _matching_starts(length: int) -> Column:
    """Starts of the runs of a short item's length whose hash the benchmark holds."""
    return F.filter(
        _starts(F.col("count"), length), lambda i: F.array_contains("matched", F.xxhash64(F.slice("words", i, length)))
    )


def _placed(starts: Column, length: int) -> Column:
    """The run at each start: (start, length, window)."""
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice("words", i, length), " ").alias("window")
        ),
    )


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["digest"] == right["digest"])


def contamination(docs: DataFrame, benchmark: DataFrame, work: Workspace) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` against ``benchmark(item_id, text, ...)``:
    (doc_id, n_words, n_hit, n_items, item_ids, contaminated).

    n_hit counts the words inside any occurrence of a window, n_items the item_ids with
    occurring windows, item_ids those, as sorted strings; contaminated means n_hit > 0 and at
    least 5 % of the words. NULL and empty texts have no words, items without words no
    windows. Equal items count by their ids, rows with equal doc_id and text have equal
    answers; a NULL item_id counts as the empty string. Either table may be empty or hold
    more columns."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    # equal items are one passage
    items = work.table(items.withColumn("passage", F.sha2(F.array_join("words", " ").cast("binary"), 256)), "items")
    passages = work.table(items.select("passage", "words").dropDuplicates(["passage"]), "passages")
    short = [r[0] for r in passages.where(F.size("words") < WINDOW).select(F.size("words")).distinct().orderBy(F.size("words")).collect()]
    bench_prints = work.table(
        _with_prints(_with_grams(passages), short).select(F.explode("prints").alias("print")).distinct(), "bench-prints"
    )
    length = F.least(F.size("words"), F.lit(WINDOW))
    windows = work.table(
        passages.select(
            "passage",
            F.explode(
                F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.array_join(F.slice("words", i, length), " "))
            ).alias("window"),
        ).distinct(),
        "windows",
    )

    base = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))
    profile = work.table(
        _with_prints(_with_grams(base), short).select("id", "digest", F.col("count").cast("long").alias("n_words"), "prints"), "profile"
    )
    hits = (
        profile.select("id", "digest", F.explode("prints").alias("print"))
        .join(bench_prints, "print")
        .groupBy("id", "digest")
        .agg(F.collect_set("print").alias("matched"))
    )
    hits = work.table(hits, "hits")
    text = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), "text")
    suspects = text.join(hits, _same(text, hits)).select(hits["id"], hits["digest"], "matched", "text").dropDuplicates(["id", "digest"])
    suspects = _with_grams(suspects.select("id", "digest", "matched", words(F.col("text")).alias("words")))
    last = F.col("count") - WINDOW + 1
    around = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains("matched", F.element_at("grams", i))),
            lambda i: F.sequence(F.greatest(i - SPAN + 1, F.lit(1)), F.least(i, last)),
        )
    )
    none = F.array().cast("array<int>")
    near = [_placed(F.when(F.col("count") >= WINDOW, F.array_distinct(around)).otherwise(none), WINDOW)]
    near += [_placed(_matching_starts(size), size) for size in short]
    runs = suspects.select("id", "digest", F.explode(F.concat(*near)).alias("run")).select("id", "digest", "run.*")
    found = work.table(runs.join(windows.select("window").distinct(), "window", "left_semi"), "found")

    # words covered by the union of the runs of a document
    order = W.partitionBy("id", "digest").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    covered = F.coalesce(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit_words = (
        found.select("id", "digest", F.greatest(end - F.greatest(F.col("start"), covered), F.lit(0)).alias("new"))
        .groupBy("id", "digest")
        .agg(F.sum("new").alias("n_hit"))
    )
    listed = (
        found.select("id", "digest", "window")
        .join(windows, "window")
        .select("id", "digest", "passage")
        .distinct()
        .join(items.select("passage", "item_id").distinct(), "passage")
        .groupBy("id", "digest")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    known = hit_words.join(listed, _same(hit_words, listed)).select(hit_words["id"], hit_words["digest"], "n_hit", "item_ids")
    known = work.table(known, "known")
    rows = profile.select("id", "digest", "n_words")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        rows.join(known, _same(rows, known), "left")
        .select(
            rows["id"].alias("doc_id"),
            "n_words",
            n_hit.alias("n_hit"),
            F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
            rows["digest"].alias("digest"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, work: Workspace) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns unchanged."""
    bad = work.table(contamination(docs, benchmark, work).where("contaminated").select("doc_id", "digest").distinct(), "contaminated")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    clash = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__digest"])
    return docs.join(bad, clash, "left_anti")
