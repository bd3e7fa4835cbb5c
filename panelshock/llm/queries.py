"""Registered queries of the llm operators: each applies one operator, with its production
parameters, to its whole table and derives the columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshock.llm import (
    collocations, decontaminate, digest_index, jaccard_join, language_id, line_dedup, masked_lm, paragraph_dedup,
    periodic_runs, quality, sentencepiece_codec, sharding, wordpiece_counts,
)
from panelshock.llm.workspace import Workspace, read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SHARDS = 24


def query(f):
    REGISTRY[f.__name__] = f
    return f


@query
def op1_quality_classifier(spark, sf):
    scored = quality.score(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"), Workspace(spark, "op1"))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op2_lm_scoring(spark, sf):
    docs = read_table(spark, sf, "documents")
    return masked_lm.score(docs, masked_lm.train(docs, Workspace(spark, "op2")))


@query
def op3_token_counts(spark, sf):
    return wordpiece_counts.token_counts(read_table(spark, sf, "documents"))


@query
def op4_paragraph_dedup(spark, sf):
    return paragraph_dedup.repeated_paragraphs(read_table(spark, sf, "documents"), Workspace(spark, "op4"))


@query
def op5_line_dedup(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    cleaned = line_dedup.without_runs(docs, line_dedup.repeated_runs(docs, Workspace(spark, "op5")))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", digest.alias("text_sha256"))


@query
def op6_exact_dedup(spark, sf):
    work = Workspace(spark, "op6")
    rows = work.table(digest_index.tagged(read_table(spark, sf, "documents")), "tagged")
    decided = digest_index.deduplicate(rows, digest_index.new_index(work), work)
    return decided.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query
def op7_benchmark_decontamination(spark, sf):
    found = decontaminate.contamination(
        read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), Workspace(spark, "op7")
    )
    listed = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


@query
def op8_sentencepiece(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_checked(docs).select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        "round_trip",
    )


@query
def op9_ngram_jaccard_join(spark, sf):
    return jaccard_join.similarity_classes(read_table(spark, sf, "documents"), Workspace(spark, "op9"))


@query
def op10_language_id(spark, sf):
    docs = read_table(spark, sf, "documents")
    model = language_id.train(docs, Workspace(spark, "op10"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` where every tenth checksum of an id makes the end of its text periodic."""
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x != '')")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    turns = (F.floor((n - a) / p) + 1).cast("int")
    end = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), 1, n - a)
    periodic = F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), end), " ")).otherwise(F.col("text"))
    return docs.withColumn("text", F.when(h % 10 == 0, periodic).otherwise(F.col("text")))


@query
def op11_periodic_runs(spark, sf):
    docs = with_periods(read_table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_collocations(spark, sf):
    return collocations.collocations(read_table(spark, sf, "documents"), Workspace(spark, "op12"))


@query
def op13_sharding(spark, sf):
    placed = sharding.assign(read_table(spark, sf, "documents"), SHARDS, Workspace(spark, "op13"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
