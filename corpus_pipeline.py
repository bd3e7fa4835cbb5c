"""Five stages that turn ``documents`` into an encoded training corpus.

Each stage takes (spark, docs, sf_dir), where docs is the written result of the one before, and
returns the rows it keeps; the last adds the piece ids. Columns of documents, extra ones too,
pass unchanged. Once a stage begins, the tables the one before kept in the shared folder are
deleted: its result has been written by then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshock.llm import decontaminate, digest_index, jaccard_join, language_id, sentencepiece_codec
from panelshock.llm.workspace import Workspace, in_small_batches, read_table

LEAST_SCORE = 0.5
PREDICTED, SCORE = "__predicted", "__score_of_prediction"
_open: list[Workspace] = []


def _begin(spark: SparkSession, label: str) -> Workspace:
    while _open:
        _open.pop().drop_all()
    _open.append(Workspace(spark, label))
    return _open[-1]


@in_small_batches
def _written(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], work: Workspace) -> DataFrame:
    """The operator's result as a table. A lazy result would hand Python batches of the size the
    session has when the caller writes it: whole texts of 10,000 rows, once for each task in the
    executor and again in its Python worker."""
    return work.table(operator(docs), "written")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a determined language: those without a letter, or whose best language is less
    likely than all others together, go. Without any labelled row no language can be learned,
    and only texts without a letter go."""
    work = _begin(spark, "pipeline-language")
    model = language_id.train(docs, work)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = (F.col(PREDICTED) != language_id.UNDETERMINED) & (F.col(SCORE) >= LEAST_SCORE)
    return _written(docs, lambda d: language_id.predict(d, model, names=(PREDICTED, SCORE)).where(kept).drop(PREDICTED, SCORE), work)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return digest_index.drop_copies(docs, _begin(spark, "pipeline-exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of similar documents, by doc_id. Rows without
    doc_id stay; rows that share the kept doc_id all stay."""
    work = _begin(spark, "pipeline-near")
    classes = jaccard_join.similarity_classes(docs, work)
    gone = work.table(classes.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that benchmark passages do not contaminate."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), _begin(spark, "pipeline-benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its piece ids and whether they decode to its text; a NULL text decodes
    to the empty one."""
    work = _begin(spark, "pipeline-encode")
    return _written(docs, lambda d: sentencepiece_codec.encode_checked(d, out="piece_ids", check="round_trip"), work)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("sentencepiece", encode_pieces),
]

# the first stage is learned, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result but the last is written and read again. The
    last reads the table of its stage, which stays until a next run begins."""
    docs = read_table(spark, sf_dir, "documents")
    work, written = Workspace(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
        work.drop(*written)
        written = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
