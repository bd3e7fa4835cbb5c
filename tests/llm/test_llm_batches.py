"""What Python holds of a table at once."""

import pyarrow as pa

import corpus_pipeline
from panelshock.llm import jaccard_join, language_id, paragraph_dedup, sentencepiece_codec
from panelshock.llm.workspace import BATCH, BATCH_BYTES, BATCH_ROWS, Workspace, in_small_batches


def rows_per_batch(make):
    """The operator of ``make``, which fails where a batch has more rows than allowed."""

    def wrapped(*given):
        run = make(*given) if given else make

        def counted(batches, most=BATCH_ROWS):
            def checked():
                for batch in batches:
                    assert batch.num_rows <= most, batch.num_rows
                    yield batch

            return run(checked())

        return counted

    return wrapped


def copies(spark, groups=1500):
    texts = [" ".join(f"w{g}x{i}" for i in range(40)) for g in range(groups)]
    rows = [(2 * g + k, text + f" end{g}" * k) for g, text in enumerate(texts) for k in range(2)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_pairs_of_sets_meet_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "similar_sets", rows_per_batch(jaccard_join.similar_sets))
    monkeypatch.setattr(jaccard_join, "_profiles", rows_per_batch(jaccard_join._profiles))
    before = spark.conf.get(BATCH)
    found = jaccard_join.similarity_classes(copies(spark), Workspace(spark, "batches"))
    assert spark.conf.get(BATCH) == before
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found.collect()) and found.count() == 3000


def test_pieces_meet_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(paragraph_dedup, "_extended", rows_per_batch(paragraph_dedup._extended)())
    found = paragraph_dedup.repeated_paragraphs(copies(spark), Workspace(spark, "batches"))
    assert found.where("removed").select("doc_id").distinct().count() == 1500


def test_pipeline_stages_hand_out_small_batches_whoever_writes_them(spark, monkeypatch, tmp_path):
    for module, name in ((language_id, "_predict"), (sentencepiece_codec, "_encode")):
        monkeypatch.setattr(module, name, rows_per_batch(getattr(module, name)))
    docs = copies(spark).selectExpr("*", "if(doc_id % 9 = 0, 'en', 'de') AS lang")
    before = spark.conf.get(BATCH)
    corpus_pipeline.identify_language(spark, docs, "").write.parquet(f"{tmp_path}/language")
    corpus_pipeline.encode_pieces(spark, docs, "").write.parquet(f"{tmp_path}/pieces")
    assert spark.conf.get(BATCH) == before
    assert spark.read.parquet(f"{tmp_path}/pieces").where("round_trip").count() == 3000


def test_slices_of_a_given_size():
    from panelshock.llm.textbytes import slices

    assert [(b, e) for b, e, *_ in slices(pa.array(["abcd"] * 10), 8)] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]


def test_pairs_that_cannot_be_similar_never_meet_with_their_sets(spark, monkeypatch):
    """All share one run of five words, and many the least hash of a band with it; the last two
    agree but for one word at the end."""
    texts = [f"one run of five words {' '.join(f'd{i}w{k}' for k in range(14))}" for i in range(150)]
    texts += [" ".join(f"same{k}" for k in range(28)) + end for end in ("", " more")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, links = [], paragraph_dedup._links

    def counted(texts, pairs, work, label):
        met.append(pairs.count())
        return links(texts, pairs, work, label)

    monkeypatch.setattr(paragraph_dedup, "_links", counted)
    found = paragraph_dedup.repeated_paragraphs(docs, Workspace(spark, "candidates"))
    assert sum(met) == 1
    assert {r["doc_id"] for r in found.where("removed").collect()} == {151}


def test_only_texts_with_copies_are_shuffled_and_a_piece_is_written_for_one_side(spark, monkeypatch):
    counts, table = {}, Workspace.table

    def counted(self, df, name):
        out = table(self, df, name)
        counts[name] = out.count()
        if name == "chains":
            counts["kept ranges"] = out.select("keep_doc_id", "keep_low", "keep_high").distinct().count()
        return out

    monkeypatch.setattr(Workspace, "table", counted)
    same = " ".join(f"s{i}" for i in range(30))
    docs = copies(spark, 20).unionByName(spark.createDataFrame([(100, same), (101, same), (102, None), (103, "")], "doc_id long, text string"))
    work = Workspace(spark, "volume")
    found = paragraph_dedup.repeated_paragraphs(docs, work)
    assert counts["met-texts"] == 2 and counts["texts"] == 43
    assert counts["pieces"] == counts["chains"] + counts["kept ranges"] == 40
    assert {r["doc_id"] for r in found.where("removed").collect()} == {101, *range(1, 40, 2)}


def test_long_texts_do_not_add_up_in_a_batch(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["size"])

    @in_small_batches
    def operator(docs):
        return [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]

    docs = spark.range(120, numPartitions=1).selectExpr("repeat('text ', 20000) AS text")
    found = operator(docs)
    assert sum(found) >= 12_000_000 and max(found) <= BATCH_BYTES + 200_000


def test_a_text_that_repeats_itself_is_matched_by_chains_as_long_as_the_passage(spark, monkeypatch):
    """The first occurrence and the last one are chained apart, so no chain's range of the text
    kept holds what lies between the two."""
    chains, table = [], Workspace.table

    def seen(self, df, name):
        out = table(self, df, name)
        if name == "chains":
            chains.extend(out.collect())
        return out

    monkeypatch.setattr(Workspace, "table", seen)
    passage = " ".join(f"same{k}" for k in range(24))
    text = " ".join(f"{passage} " + " ".join(f"d{i}w{k}" for k in range(70)) for i in range(12))
    found = paragraph_dedup.repeated_paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"), Workspace(spark, "chains"))
    assert len(chains) >= 11 + 10
    assert all(r["keep_high"] - r["keep_low"] == r["own_high"] - r["own_low"] <= 24 for r in chains)
    assert {94 * i for i in range(1, 12)} <= {r["number"] for r in found.where("removed").collect()}
