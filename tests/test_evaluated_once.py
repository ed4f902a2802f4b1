"""Texts are evaluated once a row, and small results show Spark their size."""

import time

from pyspark.sql import functions as F

from leafgrain.functions import text as tx
from leafgrain.operators import cards as cd
from leafgrain.operators import retrieval as rt
from leafgrain.plans.corpus import Corpus

ROOT = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_plain_once(spark):
    c = Corpus(spark, ROOT)
    read = c.passages.select("original_text", F.sha2("original_text", 256), "content_hash")
    assert plan(read).count("regexp_replace(") == 1
    assert not spark.createDataFrame([(chr(i),) for i in (9, 28, 133, 160, 5760, 8202, 12288)], "t string").filter(
        (tx.strip("t") != "") | (tx.normalize_ws(F.col("t")) != "")).count()


def test_postings_are_counted_in_their_own_row(spark):
    rows = [("a", "p", "s", "Été", "b ete B c"), ("e", "p", "s", None, "..."), ("n", "p", "s", "x", None)]
    postings = rt.build_postings(spark.createDataFrame(rows, "id string, paper_id string, space_id string, section string, original_text string"))
    assert "Aggregate" not in plan(postings)
    assert {(r["term"], r["passage_id"], r["length"], r["tf"]) for r in postings.collect()} == {
        ("b", "a", 5, 2), ("c", "a", 5, 1), ("ete", "a", 5, 2), ("x", "n", 1, 1)}


def test_hits_show_their_size(spark):
    c = Corpus(spark, ROOT)
    hits = rt.fts_rank(c.queries, rt.build_postings(c.passages), rt.corpus_stats(c.passages), 5)
    assert hits.count() > 0
    assert int(hits._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1_000_000


def test_cards_are_dealt_before_their_texts_and_worded_once(spark):
    c = Corpus(spark, ROOT)
    assert "posexplode" not in plan(c.cards)
    assert plan(c.cards).index("regexp_replace(") < plan(c.cards).index("RepartitionByExpression")
    assert "regexp_" not in plan(cd.duplicate_card_pairs(c.cards))


def test_analysis_metrics_read_stored_cards_and_passages(spark):
    from leafgrain.plans.catalog import QUERIES

    metrics = QUERIES["analysis_eval_metrics"](spark, ROOT)
    assert "documents.parquet" not in str(metrics.inputFiles()) and metrics.count() == 1


def test_pairs_of_long_texts(spark):
    one = spark.createDataFrame([("\u4e00",), ("\u4e00\u4e01\u4e02 the x",), ("",)], "t string")
    assert [r[0] for r in one.select(tx.summary_tokens(F.col("t"))).collect()] == [
        ["\u4e00"], ["x", "\u4e00\u4e01", "\u4e01\u4e02"], []]
    long = spark.createDataFrame([("\u4e00" * 6000,)], "t string").select(F.size(tx.summary_tokens(F.col("t"))).alias("n"))
    began = time.perf_counter()
    assert long.first()["n"] == 5999
    assert time.perf_counter() - began < 20


def test_hybrid_queries_read_counted_passages(spark):
    from leafgrain.plans.catalog import QUERIES

    rows = [("a", "p", "s", "", "b b"), ("n", "p", "s", "", "...")]
    p = spark.createDataFrame(rows, "id string, paper_id string, space_id string, section string, original_text string")
    postings, corpus, homes = rt.search_tables(p)
    assert [tuple(r) for r in postings.collect()] == [("b", "a", "p", "s", 2, 2)]
    assert [tuple(r) for r in corpus.collect()] == [(1, 2.0)] and homes.count() == 2
    assert tuple(rt.search_tables(p.filter("id = 'n'"))[1].first()) == tuple(rt.corpus_stats(p.filter("id = 'n'")).first())
    for name in ("hybrid_search", "fts_search"):
        assert "documents.parquet" not in str(QUERIES[name](spark, ROOT).inputFiles())


def test_embed_query_makes_texts_once_and_numbers_no_batch(spark):
    from leafgrain.operators import embeddings as em
    from leafgrain.plans.catalog import QUERIES

    made = QUERIES["embed_passages"](spark, ROOT)
    assert "Window" not in plan(made) and "documents.parquet" not in str(made.inputFiles())
    rows = [(f"p{i}", f"h{i % 30}", f"word{i}") for i in range(50)]
    passages = spark.createDataFrame(rows, "id string, content_hash string, original_text string").coalesce(1)
    stored = spark.createDataFrame([("p0", "l", "m", 1, [1.0], "h0")], "passage_id string, provider string, model string,"
                                   " dimension int, embedding array<float>, content_hash string").withColumn("created_at", F.current_timestamp())

    def sizes(texts):
        assert len(texts) <= 16
        return [[float(len(texts)), float(text.split("word")[1])] for text in texts]

    out = em.embed_passages(em.embedding_actions(passages, stored, "l", "m"), sizes, "l", "m", F.current_timestamp()).collect()
    # p0 has a vector and p30 its content; the 48 others are three full batches.
    assert {r["passage_id"]: list(r["embedding"]) for r in out} == {f"p{i}": [16.0, i] for i in range(50) if i not in (0, 30)}
