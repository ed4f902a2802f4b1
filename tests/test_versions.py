"""Versioned tables: newest version of a paper, tombstones, compaction, and the stream that writes them."""

import tempfile

import pytest
from pyspark.sql import functions as F

from leafgrain.operators import runs as rn
from leafgrain.sources.versions import Versions
from leafgrain.streaming import streams as st

PAPERS = "paper_id string, space_id string, deleted boolean"
ROWS = "id string, paper_id string, space_id string, content_hash string"


def put(spark, versions, number, papers, rows):
    versions.put(number, spark.createDataFrame(papers, PAPERS), passages=spark.createDataFrame(rows, ROWS))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture()
def versions(spark):
    v = Versions(spark, tempfile.mkdtemp(prefix="spark-"))
    put(spark, v, 0, [("a", "s", False), ("b", "s", False)], [("a0", "a", "s", "x"), ("a1", "a", "s", "y"), ("b0", "b", "s", "x"), ("note", None, "s", "n")])
    put(spark, v, 1, [("a", "s", False), ("a", "s", None), ("a", "t", False)], [("a2", "a", "s", "x"), ("t0", "a", "t", "x")])
    return v


def test_newest_version_of_each_paper_is_read(spark, versions):
    assert ids(versions.current("passages")) == ["a2", "b0", "note", "t0"]
    assert ids(versions.current("passages", 0)) == ["a0", "a1", "b0", "note"]
    assert ids(versions.replaced("passages", 1)) == ["a0", "a1"] and ids(versions.replaced("passages", 0)) == []
    put(spark, versions, 2, [("b", "s", False)], [])  # a parse without passages
    assert ids(versions.current("passages")) == ["a2", "note", "t0"]
    put(spark, versions, 2, [("b", "s", False)], [("b1", "b", "s", "z")])  # replayed
    assert ids(versions.current("passages")) == ["a2", "b1", "note", "t0"]


def test_tombstones_and_return(spark, versions):
    put(spark, versions, 2, [("a", "s", True), ("b", "s", False)], [("lost", "a", "s", "x"), ("b1", "b", "s", "x")])
    assert ids(versions.current("passages")) == ["b1", "note", "t0"] and ids(versions.written("passages", 2)) == ["b1"]
    put(spark, versions, 3, [("a", "s", False)], [("a3", "a", "s", "x")])
    assert ids(versions.current("passages")) == ["a3", "b1", "note", "t0"]


def test_a_version_without_manifest_is_not_seen(spark, versions):
    spark.createDataFrame([("a9", "a", "s", "x")], ROWS).write.parquet(f"{versions.root}/passages/version=7")
    assert ids(versions.current("passages")) == ["a2", "b0", "note", "t0"]


def test_compaction_keeps_rows_and_later_versions_replace_them(spark, versions):
    assert versions.compact("passages") == 1 and versions.compact("passages") == 1
    versions.vacuum("passages")
    assert ids(versions.current("passages")) == ["a2", "b0", "note", "t0"]
    put(spark, versions, 2, [("b", "s", True), ("a", "t", False)], [("t1", "a", "t", "x")])
    assert ids(versions.current("passages")) == ["a2", "note", "t1"]
    assert versions.compact("passages") == 2
    versions.vacuum("passages")
    assert ids(versions.current("passages")) == ["a2", "note", "t1"]
    with pytest.raises(ValueError):
        Versions(spark, versions.root + "/none").current("passages")


def test_versions_feed_the_citation_remap(spark, versions):
    cards = spark.createDataFrame(
        [("c", "a", "s", "a0", ["a0", "a1"])], "id string, paper_id string, space_id string, source_passage_id string, source_passage_ids array<string>")
    links = spark.createDataFrame([], "id string, card_id string, passage_id string, paper_id string, space_id string, created_at timestamp")
    moved, _ = rn.remap_by_hash(versions.replaced("passages", 1), versions.written("passages", 1), cards, links)
    assert [(r["source_passage_id"], r["source_passage_ids"]) for r in moved.collect()] == [("a2", ["a2"])]


def test_stream_replaces_papers_over_batches(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    schema = "doc_id bigint, text string, at int, gone boolean"
    batches = [
        [(1, "one old", 0, False), (1, "one new", 1, False), (2, "two", 0, False)],
        [(2, "two again", 2, False), (3, "three", 2, False)],
        [(1, "", 3, False), (3, "three", 3, True)],
    ]
    v = Versions(spark, f"{root}/versions")

    def chunk(batch):
        return batch.filter("text <> ''").select(
            F.concat("doc_id", F.lit("-"), "at").alias("id"), F.col("doc_id").cast("string").alias("paper_id"), F.lit("s").alias("space_id"),
            F.lit("").alias("section"), F.col("text").alias("original_text"))

    def papers(batch):
        return batch.select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("s").alias("space_id"), F.col("gone").alias("deleted"))

    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        st.stream_replace_passages(stream, chunk, papers, v, f"{root}/state", F.col("at")).awaitTermination()
        seen.append(ids(v.current("passages")))
    assert seen == [["1-1", "2-0"], ["1-1", "2-2", "3-2"], ["2-2"]]
    assert {r["term"] for r in v.current("postings").collect()} == {"two", "again"}
