"""Null blocks and paths, equal ranks, padded ids, text ids, oversize files and quotes anywhere."""

from pyspark.sql import functions as F

from leafgrain.functions import text as tx
from leafgrain.operators import cards as cd
from leafgrain.operators import embeddings as em
from leafgrain.operators import keyed, layout, retrieval
from leafgrain.sources import tables as tb

PASSAGES = "id string, paper_id string, space_id string, parse_run_id string, page_number int, paragraph_index int, content_hash string, original_text string"


def test_null_blocks_and_keys_are_numbered(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", 3, 3), (None, 1, 4), (None, None, 5)], "k string, page int, n int")
    out = {r.n: r.at for r in keyed.number_rows(rows, ["k"], "page", [F.col("n")], "at").collect()}
    assert out == {1: 0, 2: 1, 3: 2, 5: 0, 4: 1}
    value = F.when(F.col("n") % 2 == 1, F.col("n"))
    carried = {r.n: r.last for r in keyed.carry_last(rows, ["k"], "page", [F.col("n")], value, "last").collect()}
    assert carried == {1: 1, 2: 1, 3: 3, 5: 5, 4: 5}


def test_passages_without_page_or_run_get_a_batch(spark):
    passages = spark.createDataFrame(
        [(f"p{i}", "d", "s", None if i % 2 else "r", None if i % 3 else 1, i, f"h{i}", "text") for i in range(40)], PASSAGES)
    stored = spark.createDataFrame([], "passage_id string, provider string, model string, dimension int, embedding array<float>, created_at timestamp, content_hash string")
    plan = em.embedding_plan(passages, stored, "local", "m").collect()
    assert len(plan) == 40 and all(r.action == "embed" and r.batch is not None for r in plan)
    assert sorted(r.batch for r in plan if r.parse_run_id is None) == [0] * 16 + [1] * 4


def test_elements_without_a_path_are_body(spark):
    rows = spark.createDataFrame([("paragraph", None, "words"), ("paragraph", ["References"], "cited"), ("paragraph", ["Intro"], "more")],
                                 "element_type string, heading_path array<string>, text string")
    assert [r.text for r in layout.searchable_body(rows).collect()] == ["words", "more"]


def test_no_terms_no_marks(spark):
    row = spark.range(1).select(tx.marked_window(F.lit("C++ and C#"), F.array().cast("array<string>"), F.lit(1)).alias("s")).first()
    assert row.s == "C++ and C#"


def test_equal_ranks_are_ordered_by_id(spark):
    cards = spark.createDataFrame(
        [(i, "s", "d", "Method", "alpha beta gamma delta " + w, ["p1"], 0.9, 1) for i, w in (("a", "one"), ("b", "one two"))],
        "id string, space_id string, paper_id string, card_type string, summary string, source_passage_ids array<string>, confidence double, card_index int")
    scores = spark.createDataFrame([("s", "d", "p1", 5)], "space_id string, paper_id string, passage_id string, score int")
    out = {r.id: r.verdict for r in cd.dedup_rank_cards(cards, scores).collect()}
    assert out == {"a": "ranked", "b": "duplicate"}


def test_padded_ids_are_found(spark):
    cards = spark.createDataFrame(
        [("c", "s", "d", "Method", "A summary of it", [" p1 "], "the quick brown fox jumps", "because", 0.9, [], {})],
        "id string, space_id string, paper_id string, card_type string, summary string, source_passage_ids array<string>, evidence_quote string,"
        " reasoning_summary string, confidence double, quality_flags array<string>, metadata map<string,string>")
    passages = spark.createDataFrame([("p1", "s", "d", "Here the quick brown fox jumps over it.")], "id string, space_id string, paper_id string, original_text string")
    row = cd.verify_cards(cards, passages).first()
    assert row.reason == "" and row.accepted


def test_text_query_ids(spark):
    vectors = spark.createDataFrame([("q-a", "s", "local", "m", [1.0, 0.0])], "query_id string, space_id string, provider string, model string, vector array<double>")
    stored = spark.createDataFrame([("p1", "local", "m", 2, [1.0, 0.1])], "passage_id string, provider string, model string, dimension int, embedding array<double>")
    passages = spark.createDataFrame([("p1", "s")], "id string, space_id string")
    assert [(r.query_id, r.passage_id) for r in retrieval.vector_rank(vectors, stored, passages).collect()] == [("q-a", "p1")]


def test_oversize_files_are_rejected_not_dropped(spark):
    files = spark.createDataFrame([(1, "s", "a.pdf", bytearray(b"xx"), 1), (2, "s", "b.pdf", bytearray(b"xxxxx"), 2)],
                                  "file_id int, space_id string, filename string, content binary, arrived int")
    known = spark.createDataFrame([], "id string, space_id string, file_hash string")
    assert {r.file_id: r.status for r in tb.register_documents(files, known, max_bytes=4).collect()} == {1: "registered", 2: "rejected"}


def test_a_batch_of_any_size_is_accepted_without_a_limit(spark):
    files = spark.createDataFrame([(1, i, "a.pdf", 10) for i in range(30)], "batch_id int, file_id int, filename string, size int")
    assert tb.ingest_report(files).first().succeeded == 30 and tb.ingest_report(files, max_files=20).first().failed == 30


def test_quotes_are_found_wherever_they_stand(spark):
    texts = spark.createDataFrame([(1, "one alpha beta gamma delta two"), (2, "xalpha beta gamma deltax"), (3, "alpha gamma beta")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "lpha beta gamma del"), (3, "beta alpha gamma"), (4, "gamma"), (5, "nowhere else")], "item int, quote string")
    out = {r.item: r.quoted for r in cd.quoted_anywhere(quotes, "item", texts, "doc_id").collect()}
    assert out == {1: True, 2: True, 3: False, 4: True, 5: False}
