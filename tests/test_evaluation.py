"""Metrics of the parse evaluation on papers with and without passages."""

import __spark_entry__ as entry
from leafgrain.operators import runs as rn

PASSAGES = "paper_id string, section string, heading_path array<string>, page_number int, paragraph_index int, original_text string, token_count int, table_id string"


def test_papers_without_passages_count(spark):
    def passages(*texts):
        return spark.createDataFrame([("a", "s", ["s"], 1, i, t, 5, "") for i, t in enumerate(texts)], PASSAGES)

    elements = spark.createDataFrame([("a", "heading", "One"), ("b", "heading", "Two")], "paper_id string, element_type string, text string")
    expected = spark.createDataFrame([("a", "One"), ("b", "Three")], "paper_id string, heading string")
    terms = spark.createDataFrame(
        [("a", ["x"], ["z"]), ("b", ["x"], ["z"]), ("c", [], [])], "paper_id string, table_terms array<string>, reference_terms array<string>"
    )
    outcomes = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "paper_id string, success boolean")
    args = (passages("p", "z"), passages("p", "q"), elements, expected, terms, outcomes)
    row = rn.parse_eval_metrics(*args, max_tokens=4).first().asDict()
    assert row == {
        "heading_recall": 0.5, "table_isolation": 0.0, "reference_filter_precision": 0.75,  # (1/2 + 1) / 2
        "stable_source_ratio": 0.833333,  # (1/2 + 1 + 1) / 3
        "max_token_violation_count": 2, "parse_success_rate": 0.666667,
    }


def test_query_has_every_metric_of_the_evaluation(spark):
    assert "stable_source_ratio" in entry.oracle_sql()["parse_eval_metrics"]
    out = entry.queries()["parse_eval_metrics"](spark, "/root/testdata/sf0.001")
    assert set(out.columns) == {
        "heading_recall", "table_isolation", "reference_filter_precision", "stable_source_ratio", "max_token_violation_count", "parse_success_rate",
    }
