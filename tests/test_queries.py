"""A spread of registered queries against their SQL twins on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
SAMPLE = [
    "count_tokens", "register_documents", "markdown_to_elements", "heading_path_stack", "mark_page_chrome",
    "chunk_documents", "overlap_provenance", "fts_search", "vector_search", "hybrid_search", "stored_fts_search", "stored_vector_search", "sync_vector_lists", "fts_snippets",
    "highlight_snippet", "embedding_plan", "stream_replace_passages",
    "promote_metadata", "analysis_batches", "verify_cards", "dedup_rank_cards", "enrich_cards", "remap_by_hash",
    "page_signals", "paper_status_rollup", "parse_eval_metrics",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


def values(df: pd.DataFrame):
    return sorted(tuple(str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    ours = entry.queries()[name](spark, ROOT).toPandas()
    theirs = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_single_rows_are_of_every_line(spark):
    from leafgrain.plans.corpus import Corpus

    out = entry.queries()["split_single_row"](spark, ROOT)
    lines = Corpus(spark, ROOT).lines.select("doc_id", "pos")
    assert out.columns[:2] == ["doc_id", "pos"]
    assert out.select("doc_id", "pos").distinct().count() == lines.distinct().count()
