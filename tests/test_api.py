"""The engine over tables written and read back."""

import tempfile

from pyspark.sql import functions as F

from leafgrain import schemas as sc
from leafgrain.api import Engine
from leafgrain.sources import tables as tb


def test_engine_over_stored_tables(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = {name: spark.createDataFrame([], schema) for name, schema in sc.TABLE_SCHEMAS.items()}

    def fill(name, *values):
        columns = sc.TABLE_SCHEMAS[name].fieldNames()
        rows[name] = spark.createDataFrame([tuple(v.get(c) for c in columns) for v in values], sc.TABLE_SCHEMAS[name])

    fill("spaces", {"id": "s", "status": "active"}, {"id": "t", "status": "archived"})
    fill("app_state", {"key": "active_space", "value": "s"})
    fill("papers", {"id": "p", "space_id": "s", "title": "On graphs"})
    fill("passages", {"id": "a", "paper_id": "p", "space_id": "s", "section": "", "original_text": "graph methods", "quality_flags": []})
    fill("knowledge_cards", {
        "id": "c", "space_id": "s", "paper_id": "p", "card_type": "Method", "source_passage_id": "a",
        "evidence": {"source_passage_ids": ["a", "ghost"]},
    })
    for name, df in rows.items():
        tb.save_table(df, root, name)
    engine = Engine.open(spark, root)
    asked = spark.createDataFrame([(1, "s", "graph", "fts")], "query_id bigint, space_id string, query string, mode string")
    assert [r["passage_id"] for r in engine.search(asked).collect()] == ["a"]
    assert [r["id"] for r in engine.compare_with_literature(asked).collect()] == ["c"]
    card = engine.card_view("methods").first()
    assert card["source_passage_ids"] == ["a"] and card["paper_title"] == "On graphs"
    assert engine.scoped("passages").count() == 1 and engine.scoped("passages", "t").count() == 0
    engine.register_views()
    assert spark.sql("select count(*) from papers").first()[0] == 1
    assert engine.paper_summary().select(F.sum("card_count")).first()[0] == 1


def test_engine_over_stored_indexes(spark, tmp_path):
    from datetime import datetime

    rows = {name: spark.createDataFrame([], schema) for name, schema in sc.TABLE_SCHEMAS.items()}

    def fill(name, *values):
        columns = sc.TABLE_SCHEMAS[name].fieldNames()
        rows[name] = spark.createDataFrame([tuple(v.get(c) for c in columns) for v in values], sc.TABLE_SCHEMAS[name])

    texts = ["graph methods", "graph of graphs", "methods only", "nothing"]
    fill("passages", *[{"id": f"p{i}", "paper_id": "p", "space_id": "s", "section": "", "original_text": t} for i, t in enumerate(texts)])
    fill("passage_embeddings", *[
        {"passage_id": f"p{i}", "provider": "l", "model": "m", "dimension": 2, "embedding": [1.0, float(i)], "created_at": datetime(2024, 1, 1)} for i in range(4)])
    asked = spark.createDataFrame([(1, "s", "graph methods", "fts"), (2, "s", "graph", "auto"), (3, "s", "zzz", "hybrid")], "query_id bigint, space_id string, query string, mode string")
    vectors = spark.createDataFrame([(i, "s", "l", "m", [1.0, 2.0]) for i in (1, 2, 3)], "query_id bigint, space_id string, provider string, model string, vector array<float>")
    plain, indexed = Engine.of(spark, rows), Engine.of(spark, rows)
    indexed.store_indexes(str(tmp_path))
    for name, df in rows.items():
        tb.save_table(df, str(tmp_path / "tables"), name)
    opened = Engine.open(spark, str(tmp_path / "tables"), index=str(tmp_path))
    for given in ((asked, None), (asked, vectors)):
        want = sorted(map(str, plain.search(*given).select("query_id", "passage_id", "rank").collect()))
        assert want and all(sorted(map(str, e.search(*given).select("query_id", "passage_id", "rank").collect())) == want for e in (indexed, opened))


def test_engine_replaces_cards_by_extracted_ones(spark, tmp_path):
    import json

    rows = {name: spark.createDataFrame([], schema) for name, schema in sc.TABLE_SCHEMAS.items()}

    def fill(name, *values):
        columns = sc.TABLE_SCHEMAS[name].fieldNames()
        rows[name] = spark.createDataFrame([tuple(v.get(c) for c in columns) for v in values], sc.TABLE_SCHEMAS[name])

    def extract(batch):
        lines = [json.loads(line) for line in batch["sources"].split("\n")]
        return [{"card_type": "Method", "summary": x["text"], "source_passage_ids": [x["source_id"]], "evidence_quote": x["text"],
                 "reasoning_summary": "quoted", "confidence": 0.9} for x in lines]

    fill("papers", *[{"id": p, "space_id": "s", "title": p, "parse_status": "parsed" if p == "p" else "pending"} for p in "pq"])
    fill("passages", *[{"id": f"{p}0", "paper_id": p, "space_id": "s", "section": "Method", "page_number": 1, "paragraph_index": 0,
                        "original_text": f"The method of {p} compares graphs by their spectra.", "heading_path": ["Method"], "passage_type": "method",
                        "quality_flags": []} for p in "pq"])
    old = {"space_id": "s", "paper_id": "p", "card_type": "Method", "evidence": {"source_passage_ids": ["p0"]}}
    fill("knowledge_cards", {**old, "id": "old", "created_by": "ai", "user_edited": False}, {**old, "id": "mine", "created_by": "user"},
         {**old, "id": "kept", "paper_id": "q", "created_by": "ai", "user_edited": False})
    engine = Engine.of(spark, rows)
    found = engine.analyse(extract, str(tmp_path), "run-1", F.lit("2024-01-01").cast("timestamp"), waves=1, tasks=1)
    assert [(r["paper_id"], r["status"]) for r in found.outcomes.collect()] == [("p", "completed")]
    cards = {r["id"]: r for r in engine.cards.collect()}
    new = set(cards) - {"mine", "kept"}
    assert len(new) == 1 and "old" not in cards
    card = cards[new.pop()]
    assert card["source_passage_ids"] == ["p0"] and card["analysis_run_id"] == "run-1" and card["created_by"] == "ai"
    assert [r["passage_id"] for r in engine.tables["knowledge_card_sources"].collect()] == ["p0"]
    assert {r["id"] for r in engine.card_view("methods").collect()} == set(cards)


def test_engine_lists_edits_and_adds_in_the_active_space(spark):
    from datetime import datetime

    rows = {name: spark.createDataFrame([], schema) for name, schema in sc.TABLE_SCHEMAS.items()}

    def fill(name, *values):
        columns = sc.TABLE_SCHEMAS[name].fieldNames()
        rows[name] = spark.createDataFrame([tuple(v.get(c) for c in columns) for v in values], sc.TABLE_SCHEMAS[name])

    fill("spaces", {"id": "s", "status": "active"}, {"id": "t", "status": "active"})
    fill("app_state", {"key": "active_space", "value": "s"})
    fill("papers", *[{"id": p, "space_id": sp, "title": f"old {p}", "year": 2000, "imported_at": datetime(2024, 1, d)} for p, sp, d in (("p", "s", 1), ("q", "s", 2), ("r", "t", 3))])
    fill("passages", *[{"id": f"{p}0", "paper_id": p, "space_id": sp, "section": "", "original_text": "graph", "quality_flags": []} for p, sp in (("p", "s"), ("r", "t"))])
    fill("document_elements", *[{"id": f"e{i}", "paper_id": "p", "space_id": "s", "element_index": i, "element_type": "heading" if i % 2 else "paragraph", "page_number": i // 2} for i in range(6)])
    fill("analysis_runs", *[{"id": f"r{i}", "paper_id": "p", "space_id": "s", "started_at": datetime(2024, 1, 1 + i)} for i in range(2)], {"id": "x", "paper_id": "r", "space_id": "t"})
    fill("knowledge_cards", *[{"id": f"c{i}", "space_id": "s", "paper_id": "p", "card_type": "Method", "summary": "m", "evidence": {"source_passage_ids": ["p0", "ghost"]}, "created_at": datetime(2024, 1, 1 + i)} for i in range(3)])
    engine = Engine.of(spark, rows)

    def ids(df):
        return [r["id"] for r in df.collect()]

    assert ids(engine.spaces()) == ["s"] and ids(engine.papers()) == ["q", "p"] and ids(engine.papers("t")) == []
    assert sorted(ids(engine.elements(2))) == ["e0", "e1"] and sorted(ids(engine.elements(element_type="heading", page=1))) == ["e3"]
    assert ids(engine.passages()) == ["p0"] and ids(engine.runs()) == ["r1", "r0"] and ids(engine.document_tables()) == []
    newest = engine.newest_cards(2).collect()
    assert sorted(r["id"] for r in newest) == ["c1", "c2"] and all(r["source_passage_ids"] == ["p0"] for r in newest)
    asked = spark.createDataFrame([(1, "s", "graph", "hybrid")], "query_id bigint, space_id string, query string, mode string")
    assert [r["passage_id"] for r in engine.similar_results(asked).collect()] == ["p0"]
    summary = {r["paper_id"]: r for r in engine.paper_summary(with_cards=True).collect()}
    assert [c["id"] for c in summary["p"]["cards"]] == ["c0", "c1", "c2"] and summary["p"]["card_count"] == 3 and summary["q"]["cards"] is None
    assert [x["passage_id"] for x in summary["p"]["cards"][0]["source_passages"]] == ["p0"]

    engine.edit_papers(spark.createDataFrame([("p", "new", 0), ("q", "", 2020), ("r", "stolen", 1)], "id string, title string, year int"))
    assert {r["id"]: (r["title"], r["year"]) for r in engine.tables["papers"].collect()} == {"p": ("new", 2000), "q": ("old q", 2020), "r": ("old r", 2000)}
    rejected = engine.add_cards(spark.createDataFrame(
        [("n1", "p", "Method", "ok", "p0"), ("n2", "p", "Nonsense", "x", ""), ("n3", "r", "Method", "x", ""), ("n4", "q", "Claim", "x", "p0"), ("n5", "q", "Claim", "ok", "")],
        "id string, paper_id string, card_type string, summary string, source_passage_id string"))
    assert sorted(ids(rejected)) == ["n2", "n3", "n4"]
    engine.edit_cards(spark.createDataFrame([("c0", "s", "better", None, 0.5)], "id string, space_id string, summary string, card_type string, confidence double"), F.current_timestamp())
    engine.delete_cards(spark.createDataFrame([("c1", "s")], "id string, space_id string"))
    cards = {r["id"]: r for r in engine.tables["knowledge_cards"].collect()}
    assert sorted(cards) == ["c0", "c2", "n1", "n5"] and cards["c0"]["summary"] == "better" and cards["c0"]["user_edited"]
    assert cards["n1"]["space_id"] == "s" and cards["n1"]["confidence"] == 1.0 and cards["n5"]["source_passage_id"] is None
