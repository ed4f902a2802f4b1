"""Chunker: boundaries, budget, overlap, tables, identity, stability."""

import hashlib
import json

from leafgrain import schemas as sc
from leafgrain.operators import chunking as ck


def element(i, text, heading=("Intro",), kind="paragraph", page=1):
    return (f"e{i}", "p1", "s1", i, kind, text, page, [0.0, float(i), 10.0, i + 1.0], list(heading))


ELEMENTS = "id string, paper_id string, space_id string, element_index int, element_type string, text string, page_number int, bbox array<double>, heading_path array<string>"
TABLES = "id string, paper_id string, element_id string, page_number int, caption string, cells array<array<string>>, header_rows int, bbox array<double>"


def run(spark, elements, tables=(), **limits):
    e = spark.createDataFrame(elements, ELEMENTS)
    t = spark.createDataFrame(list(tables), TABLES)
    return ck.chunk_documents(e, t, **limits).orderBy("paragraph_index").collect()


def test_soft_limit_and_heading_boundaries(spark):
    words = "word " * 30
    rows = run(spark, [element(0, words), element(1, words), element(2, words, ("Method",))], max_tokens=90, soft_tokens=70)
    assert [r["element_ids"] for r in rows] == [["e0"], ["e1"], ["e2"]]
    assert rows[2]["passage_type"] == "method" and rows[0]["section"] == "Intro"
    # between soft and max: one element stays whole
    rows = run(spark, [element(0, "word " * 64)], max_tokens=90, soft_tokens=70)
    assert len(rows) == 1 and rows[0]["split_source"] == ""


def test_overlap_is_provenance_under_the_same_heading(spark):
    rows = run(
        spark,
        [element(0, "alpha " * 20), element(1, "beta " * 20, ("Other",)), element(2, "gamma " * 20)],
        max_tokens=60, soft_tokens=40, overlap_tokens=10,
    )
    assert rows[0]["overlap_element_ids"] is None and rows[1]["overlap_element_ids"] is None
    assert rows[2]["overlap_element_ids"] == ["e0"]
    assert "alpha" not in rows[2]["original_text"]


def test_references_and_furniture_are_left_out(spark):
    rows = run(spark, [
        element(0, "body text"), element(1, "a citation", ("References",)), element(2, "p. 1", kind="page_footer"),
        element(3, "ref", kind="reference"),
    ])
    assert [r["original_text"] for r in rows] == ["body text"]


def test_table_stands_alone_and_splits(spark):
    cells = [["System", "Recall"]] + [[f"model {i}", f"0.{i}"] for i in range(4)]
    table = ("t1", "p1", "e1", 2, "Scores", cells, 1, None)
    elements = [element(0, "before"), element(1, "x", kind="table"), element(2, "after")]
    rows = run(spark, elements, [table])
    assert [r["element_ids"] for r in rows] == [["e0"], ["e1"], ["e2"]]
    assert rows[1]["original_text"].startswith("Scores System | Recall model 0 | 0.0")
    assert rows[1]["table_id"] == "t1" and rows[1]["page_number"] == 2
    small = run(spark, elements, [table], max_tokens=12, soft_tokens=12)
    pieces = [r for r in small if r["table_id"]]
    assert len(pieces) > 1 and all("System | Recall" in r["original_text"] for r in pieces)


def test_oversize_text_is_split_within_budget(spark):
    rows = run(spark, [element(0, "n" * 700)], max_tokens=50, soft_tokens=40)
    assert len(rows) == 4 and all(r["token_count"] <= 50 for r in rows)
    assert "".join(r["original_text"] for r in rows) == "n" * 700
    assert [r["split_index"] for r in rows] == [0, 1, 2, 3]


def test_identity_matches_canonical_json(spark):
    row = run(spark, [element(0, 'Quote " / é 网', ("A  b",))])[0]
    payload = {"text": 'Quote " / é 网', "heading_path": ["A b"], "page_range": [1, 1], "element_ids": ["e0"]}
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert row["content_hash"] == digest and row["id"] == f"passage-{digest[:16]}-0000"


def test_empty_tables_schema(spark):
    assert sc.TABLE_SCHEMAS["passages"].fieldNames()[0] == "id"
