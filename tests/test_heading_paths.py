"""Heading paths by window scans against a stack kept row by row."""

import random

import pytest

from leafgrain.operators import layout as ly

SCHEMA = "paper_id string, element_index int, element_type string, text string, level int"


def by_stack(rows, missing):
    paths, current = {}, {}
    for paper, index, kind, text, level in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        path = current.get(paper, [])
        paths[paper, index] = path
        if kind == "heading" and text != "":
            n = max(level, 1) if level is not None else 1 if missing == "root" else len(path) + 1
            current[paper] = [*path[:n - 1], text]
    return paths


@pytest.mark.parametrize("missing", ["root", "deeper"])
def test_paths_equal_a_stack(spark, missing):
    pick = random.Random(7)
    rows = [
        (paper, i, pick.choice(["heading", "paragraph", None]), pick.choice(["", None, f"t{i}", "same"]), pick.choice([None, -1, 0, 1, 2, 3, 4, 7]))
        for paper in ("a", "b", None) for i in range(120)
    ] + [("none", 0, "paragraph", "x", None), ("flat", 0, "heading", "only", 3)]
    out = ly.heading_path_stack(spark.createDataFrame(rows, SCHEMA), missing).collect()
    assert {(r["paper_id"], r["element_index"]): r["heading_path"] for r in out} == by_stack(rows, missing)
    assert len(out) == len(rows)
    assert ly.heading_path_stack(spark.createDataFrame([], SCHEMA), missing).count() == 0


def test_one_long_paper(spark):
    rows = [("p", i, "heading", f"h{i}", 1 + i % 6) for i in range(30_000)]
    out = ly.heading_path_stack(spark.createDataFrame(rows, SCHEMA)).filter("element_index >= 29990").collect()
    want = by_stack(rows, "root")
    assert all(r["heading_path"] == want["p", r["element_index"]] for r in out) and len(out) == 10
