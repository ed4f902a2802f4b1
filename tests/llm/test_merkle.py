"""Merkle manifest against a plain build of the same trees."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest
from frames import DOCS, awkward_docs
from pyspark.sql import functions as F

from leafgrain.llm import merkle

ROW = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    values = list(row)
    if lower and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = [sorted(groups[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [tree([leaf(r) for r in rs]) for rs in ordered]
    top = tree([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, (rs, levels) in enumerate(zip(ordered, trees)):
        for i, row in enumerate(rs):
            digest = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            proof = ""
            for up, at in ((levels, i), (top, k)):
                for nodes in up[:-1]:
                    first = at // 8 * 8
                    a, b = "".join(nodes[first:at]), "".join(nodes[at + 1:first + 8])
                    proof, digest, at = proof + a + b, sha(a + digest + b), at // 8
            root = top[-1][0]
            out.append((row[0], levels[0][i], levels[-1][0], root, sha(proof), digest, digest == root))
    return sorted(out, key=str)


def ours(df):
    return sorted(map(tuple, merkle.manifest(df, merkle.one_in_three(F.col("doc_id"))).collect()), key=str)


BIG = 2**60 + 1
ODD = [
    (None, None, None, None, None), (None, "s", "", 1, "A"), (BIG, "s", None, 3, "ÄBC"), (5, "s", None, 3, "ÄBC"), (5, "s", None, 3, "ÄBC"), (5, "s", None, 4, "x"),
    *[(i, "s", f"l{i % 70}", i, "T" * i) for i in range(200)], *[(i, None, "hot", i, f"Aé {i}") for i in range(700)], *[(7, "s", "hot", 1, "same")] * 30,
]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equals_a_plain_build(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # small superblocks: several tiers of them
    monkeypatch.setattr(merkle, "SPAN", 8 ** levels)
    assert ours(spark.createDataFrame(ODD, ROW).repartition(5)) == plain(ODD)


def test_sql_equals_a_plain_build():
    con = duckdb.connect()
    con.register("documents", pa.table({f.split()[0]: [r[i] for r in ODD] for i, f in enumerate(ROW.split(", "))}))
    assert sorted(con.execute(merkle.SQL).fetchall(), key=str) == plain(ODD)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "A")], [(1, "s", "en", 1, "A")] * 9])
def test_small_tables(spark, rows):
    assert ours(spark.createDataFrame(rows, ROW)) == plain(rows)


def test_awkward_rows_and_proofs(spark):
    docs, rows = awkward_docs(spark)
    assert DOCS.startswith("doc_id")
    assert ours(docs) == plain([(i, None, None, None, t) for i, t in rows])
    for row in merkle.manifest(docs, with_siblings=True).collect():
        assert row.verified and merkle.fold(row.leaf, row.left, row.right) == row.root
        assert row.root == row.folded_root and sha("".join(a + b for a, b in zip(row.left, row.right))) == row.proof_sha256
