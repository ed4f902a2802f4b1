"""Line, document and vector deduplication against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from frames import DOCS, Union, awkward_docs, prose, words_of

from leafgrain.llm import line_dedup, near_dup, near_vectors
from leafgrain.llm.graph import components

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_lines(rows, lines=3, words=50):
    """Deleted line numbers of each distinct (doc_id, text)."""
    seen, gone = set(), {}
    for doc_id, text in sorted(set((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        own = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(text.split("\n"))]
        own = [(k, x) for k, x in own if x]
        out = gone.setdefault((doc_id, text), set())
        for i in range(len(own)):
            run = []
            for k, x in own[i:i + lines]:
                run.append((k, x))
                if len(run) == lines or sum(len(words_of(y)) for _, y in run) >= words:
                    content = tuple(y for _, y in run)
                    if content in seen:
                        out.update(range(run[0][0], run[-1][0] + 1))
                    seen.add(content)
                    break
    return gone


def test_lines_against_brute_force(spark):
    r = random.Random(4)
    stock = [prose(i, r.choice((1, 4, 12, 55))) for i in range(40)] + ["", "  ", "\t"]
    shared = [[r.choice(stock) for _ in range(r.randrange(2, 7))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = [r.choice(stock) for _ in range(r.randrange(4))] + (r.choice(shared) if r.random() < 0.5 else []) + [r.choice(stock) + r.choice(("", " ", "\r"))]
        rows.append((i, "\n".join(text)))
    rows += [(200, None), (201, ""), (None, rows[3][1]), rows[5], rows[5]]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "7 as _spans", "8 as _id", "9 as _hash").repartition(3)
    out = line_dedup.dedup_lines(docs, removed_as="n_removed").toPandas()
    gone = brute_lines(rows)
    got = {(None if np.isnan(x.doc_id) else int(x.doc_id), x.n_removed, x.text) for x in out.itertuples()}
    expected = {(i, 0, None) if t is None else (i, len(gone[i, t]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in rows}
    assert len(out) == len(rows) and (out._spans == 7).all() and got == expected
    assert sum(n > 0 for _, n, _ in got) > 30 and line_dedup.dedup_lines(docs).columns == docs.columns


def test_lines_sql_twin(spark):
    root = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{root}/documents.parquet'")
    theirs = sorted(db.execute(line_dedup.SQL).fetchall())
    ours = line_dedup.dedup_lines(spark.read.parquet(f"{root}/documents.parquet"), removed_as="n_removed").select("doc_id", "text", "n_removed").collect()
    assert sorted(map(tuple, ours)) == theirs


def test_line_plan_is_native(spark):
    docs, _ = awkward_docs(spark)
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_near(rows, size, percent=80):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    union = Union()
    for i in range(len(rows)):
        union.find(i)
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                union.join(i, j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if union.find(j) == union.find(i) and r[0] is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size):
    r = random.Random(size)
    rows = [(i, t) for i, t in awkward_docs(spark)[1] if i != 9]
    for family in range(8):
        base = prose(100 + family, r.choice((6, 25, 80, 300))).split(" ")
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 20)):
                w[r.randrange(len(w))] = f"n{r.randrange(9999)}"
            rows.append((len(rows) + 50, " ".join(w)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "1 as digest", "2 as cls", "3 as root").repartition(4)
    out = near_dup.near_duplicates(docs, near_dup.Shape(words=size)).collect()
    assert sorted((tuple(x) for x in out), key=str) == brute_near(rows, size)


def test_members_of_a_bucket_meet_without_its_centre(spark):
    """A long chain of edits: neighbours are similar, the ends are not."""
    words = prose(7, 300).split(" ")
    rows = []
    for step in range(60):
        rows.append((step, " ".join(words)))
        for k in range(8):
            words[(step * 8 + k) * 7 % 300] = f"e{step}x{k}"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    out = near_dup.near_duplicates(docs, near_dup.Shape(words=2)).collect()
    assert sorted((tuple(x) for x in out), key=str) == brute_near(rows, 2)


def test_estimates_are_close():
    r = np.random.default_rng(2)
    shape = near_dup.Shape()
    sketcher = near_dup.Sketcher(shape.registers)
    errors = []
    for _ in range(60):
        both, own = r.integers(0, 2 ** 64, 800, dtype=np.uint64), r.integers(0, 2 ** 64, (2, 100), dtype=np.uint64)
        a, b = (sketcher.registers(np.unique(np.append(both, x))) for x in own)
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert near_dup.may_be_similar(np.array([160, 20]), np.array([500.0, 500]), np.array([500.0, 500]), shape).tolist() == [True, False]


def test_components_of_stars_and_chains(spark):
    r = random.Random(1)
    links = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(60)] + [(7, 7)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    union = Union()
    for a, b in links:
        union.join(a, b)
    out = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    ends = {v for a, b in links if a != b for v in (a, b)}
    assert set(out) == ends
    assert len({(out[v], union.find(v)) for v in ends}) == len({out[v] for v in ends}) == len({union.find(v) for v in ends})


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(40):
            base = r.standard_normal(16)
            for _ in range(r.integers(1, 7)):
                rows.append((len(rows), (base + r.standard_normal(16) * r.choice([0.02, 0.12, 0.3])).astype(np.float32).tolist(), label))
    centre = r.standard_normal(16)
    rows += [(len(rows) + i, (centre + 0.05 * r.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(700)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(5)] + [(6000, [2 * x for x in rows[0][1]], 0), (6001, None, 0), (6002, [0.0] * 16, 0), (6003, [math.nan] * 16, 0), (6004, [math.inf] + [1.0] * 15, 0),
             (6005, [None] + [1.0] * 15, 0), (6006, [], 0), (6007, [1.0] * 5, 0), (None, rows[0][1], 0), (6008, [1e-30] * 16, 0), (6009, [1e30] * 16, 0)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as cls", "2 as root", "3 as data").repartition(3)
    out = near_vectors.near_vectors(frame).collect()
    good = [i for i, v, l in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v) and l is not None]
    index = [k for k, (i, v, l) in enumerate(rows) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v) and l is not None]
    x = np.array([rows[k][1] for k in index])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([rows[k][2] for k in index])
    linked = (x @ x.T >= 0.98) & (same[:, None] == same)
    np.fill_diagonal(linked, False)
    union, n = Union(), dict.fromkeys(range(len(rows)), 0)
    for a, k in enumerate(index):
        n[k] = int(linked[a].sum())
        for b in np.flatnonzero(linked[a]):
            union.join(k, index[b])
    expected = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if union.find(m) == union.find(k) and rows[m][0] is not None]
        expected.append((i, n[k], min(ids) if ids else None, i == (min(ids) if ids else None)))
    assert len(good) > 700 and sorted(map(tuple, out), key=str) == sorted(expected, key=str)
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def test_probes_reach_every_neighbour():
    r = np.random.default_rng(4)
    x = near_vectors.unit(r.standard_normal((3000, 64)))
    coder, reach = near_vectors.Quantizer.fit(x), float(np.sqrt(0.04))
    step = r.standard_normal((3000, 64))
    y = near_vectors.unit(x + 0.19 * step / np.linalg.norm(step, axis=1, keepdims=True))
    home = coder.encode(y, reach)[0]
    probes = coder.encode(x, reach)[3]
    near = (x * y).sum(1) >= 0.98
    assert near.all() and all(h in p for h, p in zip(home, probes))
    _, codes, error, _ = coder.encode(y, reach)
    for c in range(3):
        at = np.flatnonzero(home == c)
        d = coder.table_distances(x[at], c, codes[at])
        true = np.sqrt(((x[at][:, None] - y[at]) ** 2).sum(2))
        assert (d - error[at] <= true + 1e-6).all()


def test_every_length_is_compared(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(4).astype("float32").tolist(), 1) for i in range(30)]
    rows += [(40, [1.0, 2.0], 1), (41, [1.0, 2.0], 1), (42, [1.0, 2.001], 1), (43, [1.0, 2.0, 0.0], 1), (44, [3.0], 1), (45, [5.0], 1), (46, [-5.0], 1), (47, [1.0, 2.0], 2)]
    frame = spark.createDataFrame(rows, VECTORS)
    for given in (None, {}, {4: near_vectors.Quantizer.plain(4)}):
        found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(frame, 0.98, given).collect()}
        assert [found[i] for i in range(40, 48)] == [(2, 40), (2, 40), (2, 40), (0, 43), (1, 44), (1, 44), (0, 46), (0, 47)]
