"""A class of vectors is sent to each block of lists once, and blocks meet once."""

import numpy as np
from pyspark.sql import functions as F

from leafgrain.llm import near_vectors as nv

VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_a_class_is_sent_once_to_each_block(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.standard_normal((1500, 8)).astype(np.float32)
    close = base[:200] + 0.02 * r.standard_normal((200, 8)).astype(np.float32)
    x = np.concatenate([base, close, base[:1] + 0.01 * r.standard_normal((700, 8)).astype(np.float32)])
    rows = [(i, v.tolist(), int(i % 5 == 4)) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, VECTORS)
    monkeypatch.setattr(nv, "ROOM", 0)  # blocks of nv.BLOCK classes
    seen = []
    whole = nv.block_pairs
    monkeypatch.setattr(nv, "block_pairs", lambda classes: seen.append(whole(classes)) or seen[-1])
    out = {row["vec_id"]: row["n_links"] for row in nv.near_vectors(vectors).collect()}
    asked, held = seen[0]
    assert asked.groupBy("cls", "j").count().where("count > 1").count() == held.groupBy("cls", "i").count().where("count > 1").count() == 0
    assert asked.where("i > j").count() == held.where("i > j").count() == 0
    blocks = asked.agg(F.max("j")).first()[0] + 1
    assert blocks > 2 and asked.count() <= len(x) * blocks
    assert held.groupBy("label", "i", "j").count().agg(F.max("count")).first()[0] <= 2 * nv.BLOCK  # a long list is cut
    u = nv.unit(x.astype(float))
    label = np.array([row[2] for row in rows])
    linked = (u @ u.T >= 0.98) & (label[:, None] == label)
    assert [out[i] for i in range(len(x))] == (linked.sum(1) - 1).tolist()
