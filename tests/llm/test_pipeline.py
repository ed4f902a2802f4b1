"""The stages against what their operators say, on the smallest tables."""

import corpus_pipeline as pipeline
from frames import DOCS, awkward_docs, prose

from leafgrain.llm import near_dup, quality, toxicity
from leafgrain.llm.common import materialize, table

ROOT = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = table(spark, ROOT, "documents")
    labels = table(spark, ROOT, "labels")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], ROOT), name))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:5])
    verdict = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert ids[1] == {r.doc_id for r in verdict.where("kept").collect()} < ids[0]
    assert ids[2] == {r.doc_id for r in toxicity.score_toxicity(kept[1], toxicity.fit_toxicity(kept[1], labels)).where("predicted = 0").collect()} <= ids[1]
    assert ids[3] == ids[2] and kept[3].where("n_chars <> char_length(text)").count() == 0
    assert ids[4] == {r.doc_id for r in near_dup.near_duplicates(kept[3]).where("kept").collect()}
    assert ids[5] == ids[4]
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "near_duplicates", "packing"]


def test_awkward_rows_and_empty_tables_pass(spark):
    docs = awkward_docs(spark)[0].select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, spark.createDataFrame([], DOCS)):
        for name, stage in pipeline.STAGES:
            frame = materialize(stage(spark, frame, ROOT), name)
        assert frame.count() >= 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_only_copy_of_a_text_stays(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(3, a), (5, a), (5, b), (6, None), (None, a), (None, b + " tail"), (None, prose(3, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [tuple(r) for r in pipeline.near_duplicates(spark, docs, ROOT).collect()]
    assert sorted(out, key=str) == sorted([(3, a), (5, b), (6, None), (None, prose(3, 60))], key=str)
    assert pipeline.repeated_lines(spark, docs, ROOT).columns == ["doc_id", "text"]
