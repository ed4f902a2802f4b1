"""What the extractor loop stores and deals: texts once, tokens never."""


from leafgrain.operators import analysis as an
from leafgrain.operators import cards as cd
from leafgrain.operators import extraction as ex
from leafgrain.plans.corpus import Corpus

ROOT = "/root/testdata/sf0.001"
CARDS = "id string, paper_id string, space_id string, source_passage_ids array<string>, evidence_quote string"
PASSAGES = "id string, paper_id string, space_id string, original_text string"


def test_prepared_passages_hold_a_text_once(spark, tmp_path):
    passages = Corpus(spark, ROOT).passages.filter("paper_id = 'doc-1'")
    prepared = ex.prepared_once(passages, str(tmp_path), 400)
    assert "original_text" not in prepared.columns and "content_hash" not in prepared.columns
    whole = an.prepared_passages(passages, 400)
    rows = lambda df: sorted(map(str, an.analysis_batches(df, 400).collect()))
    assert rows(prepared) == rows(whole) != []


def test_quotes_are_judged_where_their_texts_are(spark):
    long = "alpha beta gamma delta epsilon zeta"
    passages = spark.createDataFrame([("a", "p", "s", long), ("b", "p", "s", " "), ("c", "q", "s", long), ("d", "p", "s", None)], PASSAGES)
    cards = spark.createDataFrame([
        ("1", "p", "s", ["a"], "beta gamma"), ("2", "p", "s", ["b", "a", "x"], "zeta epsilon delta gamma beta alpha"), ("3", "p", "s", ["c"], long),
        ("4", "p", "s", ["a", "a"], "nothing of the kind"), ("5", "p", "s", ["a", "d"], None), ("6", "p", "s", ["a"], ""),
    ], CARDS)
    support = cd.cited_support(cards, passages)
    assert {r["id"]: (r["missing_ids"], r["supported"]) for r in support.collect()} == {
        "1": ([], True), "2": (["b", "x"], True), "3": (["c"], False), "4": ([], False), "5": (["d"], False), "6": ([], False)}
    plan = support._jdf.queryExecution().optimizedPlan().toString()
    # The only join is of quotes with texts; what is grouped by card has neither texts nor tokens.
    assert plan.count("Join LeftOuter") == 1 and plan.count("Join Inner") == 0
