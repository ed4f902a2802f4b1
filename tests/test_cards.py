"""Verification, deduplication on skewed copies, metadata and edits."""

import random

from pyspark.sql import functions as F

from leafgrain.operators import cards as cd
from leafgrain.operators import keyed
from leafgrain.operators import metadata as md

CARD = "id string, paper_id string, space_id string, card_type string, summary string, source_passage_ids array<string>, evidence_quote string, reasoning_summary string, confidence double, card_index int"
PASSAGES = "id string, paper_id string, space_id string, original_text string"


def card(i, summary="s", sources=("q1",), quote="q", confidence=0.5, kind="Method", why="w"):
    return (f"c{i}", "p", "s", kind, summary, list(sources), quote, why, confidence, i)


def test_verify_reasons(spark):
    text = "The late results section reports a 14 percent source coverage gain."
    passages = spark.createDataFrame([("q1", "p", "s", text), ("q2", "other", "s", text)], PASSAGES)
    cards = spark.createDataFrame([
        card(0, quote="source coverage improves by 14 percent"),
        card(1, quote="late results section"),
        card(2, sources=("missing-passage",), quote="late results section"),
        card(3, sources=("q1", "q2"), quote="late results section"),
        card(4, quote="nothing of the kind was written"),
        card(5, why=" "), card(6, sources=("q1", "q1"), quote="late"), card(7, confidence=1.5),
    ], CARD)
    got = {r["id"]: r["reason"] for r in cd.verify_cards(cards, passages).collect()}
    assert got == {
        "c0": "", "c1": "", "c2": "missing_source", "c3": "missing_source", "c4": "evidence_mismatch",
        "c5": "invalid_card", "c6": "invalid_card", "c7": "invalid_card",
    }


def brute_dedup(cards, limit):
    def tokens(text):
        return {t for t in text.split() if t not in ("the", "of", "a")}

    order = sorted(cards, key=lambda c: (-round(c[8], 6), -len(set(c[5])), c[9]))
    kept, out = [], {}
    for c in order:
        match = next((k for k in kept if k[3] == c[3] and set(k[5]) & set(c[5]) and tokens(c[4])
                      and len(tokens(k[4]) & tokens(c[4])) / len(tokens(k[4]) | tokens(c[4])) >= 0.75), None)
        if match:
            out[c[0]] = ("duplicate", match[0])
        else:
            kept.append(c)
            out[c[0]] = ("ranked" if len(kept) <= limit else "overflow", None)
    return out


def test_greedy_dedup_matches_brute_force_with_many_copies(spark):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(9)]
    cards = []
    for i in range(220):
        # a third of all cards are copies of one card
        if i % 3 == 0:
            summary, sources = "t0 t1 t2 t3 t4", ("q1",)
        else:
            summary = " ".join(rng.sample(words, rng.randint(1, 7)))
            sources = tuple(rng.sample(["q1", "q2", "q3"], rng.randint(1, 2)))
        cards.append(card(i, summary, sources, confidence=rng.randint(0, 9) / 10, kind=rng.choice(["Method", "Result"])))
    scores = spark.createDataFrame([("p", "s", "nowhere", 1)], "paper_id string, space_id string, passage_id string, score int")
    rows = cd.dedup_rank_cards(spark.createDataFrame(cards, CARD), scores, 6).collect()
    assert {r["id"]: (r["verdict"], r["duplicate_of"]) for r in rows} == brute_dedup(cards, 6)
    ranks = sorted(r["card_rank"] for r in rows if r["card_rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_duplicate_pairs_count_copies(spark):
    cards = spark.createDataFrame([card(i, "t1 t2 t3 t4") for i in range(50)] + [card(99, "t1 t2 t3 t4 t5")], CARD)
    pairs = cd.duplicate_card_pairs(cards).agg(F.sum("pairs")).first()[0]
    assert pairs == 51 * 50 // 2


def test_number_rows_and_carry_last_across_blocks(spark):
    rows = [("k", b, i, (i if i % 7 == 0 else None)) for b in range(5) for i in range(b * 10, b * 10 + 10)]
    df = spark.createDataFrame(rows, "k string, b int, i int, v int")
    got = keyed.number_rows(df, ["k"], "b", [F.col("i")], "n").collect()
    assert all(r["n"] == r["i"] for r in got)
    got = keyed.carry_last(df, ["k"], "b", [F.col("i")], F.col("v"), "last").collect()
    assert all(r["last"] == r["i"] // 7 * 7 for r in got)


def test_promotion_respects_users_and_priorities(spark):
    papers = spark.createDataFrame(
        [("p", "s", "Old", "", None, "10.1/u", "", "", "", {"title": "filename.fallback"}, {"title": 0.1}, ["doi"], "empty")],
        "id string, space_id string, title string, authors string, year int, doi string, arxiv_id string, venue string,"
        " abstract string, metadata_sources map<string,string>, metadata_confidence map<string,double>,"
        " user_edited_fields array<string>, metadata_status string",
    )
    candidates = spark.createDataFrame([
        ("p", "title", "New", "document.title", 0.75, "e1"), ("p", "doi", "10.9/x", "regex.doi", 0.98, ""),
        ("p", "year", "2021", "llm.metadata", 0.6, ""), ("p", "title", "AI", "llm.metadata", 0.6, ""),
    ], "paper_id string, field string, value string, source string, confidence double, source_id string")
    row = md.promote_metadata(papers, candidates).first()
    assert (row["title"], row["doi"], row["year"]) == ("New", "10.1/u", 2021)
    assert row["metadata_sources"] == {"title": "document.title", "year": "llm.metadata"}
    assert sorted(row["promoted"]) == ["title", "year"] and row["metadata_status"] == "user_edited"


def test_replace_keeps_user_cards(spark):
    schema = CARD + ", user_edited boolean, created_by string, source_passage_id string, created_at timestamp"
    now = F.current_timestamp()
    old = spark.createDataFrame([
        (*card(1), False, "ai", "q1", None), (*card(2), True, "ai", "q1", None), (*card(3), False, "user", "q1", None),
    ], schema)
    links = spark.createDataFrame([("l1", "c1", "q1", "p", "s", "q", 0.5, None)], "id string, card_id string, passage_id string, paper_id string, space_id string, evidence_quote string, confidence double, created_at timestamp")
    new = spark.createDataFrame([card(9)], CARD)
    cards, rows = cd.replace_ai_cards(old, links, new, F.lit("run"), now)
    assert sorted(r["id"] for r in cards.collect()) == ["c2", "c3", "c9"]
    assert [r["card_id"] for r in rows.collect()] == ["c9"]


def test_quotes_of_any_script_and_length_are_found(spark):
    texts = ["a category of its own", "он сказал: привет, мир", "他说你好，世界再见", "of the and", "x'a'b'c d", "see (cat)", "--- *** ---"]
    asked = ["cat", "привет", "привет, мир", "你好", "你好，世界", "of the", "", "a'b'c d", "(cat)", "***", "gory", "dog", "мир!", "再见你", "f the a"]
    quotes = spark.createDataFrame(list(enumerate(asked)), "item int, quote string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.item: r.quoted for r in cd.quoted_anywhere(quotes, "item", frame, "doc_id").collect()}
    assert out == {i: any(q in t for t in texts) for i, q in enumerate(asked)}
    none = cd.quoted_anywhere(quotes, "item", frame.limit(0), "doc_id")
    assert none.count() == len(asked) and not none.filter("quoted").count()


def test_prompt_payloads_are_whole_unless_limited(spark):
    import json

    from leafgrain.operators import analysis as an

    text = "word " * 1999 + "end"
    prepared = spark.createDataFrame(
        [("q1", "p", "s", 0, 1, "Sec", ["Sec"], text), ("q2", "p", "s", 0, 1, "Sec", ["Sec"], "short")],
        "id string, paper_id string, space_id string, fragment_index int, page_number int, section string, heading_path array<string>, text string",
    )
    batches = spark.createDataFrame(
        [("p", "s", 0, ["q1"], [("q1", 0)]), ("p", "s", 1, ["q2"], [("q2", 0)])],
        "paper_id string, space_id string, batch_index int, source_passage_ids array<string>, members array<struct<id: string, fragment_index: int>>",
    )
    for limit, first in ((None, text), (3000, text[:3000].rstrip() + "... [truncated]")):
        rows = {r.batch_index: r for r in an.render_prompt_payload(batches, prepared, limit=limit).collect()}
        assert json.loads(rows[0].sources)["text"] == first and json.loads(rows[1].sources)["text"] == "short"
        assert (rows[0].was_cut, rows[1].was_cut) == (limit is not None, False)

def test_short_quotes_are_found_by_pieces(spark):
    rng = random.Random(5)
    alphabet = "abc é中文字😀-'"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    asked = ["", "a", "😀", "中文", "😀😀", "c😀b", *("".join(rng.choice(alphabet.replace(" ", "")) for _ in range(rng.randrange(1, 7))) for _ in range(150))]
    asked += [t[i:i + 5] for t in texts for i in (3, 17)]
    asked = sorted(set(asked))
    quotes = spark.createDataFrame([(q,) for q in asked], "quote string")
    frame = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    got = [r.quote for r in cd.quoted_by_grams(quotes, frame, "doc_id").collect()]
    assert sorted(got) == [q for q in asked if any(q in t for t in texts)] and len(got) < len(asked)
    assert not cd.quoted_by_grams(quotes, frame.filter("text is null"), "doc_id").count()
    plan = cd.quoted_anywhere(quotes.withColumn("item", F.col("quote")), "item", frame, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
