"""Cards: contracts, verification against cited passages, ranking, edits and views.

A card row: id, paper_id, space_id, card_type, summary, source_passage_ids,
evidence_quote, reasoning_summary, confidence, card_index (input order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.functions import text as tx
from leafgrain.operators.keyed import cut_lineage, number_rows, store_rows, top_k
from leafgrain.schemas import CARD_TYPES, FINAL_CARDS

KEYS = ["paper_id", "space_id"]
THRESHOLD, MIN_TOKENS = 0.8, 3
SIMILAR = 0.75
# Summary fields and the card each becomes.
UNDERSTANDING_CARDS = (
    ("problem", "Problem"), ("method", "Method"), ("results", "Result"),
    ("conclusion", "Interpretation"), ("limitations", "Limitation"),
)


def _blank(value: Column) -> Column:
    return F.coalesce(tx.strip(value), F.lit("")) == ""


def card_errors() -> Column:
    """Broken contract rules of a card, empty when it is valid."""
    ids = F.coalesce("source_passage_ids", F.array().cast("array<string>"))
    stripped = F.transform(ids, lambda i: tx.strip(i))
    level = F.col("confidence")
    return F.filter(
        F.array(
            F.when(~F.coalesce(F.col("card_type").isin(*CARD_TYPES), F.lit(False)), "card_type"),
            F.when(_blank(F.col("summary")), "summary"),
            F.when(
                (F.size(ids) == 0) | F.exists(stripped, lambda i: i == "")
                | (F.size(F.array_distinct(stripped)) < F.size(stripped)),
                "source_passage_ids",
            ),
            F.when(_blank(F.col("evidence_quote")), "evidence_quote"),
            F.when(~F.coalesce((level >= 0) & (level <= 1), F.lit(False)), "confidence"),
            F.when(_blank(F.col("reasoning_summary")), "reasoning_summary"),
        ),
        lambda e: e.isNotNull(),
    )


def validate_cards(cards: DataFrame) -> DataFrame:
    return cards.withColumn("errors", card_errors())


def stripped_sources(cards: DataFrame) -> DataFrame:
    """Cards whose cited ids have no white space around them, as the card contract reads them."""
    return cards.withColumn("source_passage_ids", F.transform("source_passage_ids", tx.strip))


def validate_card_batches(batches: DataFrame, cards: DataFrame) -> DataFrame:
    """Batches with a ``valid`` flag: own sources present and unique, cards cite only those.

    ``batches``: paper_id, space_id, batch_index, source_passage_ids. Cards carry
    their batch_index.
    """
    keys = [*KEYS, "batch_index"]
    own = batches.select(*keys, F.col("source_passage_ids").alias("_own"))
    outside = stripped_sources(cards).join(own, keys).groupBy(*keys).agg(
        F.count_if(
            (F.size(F.array_except("source_passage_ids", "_own")) > 0) | (F.size(card_errors()) > 0)
        ).alias("_bad")
    )
    ids = F.col("source_passage_ids")
    sound = (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return batches.join(outside, keys, "left").withColumn(
        "valid", sound & (F.coalesce("_bad", F.lit(0)) == 0)
    ).drop("_bad")


def evidence_supported(
    quote: Column, quote_tokens: Column, text: Column, text_tokens: Column,
    threshold: float = THRESHOLD,
) -> Column:
    """Support of a normalized quote by a normalized text.

    A substring, or enough content tokens of the quote (with repeats) in the text.
    """
    matched = F.size(F.filter(quote_tokens, lambda t: F.array_contains(text_tokens, t)))
    overlap = (
        (F.size(quote_tokens) >= MIN_TOKENS) & (matched >= MIN_TOKENS)
        & (matched / F.size(quote_tokens) >= threshold)
    )
    return (quote != "") & (text != "") & (text.contains(quote) | overlap)


def cited_support(cards: DataFrame, passages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Missing ids and support of each card (keyed by id): one row per card.

    Only cited passages are normalized, once each, before they meet the cards. A quote goes to the passages it cites and is
    judged there, so a text is dealt once and only verdicts go back to the cards. Tokens are made where they are compared,
    and only for quotes that do not stand in the text.
    """
    quotes = cards.select("id", *KEYS, "source_passage_ids", tx.once(tx.evidence_norm(F.col("evidence_quote"))).alias("quote"))
    cited = quotes.select("id", *KEYS, "quote", F.posexplode("source_passage_ids").alias("pos", "passage_id"))
    wanted = cards.select(*KEYS, F.explode("source_passage_ids").alias("passage_id")).distinct()
    texts = (
        passages.filter(tx.strip(F.col("original_text")) != "")
        .select(*KEYS, F.col("id").alias("passage_id"), "original_text")
        .join(wanted, [*KEYS, "passage_id"], "left_semi")
        .withColumn("text", tx.evidence_norm(F.col("original_text"))).drop("original_text")
    )
    apart = ~F.col("text").contains(F.col("quote"))
    met = cited.join(texts, [*KEYS, "passage_id"], "left").withColumns({
        "quote_tokens": tx.once(F.when(apart, tx.evidence_tokens(F.col("quote")))),
        "text_tokens": tx.once(F.when(apart, F.array_distinct(tx.evidence_tokens(F.col("text"))))),
    })
    support = evidence_supported(
        F.col("quote"), F.col("quote_tokens"), F.col("text"), F.col("text_tokens"), threshold
    )
    checked = met.select("id", "pos", "passage_id", F.col("text").isNull().alias("_gone"), tx.once(F.coalesce(support, F.lit(False))).alias("_supported"))
    return checked.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_gone"), F.struct("pos", "passage_id")))).alias("_missing"),
        F.bool_or("_supported").alias("supported"),
    ).select("id", F.col("_missing.passage_id").alias("missing_ids"), "supported")


#: Characters of the pieces that short quotes are looked up by.
GRAM = 3


def quoted_anywhere(quotes: DataFrame, quote_id: str, texts: DataFrame, text_id: str) -> DataFrame:
    """Whether each normalized ``quote`` stands in any normalized ``text``.

    A run of letters and digits of any script with other characters of the quote on both sides is a whole run of every
    text that holds the quote. So a quote meets only the texts that hold the rarest of its runs; only runs that some
    quote has are counted. Quotes without such a run (one word, say, or none) go by ``quoted_by_grams``. A null quote
    stands nowhere, an empty one in every text that is not null.
    """
    def runs(column: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
        return F.filter(F.array_distinct(found), lambda run: ~run.isin(*tx.STOPWORDS))

    keys = runs("quote", r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]++(?=[^\p{L}\p{N}])")
    asked = quotes.select(quote_id, F.explode(keys).alias("token"))
    held = texts.select(text_id, F.explode(runs("text", r"[\p{L}\p{N}]++")).alias("token"))
    met = by_rarest(asked, quote_id, held, "token").join(texts, text_id).join(quotes, quote_id)
    found = met.filter(F.col("text").contains(F.col("quote"))).select(quote_id)
    short = quotes.filter(F.size(keys) == 0).select("quote").distinct()
    found = found.unionByName(quotes.join(quoted_by_grams(short, texts, text_id), "quote").select(quote_id)).distinct()
    return quotes.join(found.withColumn("quoted", F.lit(True)), quote_id, "left").withColumn(
        "quoted", F.coalesce("quoted", F.lit(False))
    )


def by_rarest(asked: DataFrame, quote_id: str, held: DataFrame, key: str) -> DataFrame:
    """Each quote with the rows of ``held`` that have its rarest key; a key that none has leaves no row."""
    held = held.join(asked.select(key).distinct(), key, "left_semi")
    counts = held.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, key, "left").groupBy(quote_id).agg(
        F.min_by(key, F.struct(F.coalesce("n", F.lit(0)), key)).alias(key)
    )
    return rarest.join(held, key)


def quoted_by_grams(quotes: DataFrame, texts: DataFrame, text_id: str) -> DataFrame:
    """Those of some distinct quotes (``quote``) that stand in any text, found by pieces of ``GRAM`` characters.

    A text is broken into its pieces of up to ``GRAM`` characters, each once, in one pass. A quote of that length is
    found by its piece alone; a longer one meets the texts that hold the rarest of its pieces. Where there is no quote,
    no text is broken up.
    """
    def grams(column: str, size: int) -> Column:
        return F.regexp_extract_all(F.col(column), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))

    any_quote = quotes.agg(F.count(F.lit(1)) > 0).scalar()
    pieces = F.array_distinct(F.concat(F.array(F.lit("")), *(grams("text", size) for size in range(1, GRAM + 1))))
    held = texts.filter(any_quote & F.col("text").isNotNull()).select(text_id, F.explode(pieces).alias("gram"))
    small = quotes.filter(F.length("quote") <= GRAM)
    exact = small.join(held.select(F.col("gram").alias("quote")), "quote", "left_semi")
    large = quotes.filter(F.length("quote") > GRAM)
    asked = large.select("quote", F.explode(F.array_distinct(grams("quote", GRAM))).alias("gram"))
    met = by_rarest(asked, "quote", held, "gram").join(texts.select(text_id, "text"), text_id)
    return exact.unionByName(met.filter(F.col("text").contains(F.col("quote"))).select("quote").distinct())


def verify_cards(cards: DataFrame, passages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Cards with ``accepted``, ``reason`` and ``rejected_ids``.

    Reasons in order: invalid_card, missing_source (any missing id rejects),
    evidence_mismatch (one supporting passage suffices).
    """
    checked = validate_cards(stripped_sources(cards))
    support = cited_support(checked.filter(F.size("errors") == 0), passages, threshold)
    joined = checked.join(support, "id", "left")
    none = F.array().cast("array<string>")
    reason = (
        F.when(F.size("errors") > 0, "invalid_card")
        .when(F.size("missing_ids") > 0, "missing_source")
        .when(~F.col("supported"), "evidence_mismatch")
        .otherwise("")
    )
    return joined.withColumns({"reason": reason, "accepted": reason == ""}).withColumn(
        "rejected_ids",
        F.when(F.col("reason") == "missing_source", F.col("missing_ids"))
        .when(F.col("reason") != "", F.col("source_passage_ids")).otherwise(none),
    ).drop("missing_ids", "supported")


def verify_card_batches(
    batches: DataFrame, cards: DataFrame, passages: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """One ``invalid_batch`` row for a broken batch, else the verdict of each card."""
    keys = [*KEYS, "batch_index"]
    checked = validate_card_batches(batches, cards)
    good = checked.filter("valid").select(*keys)
    verdicts = verify_cards(cards.join(good, keys, "left_semi"), passages, threshold).select(
        *keys, "card_index", "accepted", "reason"
    )
    broken = checked.filter(~F.col("valid")).select(
        *keys, F.lit(-1).alias("card_index"), F.lit(False).alias("accepted"),
        F.lit("invalid_batch").alias("reason"),
    )
    return verdicts.unionByName(broken)


def merge_repair_round(batches: DataFrame, first: DataFrame, repaired: DataFrame) -> DataFrame:
    """Outcome of each batch after at most one repair.

    ``batches``: keys, error, repair_error (null when that call worked). ``first`` and
    ``repaired``: verdicts per card with ``accepted``.
    """
    keys = [*KEYS, "batch_index"]

    def counts(verdicts: DataFrame, tag: str) -> DataFrame:
        return verdicts.groupBy(*keys).agg(
            F.count_if("accepted").alias(f"_ok{tag}"), F.count_if(~F.col("accepted")).alias(f"_no{tag}")
        )

    joined = (
        batches.join(counts(first, "1"), keys, "left").join(counts(repaired, "2"), keys, "left")
        .na.fill(0, ["_ok1", "_no1", "_ok2", "_no2"])
    )
    failed = F.col("error").isNotNull()
    status = (
        F.when(failed, "failed").when(F.col("_no1") == 0, "completed")
        .when(F.col("repair_error").isNotNull(), "repair_failed")
        .when(F.col("_no2") == 0, "repaired").otherwise("partially_repaired")
    )
    staged = joined.withColumn("status", status)
    second = F.col("status").isin("repaired", "partially_repaired")
    return staged.select(
        *keys, "status",
        F.when(failed, 0).otherwise(F.col("_ok1") + F.when(second, F.col("_ok2")).otherwise(0))
        .alias("accepted_card_count"),
        F.when(failed, 1).when(F.col("status") == "completed", 0)
        .when(F.col("status") == "repair_failed", F.col("_no1")).otherwise(F.col("_no2"))
        .alias("rejected_card_count"),
        (~failed & (F.col("_no1") > 0)).alias("repair_attempted"),
        F.substring(F.coalesce("error", "repair_error", F.lit("")), 1, 500).alias("error"),
    )


def derive_cards(understanding: DataFrame) -> DataFrame:
    """Cards from whole-paper summaries: one per filled field.

    ``understanding``: paper_id, space_id, source_passage_ids and per field a struct
    (text, source_passage_ids, evidence_quote, reasoning_summary) or a plain text.
    """
    schema = understanding.schema
    entries = []
    for index, (field, kind) in enumerate(UNDERSTANDING_CARDS):
        value = F.col(field)
        if schema[field].dataType.typeName() == "string":
            filled = F.coalesce(value, F.lit("")) != ""
            parts = (value, F.col("source_passage_ids"), value, F.lit("Legacy flat understanding field."))
        else:
            filled = value.isNotNull()
            parts = (
                value["text"], value["source_passage_ids"], value["evidence_quote"],
                value["reasoning_summary"],
            )
        text, ids, quote, why = parts
        entries.append(F.when(filled, F.struct(
            F.lit(index).alias("card_index"), F.lit(field).alias("field"), F.lit(kind).alias("card_type"),
            text.alias("summary"), ids.alias("source_passage_ids"), quote.alias("evidence_quote"),
            why.alias("reasoning_summary"),
        )))
    rows = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return understanding.select(*KEYS, F.inline(rows)).withColumns({
        "id": F.concat_ws(":", "paper_id", "field"), "confidence": F.lit(0.9),
        "quality_flags": F.array(F.lit("derived_from_paper_understanding")),
    })


# ------------------------------------------------------------ ranking

def with_rank_order(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ``section_score`` and the sortable ``rank_order`` (ascending is better)."""
    cited = cards.select("id", *KEYS, F.explode("source_passage_ids").alias("passage_id"))
    best = cited.join(scores, [*KEYS, "passage_id"]).groupBy("id").agg(F.max("score").alias("section_score"))
    scored = cards.join(best, "id", "left").na.fill(0, ["section_score"])
    order = F.struct(
        (-F.round("confidence", 6)).alias("confidence"),
        (-F.size(F.array_distinct("source_passage_ids"))).alias("sources"),
        (-F.col("section_score")).alias("section"), F.col("card_index").alias("card_index"), F.col("id").alias("id"),
    )
    return scored.withColumn("rank_order", order)


def rank_cards(cards: DataFrame, scores: DataFrame) -> DataFrame:
    """1-based rank of each card in its paper.

    Ranks are counted inside confidence steps and offset across them, so that a
    paper with very many cards is not sorted in one task.
    """
    ordered = with_rank_order(cards, scores)
    return _number(ordered)


def _number(ordered: DataFrame) -> DataFrame:
    step = -F.floor(F.round("confidence", 6) * 100)
    stepped = ordered.withColumn("_step", step)
    numbered = number_rows(stepped, KEYS, "_step", [F.col("rank_order")], "_at")
    return numbered.withColumn("card_rank", F.col("_at") + 1).drop("_at", "_step")


def card_contents(cards: DataFrame) -> DataFrame:
    """Equal cards collapsed: same paper, type, cited set and summary tokens.

    Copies behave alike in duplicate detection, so however many there are, they
    are one row with a count and their best rank.
    """
    # The comparison form and the tokens are made once a card, however often they are read.
    normal = cards.withColumn("_normal", tx.once(tx.summary_norm(F.col("summary"))))
    tokens = F.sort_array(F.array_distinct(tx.summary_words(F.col("_normal"))))
    keyed = normal.withColumn("tokens", tx.once(tokens)).drop("_normal").withColumn(
        "sources", F.array_sort(F.array_distinct("source_passage_ids"))
    )
    # A card without tokens is similar to nothing, not even to its copies.
    alone = F.when(F.size("tokens") == 0, F.col("id")).otherwise("")
    keyed = keyed.withColumn(
        "content",
        F.sha2(F.to_json(F.struct(*KEYS, "card_type", "tokens", "sources", alone.alias("alone"))), 256),
    )
    return keyed


def duplicate_pairs(contents: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Pairs of distinct contents of one paper and type that share a source and are similar.

    ``contents``: content, paper_id, space_id, card_type, tokens, sources, rank_order.
    Candidates meet on (paper, type, shared source, rare prefix token): sets of
    Jaccard >= t must share one of their first n - ceil(t n) + 1 tokens, rarest
    first. A pair is kept only where its first common token and source meet, so it
    comes out once without a distinct.
    """
    group = [*KEYS, "card_type"]
    sized = contents.filter(F.size("tokens") > 0)
    frequency = sized.select(*group, F.explode("tokens").alias("token")).groupBy(*group, "token").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = (
        sized.select("content", *group, F.explode("tokens").alias("token"))
        .join(frequency, [*group, "token"])
        .groupBy("content").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("_t"))
        .select("content", F.col("_t.token").alias("ordered"))
    )
    length = F.size("ordered") - F.ceil(F.size("ordered") * threshold).cast("int") + 1
    keyed = sized.join(ranked, "content").withColumn("prefix", F.slice("ordered", F.lit(1), length))
    # The tokens stay behind: only their number travels with each rare token, and candidates look them up.
    spread = keyed.select(
        *group, "content", F.size("tokens").alias("n"), "sources", "prefix", "rank_order",
        F.explode("sources").alias("source"),
    ).withColumn("token", F.explode("prefix"))
    keys = [*group, "source", "token"]
    columns = ["content", "n", "sources", "prefix", "rank_order"]
    left = spread.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns])
    right = spread.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns])
    met = left.join(right, keys).filter(
        (F.col("l_rank_order") < F.col("r_rank_order"))
        & (F.col("l_n") * threshold <= F.col("r_n"))
        & (F.col("r_n") * threshold <= F.col("l_n"))
        & (F.array_min(F.array_intersect("l_sources", "r_sources")) == F.col("source"))
        & (F.array_min(F.array_intersect("l_prefix", "r_prefix")) == F.col("token"))
    ).select(*group, "l_content", "r_content", "l_rank_order")
    words = sized.select("content", "tokens")
    met = met.join(words.toDF("l_content", "l_tokens"), "l_content").join(words.toDF("r_content", "r_tokens"), "r_content")
    similarity = tx.jaccard(F.col("l_tokens"), F.col("r_tokens"))
    return met.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select(
        *group, F.col("l_content").alias("better"), F.col("r_content").alias("worse"), "similarity",
        F.col("l_rank_order").alias("better_order"),
    )


def duplicate_card_pairs(cards: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Similar contents with how many card pairs they stand for (copies included)."""
    keyed = card_contents(cards.withColumn("rank_order", F.struct("id")))
    group = [*KEYS, "card_type"]
    # Read eight times below: words are made once.
    contents = store_rows(keyed.groupBy("content", *group, "tokens", "sources").agg(
        F.min("rank_order").alias("rank_order"), F.count(F.lit(1)).alias("n")
    ), "contents")
    pairs = duplicate_pairs(contents, threshold)
    counts = contents.select("content", "n", F.col("rank_order.id").alias("id"))
    between = (
        pairs.join(counts.toDF("better", "_bn", "left_id"), "better")
        .join(counts.toDF("worse", "_wn", "right_id"), "worse")
        .select(*group, "left_id", "right_id", "similarity", (F.col("_bn") * F.col("_wn")).alias("pairs"))
    )
    copies = contents.filter((F.col("n") > 1) & (F.size("tokens") > 0)).select(
        *group, F.col("rank_order.id").alias("left_id"), F.col("rank_order.id").alias("right_id"),
        F.lit(1.0).alias("similarity"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
    )
    return between.unionByName(copies)


def dedup_rank_cards(
    cards: DataFrame, scores: DataFrame, max_cards: int = FINAL_CARDS
) -> DataFrame:
    """Verdict of each card: ranked (with rank), duplicate (of which) or overflow (with rank).

    Greedy in rank order: a card is kept unless it is similar to a better *kept*
    card. On the graph of similar pairs this is decided in rounds: a content whose
    better neighbours are all dropped is kept, one with a kept better neighbour is
    dropped; each round decides every content whose neighbours are decided.
    """
    if max_cards <= 0:
        raise ValueError("max_cards must be positive")
    keyed = card_contents(with_rank_order(cards, scores))
    group = [*KEYS, "card_type"]
    # 'similarity ties' do not matter: order alone decides.
    contents = cut_lineage(
        keyed.groupBy("content", *group, "tokens", "sources").agg(
            F.min("rank_order").alias("rank_order"), F.min_by("id", "rank_order").alias("best_id")
        )
    )
    edges = cut_lineage(duplicate_pairs(contents).select("better", "worse", "similarity", "better_order"))
    heads = edges.select(F.col("better").alias("content")).union(edges.select("worse")).distinct()
    entered = edges.select(F.col("worse").alias("content")).distinct().withColumn("_in", F.lit(True))
    state = cut_lineage(heads.join(entered, "content", "left").select(
        "content", F.when(F.col("_in"), "open").otherwise("kept").alias("state")
    ))
    while state.filter("state = 'open'").limit(1).count():
        sources = state.select(F.col("content").alias("better"), F.col("state").alias("_from"))
        pressure = edges.join(sources, "better").groupBy(F.col("worse").alias("content")).agg(
            F.bool_or(F.col("_from") == "kept").alias("_kept"),
            F.bool_or(F.col("_from") == "open").alias("_open"),
        )
        decided = (
            F.when(F.col("state") != "open", F.col("state")).when(F.col("_kept"), "dropped")
            .when(F.col("_open"), "open").otherwise("kept")
        )
        state = cut_lineage(state.join(pressure, "content", "left").select("content", decided.alias("state")))

    kept = state.filter("state = 'kept'").select(F.col("content").alias("better"))
    original = (
        edges.join(kept, "better", "left_semi").groupBy(F.col("worse").alias("content"))
        .agg(F.min_by(F.struct("better", "similarity"), "better_order").alias("_m"))
        .select("content", F.col("_m.better").alias("_better"), "_m.similarity")
        .join(state.filter("state = 'dropped'"), "content", "left_semi")
    )
    best = contents.select("content", "best_id")
    original = original.join(best.toDF("_better", "_better_id"), "_better").drop("_better")
    judged = keyed.join(best, "content").join(original, "content", "left")
    duplicate_of = F.when(F.col("_better_id").isNotNull(), F.col("_better_id")).when(
        F.col("id") != F.col("best_id"), F.col("best_id")
    )
    judged = judged.withColumns({
        "duplicate_of": duplicate_of, "similarity": F.when(duplicate_of.isNotNull(), F.coalesce("similarity", F.lit(1.0))),
    }).drop("_better_id", "best_id", "content", "tokens", "sources")
    survivors = _number(judged.filter("duplicate_of is null"))
    ranked = survivors.withColumn("verdict", F.when(F.col("card_rank") <= max_cards, "ranked").otherwise("overflow"))
    dropped = judged.filter("duplicate_of is not null").withColumns(
        {"card_rank": F.lit(None).cast("int"), "verdict": F.lit("duplicate")}
    )
    return ranked.unionByName(dropped).drop("rank_order")


def top_cards_per_paper(cards: DataFrame, scores: DataFrame, max_cards: int = FINAL_CARDS) -> DataFrame:
    """Ranked cards split at the limit: ``verdict`` ranked or overflow."""
    return rank_cards(cards, scores).withColumn(
        "verdict", F.when(F.col("card_rank") <= max_cards, "ranked").otherwise("overflow")
    )


# ------------------------------------------------------------ persistence and edits

def replace_ai_cards(
    cards: DataFrame, sources: DataFrame, new_cards: DataFrame, run_id: Column, now: Column,
    extractor_version: str = "analysis-v2",
) -> tuple[DataFrame, DataFrame]:
    """Swap the unedited AI cards of re-analysed papers for new ones and their links.

    User cards and edited cards stay. ``new_cards`` are accepted extractor cards;
    their papers define what is replaced.
    """
    papers = new_cards.select(*KEYS).distinct()
    old_ai = (F.col("created_by") == "ai") & ~F.coalesce("user_edited", F.lit(False))
    gone = cards.filter(old_ai).join(papers, KEYS, "left_semi").select(F.col("id"))
    kept = cards.join(gone, "id", "left_anti")
    kept_links = sources.join(gone.withColumnRenamed("id", "card_id"), "card_id", "left_anti")
    staged = new_cards.withColumn("analysis_run_id", run_id)
    fresh = staged.select(
        "id", *KEYS, F.element_at("source_passage_ids", 1).alias("source_passage_id"), "card_type", "summary",
        "source_passage_ids", "evidence_quote", "reasoning_summary", "confidence",
        F.lit(False).alias("user_edited"), F.lit("ai").alias("created_by"), "card_index",
        now.alias("created_at"), "analysis_run_id", F.lit(extractor_version).alias("extractor_version"),
    )
    links = staged.select(
        "id", *KEYS, "evidence_quote", "confidence", "analysis_run_id",
        F.posexplode("source_passage_ids").alias("pos", "passage_id"),
    ).select(
        F.concat(F.col("id"), F.lit("-s"), "pos").alias("id"), F.col("id").alias("card_id"), "passage_id",
        *KEYS, "evidence_quote", "confidence", now.alias("created_at"), "analysis_run_id",
    )
    return (
        kept.unionByName(fresh, allowMissingColumns=True),
        kept_links.unionByName(links, allowMissingColumns=True),
    )


def apply_card_edits(cards: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Overwrite edited fields (id, space_id, summary, card_type, confidence; null = keep).

    An edit with a bad type or confidence is ignored.
    """
    fields = ["summary", "card_type", "confidence"]
    valid = edits.filter(
        (F.col("card_type").isNull() | F.col("card_type").isin(*CARD_TYPES))
        & (F.col("confidence").isNull() | F.col("confidence").between(0, 1))
        & F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()
    )
    new = valid.select("id", "space_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_edit"))
    joined = cards.join(new, ["id", "space_id"], "left")
    return joined.withColumns({
        **{f: F.coalesce(f"_{f}", f) for f in fields},
        "user_edited": F.coalesce("_edit", "user_edited"),
        "created_by": F.when(F.col("_edit"), "user").otherwise(F.col("created_by")),
        "updated_at": F.when(F.col("_edit"), now).otherwise(F.col("created_at")),
    }).drop("_edit", *[f"_{f}" for f in fields])


def append_cards(
    new: DataFrame, papers: DataFrame, passages: DataFrame, origin: str = "user"
) -> tuple[DataFrame, DataFrame]:
    """Accepted hand-made cards, and rejects with the reason.

    ``new``: id, paper_id, space_id, card_type, summary, confidence, source_passage_id.
    """
    homes = papers.select(F.col("id").alias("paper_id"), "space_id", F.lit(True).alias("_paper"))
    cited = passages.select(
        F.col("id").alias("source_passage_id"), *KEYS, F.lit(True).alias("_source")
    )
    joined = new.join(homes, KEYS, "left").join(cited, ["source_passage_id", *KEYS], "left")
    reason = (
        F.when(~F.col("card_type").isin(*CARD_TYPES), "invalid card type")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence must be between 0 and 1")
        .when(F.col("_paper").isNull(), "paper not found")
        .when(
            F.col("source_passage_id").isNotNull() & F.col("_source").isNull(),
            "source passage must belong to the same paper and space",
        )
        .otherwise("")
    )
    judged = joined.withColumn("reason", reason).drop("_paper", "_source")
    accepted = judged.filter("reason = ''").drop("reason").withColumn("created_by", F.lit(origin))
    return accepted, judged.filter("reason <> ''")


def delete_cards(cards: DataFrame, sources: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove cards (id, space_id) and their links."""
    gone = cards.join(ids.select("id", "space_id"), ["id", "space_id"], "left_semi").select("id")
    links = sources.join(gone.withColumnRenamed("id", "card_id"), "card_id", "left_anti")
    return cards.join(gone, "id", "left_anti"), links


# ------------------------------------------------------------ views

def cards_with_titles(cards: DataFrame, papers: DataFrame) -> DataFrame:
    titles = papers.select(F.col("id").alias("paper_id"), "space_id", F.col("title").alias("paper_title"))
    return cards.join(titles, KEYS)


def enrich_cards(cards: DataFrame, sources: DataFrame, passages: DataFrame) -> DataFrame:
    """Cards with validated cited ids and their provenance, in first-seen order.

    Candidates come from the link table, then the evidence list, then the single
    source; only passages of the card's own paper and space count.
    """
    linked = sources.select(
        F.col("card_id").alias("id"), "space_id", "passage_id",
        F.struct(
            F.lit(0).alias("part"), F.col("created_at").alias("at"), F.col("id").alias("key"),
            F.lit(0).alias("pos"),
        ).alias("place"),
    )
    no_time = F.lit(None).cast("timestamp")
    listed = cards.select("id", "space_id", F.posexplode("source_passage_ids").alias("pos", "passage_id")).select(
        "id", "space_id", "passage_id",
        F.struct(F.lit(1).alias("part"), no_time.alias("at"), F.lit("").alias("key"), "pos").alias("place"),
    )
    single = cards.filter("source_passage_id <> ''").select(
        "id", "space_id", F.col("source_passage_id").alias("passage_id"),
        F.struct(
            F.lit(2).alias("part"), no_time.alias("at"), F.lit("").alias("key"), F.lit(0).alias("pos")
        ).alias("place"),
    )
    candidates = linked.unionByName(listed).unionByName(single).groupBy("id", "space_id", "passage_id").agg(
        F.min("place").alias("place")
    )
    origin = passages.select(
        F.col("id").alias("passage_id"), *KEYS, "parse_run_id", "heading_path", "parser_backend",
        "quality_flags",
    )
    homes = cards.select("id", *KEYS)
    valid = candidates.join(homes, ["id", "space_id"]).join(origin, ["passage_id", *KEYS])
    info = F.struct(
        "place", "passage_id", "parse_run_id", "heading_path", "parser_backend", "quality_flags"
    )
    found = valid.groupBy("id").agg(F.array_sort(F.collect_list(info)).alias("source_passages"))
    joined = cards.drop("source_passage_ids").join(found, "id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumn(
        "source_passage_ids", F.coalesce(F.col("source_passages.passage_id"), none)
    )


def cards_by_type(
    cards: DataFrame, papers: DataFrame, sources: DataFrame, passages: DataFrame, card_type: str
) -> DataFrame:
    mine = cards_with_titles(cards.filter(F.col("card_type") == card_type), papers)
    return enrich_cards(mine, sources, passages)


def paper_summary(papers: DataFrame, passages: DataFrame, cards: DataFrame) -> DataFrame:
    """Passage and card counts of each paper (see ``enrich_cards`` for the cards)."""
    n_passages = passages.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("passage_count"))
    n_cards = cards.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("card_count"))
    return (
        papers.withColumnRenamed("id", "paper_id").join(n_passages, KEYS, "left")
        .join(n_cards, KEYS, "left").na.fill(0, ["passage_count", "card_count"])
    )


def newest_cards(cards: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Newest cards of each key; the agent listing clamps its limit to 1..500."""
    return top_k(cards, keys, [F.desc("created_at"), F.asc("id")], min(500, max(1, limit)), "place")
