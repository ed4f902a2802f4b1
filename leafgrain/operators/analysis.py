"""Evidence selection for an external extractor: batches, reading lists, payloads.

Per-paper folds see ids and sizes only, never text; a paper is one file of
bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrain.functions import meta
from leafgrain.functions import text as tx
from leafgrain.operators.keyed import top_k
from leafgrain.operators.splitting import text_pieces_within
from leafgrain.schemas import (
    ANALYSIS_BATCH_TOKENS, METADATA_PASSAGES, UNDERSTANDING_PASSAGES, UNDERSTANDING_TOKENS,
)

# Reading order of sections in a whole-paper summary.
UNDERSTANDING_RANK = {
    "abstract": 0, "introduction": 10, "method": 20, "result": 30, "discussion": 40,
    "limitation": 50, "body": 70, "appendix": 90,
}
KEYS = ["paper_id", "space_id"]
POSITION = ("page_number", "paragraph_index", "id")


def passage_payload(text: Column) -> Column:
    return tx.canonical_json(F.struct(
        "heading_path", "page_number", "passage_type", F.col("id").alias("source_id"), text.alias("text")
    ))


def with_labels(passages: DataFrame) -> DataFrame:
    """Passages with the evidence heading path, passage type and reference flag.

    Labels are computed once as columns, then read by the type and reference rules.
    """
    path = meta.analysis_heading_path(F.col("heading_path"), F.col("section"))
    staged = passages.withColumns({"heading_path": path, "_raw": meta.section_label(F.col("passage_type"))})
    staged = staged.withColumn("_labels", meta.evidence_labels(F.col("section"), F.col("heading_path")))
    staged = staged.withColumn("_joined", F.array_join("_labels", " "))
    cited = F.col("_raw").isin(*meta.REFERENCE_LABELS) | F.exists(
        "_labels", lambda x: x.isin(*meta.REFERENCE_LABELS)
    )
    return staged.withColumns({
        "is_reference": cited,
        "passage_type": meta.type_of_labels(F.col("_raw"), F.col("_labels"), F.col("_joined")),
    }).drop("_raw", "_labels", "_joined")


def split_to_budget(passages: DataFrame, max_tokens: int) -> DataFrame:
    """One row per fragment; passages within the budget are one whole fragment.

    The budget counts the passage's JSON payload. Only over-budget texts are cut.
    """
    # Normalized payloads are columns of their own, so that each is built once.
    sized = passages.withColumn("text", tx.strip(F.col("original_text"))).filter("text <> ''")
    sized = sized.withColumns({
        "_pay": tx.normalize_ws(passage_payload(F.col("text"))),
        "_none": tx.normalize_ws(passage_payload(F.lit(""))),
    })
    size = tx.tokens_of(tx.word_count(F.col("_pay")), F.length("_pay"))
    empty = tx.tokens_of(tx.word_count(F.col("_none")), F.length("_none"))
    sized = sized.withColumns({
        "_over": size > max_tokens, "_room": F.greatest(F.lit(1), F.lit(max_tokens) - empty),
    }).drop("_pay", "_none")
    cut = sized.withColumn(
        "_pieces", text_pieces_within(F.when(F.col("_over"), F.col("text")), F.col("_room"))
    )
    rows = cut.withColumn("_pieces", F.coalesce("_pieces", F.array("text"))).drop("text", "_room")
    return rows.select(
        *[c for c in rows.columns if c not in ("_pieces", "_over")],
        F.size("_pieces").alias("fragment_count"),
        F.posexplode("_pieces").alias("fragment_index", "text"),
    )


def prepared_passages(
    passages: DataFrame, max_tokens: int = ANALYSIS_BATCH_TOKENS, include_references: bool = False
) -> DataFrame:
    """Labelled fragments with payload sizes, ready to be packed."""
    labelled = with_labels(passages)
    if not include_references:
        labelled = labelled.filter(~F.col("is_reference"))
    fragments = split_to_budget(labelled, max_tokens)
    sized = fragments.withColumn("_pay", tx.normalize_ws(passage_payload(F.col("text"))))
    return sized.withColumns({
        "priority": meta.priority_of(F.col("passage_type")), "words": tx.word_count(F.col("_pay")),
        "chars": F.length("_pay"),
    }).drop("_pay")


def _starts(rows: Column, same_group, limit: int) -> Column:
    """Greedy start positions: a row joins the open run if it belongs and fits."""
    first = F.struct(
        F.lit(0).alias("words"), F.lit(0).alias("chars"), F.lit(0).alias("pos"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(state: Column, row: Column) -> Column:
        words, chars = state["words"] + row["words"], state["chars"] + row["chars"] + 1
        last = F.get(rows, state["pos"] - 1)
        stays = (state["pos"] > 0) & same_group(last, row) & (tx.tokens_of(words, chars) <= limit)
        return F.struct(
            F.when(stays, words).otherwise(row["words"]).cast("int").alias("words"),
            F.when(stays, chars).otherwise(row["chars"]).cast("int").alias("chars"),
            (state["pos"] + 1).alias("pos"),
            F.when(stays, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(state["pos"]))).alias("starts"),
        )

    return F.aggregate(rows, first, step, lambda s: s["starts"])


def _slices(rows: Column, starts: Column) -> Column:
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(rows)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(rows, a + 1, b - a))


def _total(rows: Column, field: str) -> Column:
    return F.aggregate(F.transform(rows, lambda r: r[field].cast("int")), F.lit(0), lambda a, v: a + v)


def analysis_batches(
    prepared: DataFrame, max_tokens: int = ANALYSIS_BATCH_TOKENS
) -> DataFrame:
    """Token-bounded batches of each paper, in section order.

    Fragments of equal type and heading are packed in reading order; groups go
    by priority and first position; neighbouring body batches merge while their
    joint payload fits. ``members`` names the fragments of a batch.
    """
    position = F.struct(*[F.col(c) for c in POSITION])
    light = prepared.select(
        *KEYS, "priority", position.alias("at"), "passage_type", "heading_path", "fragment_index", "id",
        "words", "chars",
    ).repartition(*KEYS)
    # One shuffle by paper serves the window and the grouping.
    group = W.partitionBy(*KEYS, "passage_type", "heading_path")
    row = F.struct(
        "priority", F.col("_first").alias("first"), "passage_type", "heading_path", "at",
        "fragment_index", "id", "words", "chars",
    )
    papers = light.withColumn("_first", F.min("at").over(group)).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )
    packed = papers.withColumn(
        "starts",
        _starts(
            F.col("rows"),
            lambda a, b: (a["passage_type"] == b["passage_type"]) & (a["heading_path"] == b["heading_path"]),
            max_tokens,
        ),
    )
    batches = F.transform(
        _slices(F.col("rows"), F.col("starts")),
        lambda part: F.struct(
            part[0]["passage_type"].alias("passage_type"), part[0]["heading_path"].alias("heading_path"),
            _total(part, "words").alias("words"),
            (_total(part, "chars") + F.size(part) - 1).alias("chars"),
            F.transform(part, lambda r: F.struct(r["id"].alias("id"), r["fragment_index"].alias("fragment_index")))
            .alias("members"),
        ),
    )
    staged = packed.select(*KEYS, batches.alias("batches"))
    merged = staged.withColumn(
        "starts",
        _starts(
            F.col("batches"),
            lambda a, b: (a["passage_type"] == "body") & (b["passage_type"] == "body"),
            max_tokens,
        ),
    ).select(*KEYS, F.posexplode(_slices(F.col("batches"), F.col("starts"))).alias("batch_index", "parts"))
    many = F.size("parts") > 1
    none = F.array().cast("array<string>")
    path = F.when(many, none).otherwise(F.element_at("parts", 1)["heading_path"])
    sizes = F.transform("parts", lambda b: tx.tokens_of(b["words"], b["chars"]))
    members = F.flatten("parts.members")
    kind = F.element_at("parts", 1)["passage_type"]
    return merged.select(
        *KEYS, "batch_index", meta.group_key(kind, path).alias("group_key"), path.alias("heading_path"),
        kind.alias("passage_type"),
        F.array_distinct(F.transform(members, lambda m: m["id"])).alias("source_passage_ids"),
        F.aggregate(sizes, F.lit(0), lambda a, v: a + v).alias("token_count"), members.alias("members"),
    )


def understanding_passages(
    passages: DataFrame, max_passages: int = UNDERSTANDING_PASSAGES, budget: int = UNDERSTANDING_TOKENS
) -> DataFrame:
    """Representative passages of each paper: best sections first, within the budget.

    A passage that does not fit is skipped and smaller ones may follow; the first
    is always taken.
    """
    labelled = with_labels(passages).filter(~F.col("is_reference"))
    table = F.create_map(*[F.lit(x) for kv in UNDERSTANDING_RANK.items() for x in kv])
    rank = F.coalesce(F.try_element_at(table, F.col("passage_type")), F.lit(80))
    labels = F.lower(F.array_join(F.concat(F.array("section", "passage_type"), "heading_path"), " "))
    rank = F.when(meta.contains_any(labels, ("conclusion", "summary")), F.least(rank, F.lit(35))).otherwise(rank)
    rank = F.when(meta.contains_any(labels, ("limitation", "future work")), F.least(rank, F.lit(45))).otherwise(rank)
    row = F.struct(
        rank.alias("rank"), F.coalesce("page_number", F.lit(999)).alias("page"),
        "paragraph_index", "id", tx.count_tokens(F.col("original_text")).alias("tokens"),
    )
    ranked = labelled.select(*KEYS, row.alias("row")).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("row")).alias("rows")
    )
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).alias("used"))

    def step(state: Column, r: Column) -> Column:
        first = F.size(state["ids"]) == 0
        take = (
            (F.size(state["ids"]) < max_passages) & ~F.array_contains(state["ids"], r["id"])
            & (first | (state["used"] + r["tokens"] <= budget))
        )
        return F.struct(
            F.when(take, F.concat(state["ids"], F.array(r["id"]))).otherwise(state["ids"]).alias("ids"),
            F.when(take, state["used"] + r["tokens"]).otherwise(state["used"]).cast("int").alias("used"),
        )

    chosen = F.aggregate("rows", start, step, lambda s: s["ids"])
    return ranked.select(*KEYS, F.posexplode(chosen).alias("place", "id"))


def metadata_passages(passages: DataFrame, limit: int = METADATA_PASSAGES) -> DataFrame:
    """Up to ``limit`` front-matter passages of each paper.

    Short papers keep all passages; papers of references only keep their first.
    """
    labelled = with_labels(passages)
    page = F.coalesce("page_number", F.lit(999))
    labels = F.array_join(
        F.transform(F.concat(F.array("section", "passage_type"), "heading_path"), lambda x: meta.section_label(x)), " "
    )
    compact = F.replace(labels, F.lit(" "), F.lit(""))
    opening = F.lower(tx.normalize_ws(F.substring(tx.strip(F.col("original_text")), 1, 240)))
    opening = F.replace(opening, F.lit(" "), F.lit(""))
    rank = F.least(
        F.lit(100), F.when(page <= 3, 10 + page),
        F.when(compact.contains("abstract") | opening.contains("abstract"), 0),
        F.when(meta.contains_any(labels, ("article info", "keywords")), 1),
        F.when(page <= 1, 2),
        F.when((F.col("passage_type") == "introduction") | labels.contains("introduction"), 30),
    )
    ranked = labelled.withColumn("_rank", F.when(F.col("is_reference"), 200).otherwise(rank))
    totals = ranked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_rank") < 200).alias("_usable")
    )
    joined = ranked.join(totals, KEYS)
    plain = (F.col("_n") <= limit) | (F.col("_usable") == 0)
    eligible = joined.filter(plain | (F.col("_rank") < 200)).withColumns({
        "_r": F.when(plain, 0).otherwise(F.col("_rank")), "_p": F.when(plain, 0).otherwise(page),
    })
    order = [F.asc("_r"), F.asc("_p"), *[F.asc(c) for c in POSITION]]
    return top_k(eligible, KEYS, order, limit, "place").select(*KEYS, "id", "place")


def render_prompt_payload(
    batches: DataFrame, prepared: DataFrame, repairs: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Context JSON and source lines (JSONL) of each batch; the wording is the caller's.

    Texts are whole unless ``limit`` cuts each to so many characters; ``was_cut`` tells whether it cut any of a batch.
    ``repairs`` (paper_id, space_id, batch_index, diagnostics JSON) adds the rejections
    of a first round.
    """
    compact = tx.normalize_ws(F.col("text"))
    text = compact if limit is None else tx.truncate_text(F.col("text"), limit)
    cut = F.lit(False) if limit is None else F.coalesce(F.length(compact) > limit, F.lit(False))
    line = F.to_json(F.struct(
        F.col("id").alias("source_id"), "page_number", "section", "heading_path", text.alias("text"),
    ))
    members = batches.select(*KEYS, "batch_index", F.posexplode("members").alias("n", "m")).select(
        *KEYS, "batch_index", "n", "m.id", "m.fragment_index"
    )
    lines = (
        members.join(prepared.select(*KEYS, "id", "fragment_index", line.alias("line"), cut.alias("cut")), [*KEYS, "id", "fragment_index"])
        .groupBy(*KEYS, "batch_index")
        .agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"), F.bool_or("cut").alias("was_cut"))
    )
    context = F.to_json(F.struct("paper_id", "space_id", "batch_index", "source_passage_ids"))
    out = batches.join(lines, [*KEYS, "batch_index"]).select(
        *KEYS, "batch_index", F.concat(F.lit("Context: "), context).alias("context"),
        F.array_join("lines.line", "\n").alias("sources"), "was_cut",
    )
    if repairs is None:
        return out
    return out.join(repairs, [*KEYS, "batch_index"], "left").withColumn(
        "diagnostics", F.coalesce("diagnostics", F.lit("[]"))
    )


def section_scores(batches: DataFrame, prepared: DataFrame) -> DataFrame:
    """Best ranking weight of each source, from its batch or its own section."""
    by_batch = batches.select(
        *KEYS, F.explode("source_passage_ids").alias("passage_id"),
        meta.section_score(F.col("passage_type")).alias("score"),
    )
    own = prepared.select(
        *KEYS, F.col("id").alias("passage_id"), meta.section_score(F.col("passage_type")).alias("score")
    )
    return by_batch.unionByName(own).groupBy(*KEYS, "passage_id").agg(F.max("score").alias("score"))


def analysis_eligible(papers: DataFrame, passages: DataFrame) -> DataFrame:
    """Whether each paper can be analysed, else why not."""
    having = passages.select(F.col("paper_id").alias("id"), "space_id").distinct().withColumn("_has", F.lit(True))
    reason = (
        F.when(F.col("parse_status") != "parsed", "parsing has not completed")
        .when(F.col("_has").isNull(), "parsing has not produced passages")
        .otherwise("")
    )
    return papers.join(having, ["id", "space_id"], "left").select(
        "id", "space_id", (reason == "").alias("eligible"), reason.alias("reason")
    )
