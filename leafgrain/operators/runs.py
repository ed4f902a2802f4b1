"""Pipeline runs: states, staleness, progress, roll-ups, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.functions import numeric
from leafgrain.functions import text as tx

KEYS = ["paper_id", "space_id"]
# Staleness (seconds) and attempts per kind of run.
STALE_SECONDS = {"parse": 600, "embedding": 900, "analysis": 900}
MAX_ATTEMPTS = {"parse": 3, "embedding": 3, "analysis": 2}
STALE_ERROR = {
    "parse": "worker_heartbeat_timeout", "embedding": "worker_heartbeat_timeout",
    "analysis": "analysis_worker_heartbeat_timeout",
}
# Percent of an analysis run at a stage, and of a parse run by status.
STAGE_PERCENT = {"metadata": 84, "understanding": 88, "derive_cards": 94, "persisting": 98, "ranking": 98}
PARSE_PERCENT = {"queued": 8, "running": 38, "completed": 100, "failed": 100}


def active_run_per_paper(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest queued or running run, to be reused instead of a new one."""
    keys = keys or KEYS
    newest = F.max_by(F.struct("id", "status"), F.struct("started_at", "id"))
    return (
        runs.filter("status in ('queued', 'running')").groupBy(*keys).agg(newest.alias("_r"))
        .select(*keys, "_r.*")
    )


def stale_runs(runs: DataFrame, now: Column, kind: str = "parse") -> DataFrame:
    """Running runs without a recent heartbeat: requeued, or failed at the last attempt."""
    stale = (F.col("status") == "running") & numeric.age_exceeds(
        F.col("heartbeat_at"), now, STALE_SECONDS[kind]
    )
    last = F.col("attempt_count") >= MAX_ATTEMPTS[kind]
    return runs.filter(stale).select(
        "id", *KEYS, "attempt_count", F.when(last, "failed").otherwise("queued").alias("status"),
        F.lit(STALE_ERROR[kind]).alias("last_error"), F.when(last, now).alias("completed_at"),
    )


def paper_status_rollup(papers: DataFrame, parse_runs: DataFrame, embedding_runs: DataFrame) -> DataFrame:
    """Parse and embedding status of each paper from its runs.

    ``embedding_runs`` carry passage_count. A completed run without passages is skipped.
    """
    parsed = parse_runs.groupBy(*KEYS).agg(
        F.bool_or(F.col("status") == "completed").alias("_parsed"),
        F.max_by("status", F.struct("started_at", "id")).alias("_last"),
    )
    embedded = embedding_runs.groupBy(*KEYS).agg(
        F.bool_or((F.col("status") == "completed") & (F.col("passage_count") > 0)).alias("_vectors"),
        F.bool_or(F.col("status") == "completed").alias("_done"),
        F.max_by("status", F.struct("started_at", "id")).alias("_elast"),
    )
    homes = papers.select(F.col("id").alias("paper_id"), "space_id")
    joined = homes.join(parsed, KEYS, "left").join(embedded, KEYS, "left")
    parse = F.when(F.col("_parsed"), "parsed").when(F.col("_last") == "failed", "error").otherwise("pending")
    embedding = (
        F.when(F.col("_vectors"), "completed").when(F.col("_done"), "skipped")
        .when(F.col("_elast") == "failed", "failed").otherwise("pending")
    )
    return joined.select(*KEYS, parse.alias("parse_status"), embedding.alias("embedding_status"))


def run_stage_timings(events: DataFrame) -> DataFrame:
    """Seconds per stage and in total of each run, 4 decimals.

    ``events``: run_id, stage, seconds.
    """
    stages = events.groupBy("run_id", "stage").agg(F.sum("seconds").alias("seconds"))
    return stages.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.round("seconds", 4)))))
        .alias("timings"),
        F.round(F.sum("seconds"), 4).alias("total"),
    )


def analysis_progress(batches: DataFrame) -> DataFrame:
    """Progress of each analysis run from its batch outcomes.

    ``batches``: run_id, batch_index, status, accepted, rejected, error. Per-batch
    payloads are one JSON line each, errors cut to 500 characters.
    """
    payload = F.to_json(F.struct(
        F.col("batch_index"), F.col("status"), F.greatest("accepted", F.lit(0)).alias("accepted_card_count"),
        F.greatest("rejected", F.lit(0)).alias("rejected_card_count"),
        F.substring("error", 1, 500).alias("error"),
    ))
    done = F.col("status") != "pending"
    return batches.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_batches"), F.count_if(done).alias("completed_batches"),
        F.sum(F.greatest("accepted", F.lit(0))).alias("accepted_card_count"),
        F.sum(F.greatest("rejected", F.lit(0))).alias("rejected_card_count"),
        F.max(F.when(done, F.col("batch_index"))).alias("current_batch_index"),
        F.array_sort(F.collect_list(F.struct("batch_index", payload.alias("payload")))).alias("_b"),
    ).withColumn("batches", F.col("_b.payload")).drop("_b")


def paper_diagnostics(papers: DataFrame, parse_runs: DataFrame) -> DataFrame:
    """Newest run of each paper and the run to keep watching.

    Watched is the newest queued or running run, else the newest one when it failed
    and the paper is in error.
    """
    order = F.struct("started_at", "id")
    active = F.col("status").isin("queued", "running")
    info = F.struct(
        "id", "status", "backend", "quality_score", "warning_count",
        F.coalesce("completed_at", "started_at").alias("last_parse_time"),
    )
    newest = parse_runs.groupBy(*KEYS).agg(
        F.max_by(info, order).alias("_last"),
        F.max_by(F.col("id"), F.when(active, order)).alias("_active"),
    )
    homes = papers.select(F.col("id").alias("paper_id"), "space_id", "parse_status")
    failed = (F.col("parse_status") == "error") & (F.col("_last.status") == "failed")
    return homes.join(newest, KEYS).select(
        *KEYS, F.col("_last.backend").alias("parser_backend"), "_last.quality_score",
        "_last.warning_count", "_last.last_parse_time",
        F.coalesce("_active", F.when(failed, F.col("_last.id"))).alias("tracked_run"),
    )


def latest_understanding(analysis_runs: DataFrame) -> DataFrame:
    """Whole-paper summary of the newest run of each paper.

    Decoded from ``metadata_json``; blanks become null, papers without any content
    are left out.
    """
    newest = analysis_runs.groupBy(*KEYS).agg(
        F.max_by("metadata_json", F.struct("started_at", "id")).alias("_json")
    )
    doc = F.try_parse_json("_json")
    root = "$.paper_understanding_zh"

    def text(path: str) -> Column:
        return F.nullif(tx.strip(F.try_variant_get(doc, path, "string")), F.lit(""))

    fields = {"one_sentence": text(f"{root}.one_sentence")}
    for name in ("problem", "method", "results", "conclusion", "limitations"):
        flat = F.when(
            F.schema_of_variant(F.try_variant_get(doc, f"{root}.{name}", "variant")) == "STRING",
            text(f"{root}.{name}"),
        )
        fields[name] = F.coalesce(text(f"{root}.{name}.text"), flat)
    listed = F.try_variant_get(doc, f"{root}.source_passage_ids", "array<string>")
    kept = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda v: F.trim(v) != "")
    decoded = newest.select(*KEYS, *[v.alias(k) for k, v in fields.items()], kept.alias("source_passage_ids"))
    something = F.coalesce(*[F.col(k) for k in fields]).isNotNull() | (F.size("source_passage_ids") > 0)
    return decoded.filter(something)


def analysis_percent(status: Column, stage: Column, completed: Column, total: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STAGE_PERCENT.items() for x in kv])
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), completed / total))
    running = F.least(F.lit(98), F.greatest(F.lit(84), F.floor(84 + share * 14 + 0.5)))
    return (
        F.when(status == "queued", 82).when(stage.isNull(), 92)
        .when(F.try_element_at(table, stage).isNotNull(), F.try_element_at(table, stage))
        .when(total <= 0, 92).otherwise(running).cast("int")
    )


def parse_percent(status: Column, stored: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PARSE_PERCENT.items() for x in kv])
    fallback = F.coalesce(F.try_element_at(table, status), F.lit(18))
    value = F.coalesce(stored, fallback.cast("double"))
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(value + 0.5))).cast("int")


def run_progress_percent(runs: DataFrame) -> DataFrame:
    """Percent shown for parse and analysis runs (column ``kind``)."""
    percent = F.when(
        F.col("kind") == "analysis",
        analysis_percent(F.col("status"), F.col("stage"), F.col("completed_batches"), F.col("total_batches")),
    ).otherwise(parse_percent(F.col("status"), F.col("stored_percent")))
    return runs.withColumn("percent", percent)


def progress_rollup(events: DataFrame) -> DataFrame:
    """Newest progress of each run, clamped to 0..100 (run_id, ts, event_id, stage, progress)."""
    newest = F.max_by(F.struct("stage", "progress", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("run_id").agg(newest.alias("_p")).select(
        "run_id", "_p.stage", "_p.ts",
        F.least(F.lit(100), F.greatest(F.lit(0), F.col("_p.progress").cast("int"))).alias("progress"),
    )


def source_coverage(cards: DataFrame, passages: DataFrame) -> DataFrame:
    """Share of a paper's passages that its cards cite; null without passages."""
    available = passages.filter(F.trim("id") != "").groupBy(*KEYS).agg(
        F.countDistinct("id").alias("available")
    )
    cited = (
        cards.select(*KEYS, F.explode("source_passage_ids").alias("id")).distinct()
        .join(passages.select(*KEYS, "id").distinct(), [*KEYS, "id"], "left_semi")
        .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cited"))
    )
    papers = available.join(cited, KEYS, "full_outer")
    return papers.select(
        *KEYS, (F.coalesce("cited", F.lit(0)) / F.col("available")).alias("source_coverage")
    )


def analysis_quality(verdicts: DataFrame, understood: DataFrame) -> DataFrame:
    """Accepted and rejected cards, warnings and rejections by reason of each paper."""
    reasons = verdicts.filter("reason <> ''").groupBy(*KEYS, "reason").agg(F.count(F.lit(1)).alias("n"))
    by_reason = reasons.groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("diagnostics"),
        F.sum("n").alias("rejected_card_count"),
    )
    counts = verdicts.groupBy(*KEYS).agg(F.count_if("accepted").alias("accepted_card_count"))
    has = understood.select(*KEYS).distinct().withColumn("_has", F.lit(True))
    joined = counts.join(by_reason, KEYS, "left").join(has, KEYS, "left").na.fill(0, ["rejected_card_count"])
    warnings = F.filter(
        F.array(
            F.when(F.col("_has").isNull(), "no_paper_understanding_generated"),
            F.when(
                F.col("rejected_card_count") > 0,
                F.concat(F.col("rejected_card_count"), F.lit(" derived cards rejected")),
            ),
        ),
        lambda w: w.isNotNull(),
    )
    return joined.withColumn("warnings", warnings).drop("_has")


# ------------------------------------------------------------ validation

def _violation(df: DataFrame, rule: str, ident: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), "paper_id", ident.cast("string").alias("row"))


def validate_parse(
    passages: DataFrame, elements: DataFrame, tables: DataFrame, assets: DataFrame | None = None
) -> DataFrame:
    """Violations of one parse per paper: duplicate ids or hashes, unknown element references.

    Duplicates are found by map-side combined counts; nothing is sent to one task.
    """
    parts = []
    for name, df in {"passage": passages, "element": elements, "table": tables, "asset": assets}.items():
        if df is not None:
            counted = df.groupBy("paper_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            parts.append(_violation(counted, f"duplicate {name} id", F.col("id")))
    hashes = passages.filter("content_hash is not null").groupBy("paper_id", "content_hash").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    parts.append(_violation(hashes, "duplicate content_hash", F.col("content_hash")))
    known = elements.select("paper_id", F.col("id").alias("element_id"))
    cited = passages.select("paper_id", "id", F.explode("element_ids").alias("element_id"))
    unknown = cited.join(known, ["paper_id", "element_id"], "left_anti")
    parts.append(_violation(unknown, "passage references unknown element", F.col("id")).distinct())
    for name, df in {"table": tables, "asset": assets}.items():
        if df is not None:
            lost = df.filter("element_id is not null").join(known, ["paper_id", "element_id"], "left_anti")
            parts.append(_violation(lost, f"{name} references unknown element", F.col("id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_run_scope(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose analysis run belongs to another paper or space (or does not exist)."""
    scope = runs.select(F.col("id").alias("analysis_run_id"), *KEYS)
    return rows.filter("analysis_run_id is not null").join(scope, ["analysis_run_id", *KEYS], "left_anti")


def remap_by_hash(
    old: DataFrame, new: DataFrame, cards: DataFrame, sources: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Move citations from replaced passages to new ones of equal content.

    ``old`` and ``new``: id, paper_id, space_id, content_hash. A card's single source
    becomes the new id or null; evidence lists drop lost ids and keep ids that were
    never part of the old parse; links follow or go.
    """
    target = new.filter("content_hash is not null").groupBy(*KEYS, "content_hash").agg(
        F.max("id").alias("new_id")
    )
    moves = old.join(target, [*KEYS, "content_hash"], "left").select(
        *KEYS, F.col("id").alias("old_id"), "new_id", F.lit(True).alias("_old")
    )
    single = moves.select(*KEYS, F.col("old_id").alias("source_passage_id"), F.col("new_id").alias("_to"), "_old")
    moved = cards.join(single, [*KEYS, "source_passage_id"], "left").withColumn(
        "source_passage_id",
        F.when(F.col("_old"), F.col("_to")).otherwise(F.col("source_passage_id")),
    ).drop("_to", "_old")
    listed = cards.select("id", *KEYS, F.posexplode("source_passage_ids").alias("pos", "old_id")).join(
        moves, [*KEYS, "old_id"], "left"
    )
    place = F.when(F.col("_old"), F.col("new_id")).otherwise(F.col("old_id"))
    lists = listed.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(place.isNotNull(), F.struct("pos", place.alias("to"))))).alias("_l")
    )
    moved = moved.drop("source_passage_ids").join(lists, "id", "left").withColumn(
        "source_passage_ids",
        F.array_distinct(F.coalesce(F.col("_l.to"), F.array().cast("array<string>"))),
    ).drop("_l")
    linked = sources.join(moves.withColumnRenamed("old_id", "passage_id"), [*KEYS, "passage_id"], "left")
    to = F.when(F.col("_old"), F.col("new_id")).otherwise(F.col("passage_id"))
    links = linked.withColumn("passage_id", to).filter("passage_id is not null").drop("new_id", "_old")
    first = F.min_by(F.struct(*[c for c in links.columns]), F.struct("created_at", "id"))
    links = links.groupBy("card_id", F.col("passage_id").alias("_p")).agg(first.alias("_r")).select("_r.*")
    return moved, links


# ------------------------------------------------------------ evaluation

# Passing thresholds of the two evaluations.
PARSE_THRESHOLDS = {
    "parse_success_rate": 1.0, "stable_source_ratio": 0.95, "max_token_violation_count": 0,
    "reference_filter_precision": 0.9, "table_isolation": 0.9,
}
ANALYSIS_THRESHOLDS = {
    "schema_validity_rate": 1.0, "source_grounding_rate": 1.0, "duplicate_card_rate": 0.05,
    "user_card_preservation_rate": 1.0, "late_section_coverage": 1.0,
}


def source_key() -> Column:
    """Identity of a passage across two parses."""
    return F.sha2(tx.canonical_json(F.struct(
        "heading_path", "page_number", "paragraph_index", "section",
        F.sha2("original_text", 256).alias("text_hash"),
    )), 256)


def stable_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Share of each paper's sources that both parses agree on, counted with repeats."""
    def counts(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("paper_id", source_key().alias("key")).agg(F.count(F.lit(1)).alias(tag))

    both = counts(first, "a").join(counts(second, "b"), ["paper_id", "key"], "full_outer").na.fill(0, ["a", "b"])
    sums = both.groupBy("paper_id").agg(
        F.sum(F.least("a", "b")).alias("stable"), F.greatest(F.sum("a"), F.sum("b")).alias("total")
    )
    return sums.withColumn("stable_source_ratio", numeric.ratio(F.col("stable"), F.col("total")))


def heading_recall(elements: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of the expected headings (paper_id, heading) found among the elements."""
    found = elements.filter("element_type = 'heading'").select(
        "paper_id", F.lower(tx.strip(F.col("text"))).alias("_h")
    ).distinct().withColumn("_found", F.lit(True))
    keyed = expected.withColumn("_h", F.lower("heading")).join(found, ["paper_id", "_h"], "left")
    return keyed.groupBy("paper_id").agg(
        numeric.ratio(F.count("_found"), F.count(F.lit(1))).alias("heading_recall")
    )


def term_metrics(passages: DataFrame, terms: DataFrame) -> DataFrame:
    """Reference precision and table isolation of each paper.

    ``terms``: paper_id, reference_terms, table_terms (arrays). ``passages`` carry
    table_id ('' outside tables) and token_count.
    """
    low = F.lower("original_text")
    joined = passages.join(terms, "paper_id").withColumn("_t", low)

    def matches(column: str) -> Column:
        return F.exists(column, lambda t: F.contains(F.col("_t"), F.lower(t)))

    in_table = F.col("table_id") != ""
    hits = joined.withColumns({
        "_reference": matches("reference_terms"), "_table": matches("table_terms"),
        "_covered": F.when(in_table, F.filter("table_terms", lambda t: F.contains(F.col("_t"), F.lower(t)))),
    })
    sums = hits.groupBy("paper_id", "table_terms", "reference_terms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_reference").alias("refs"),
        F.count_if("_table").alias("matching"), F.count_if(F.col("_table") & in_table).alias("inside"),
        F.array_distinct(F.flatten(F.collect_set("_covered"))).alias("covered"),
    )
    covered, wanted = F.size("covered"), F.size(F.array_distinct("table_terms"))
    isolation = (
        F.when(F.size("table_terms") == 0, None)
        .when(F.col("matching") == 0, 0.0)
        .when((covered == wanted) & (F.col("matching") == F.col("inside")), 1.0)
        .otherwise(covered / F.size("table_terms"))
    )
    precision = F.when(
        F.size("reference_terms") > 0, numeric.ratio(F.col("n") - F.col("refs"), F.col("n"))
    )
    return sums.select(
        "paper_id", precision.alias("reference_filter_precision"), isolation.alias("table_isolation")
    )


def parse_eval_metrics(
    first: DataFrame, second: DataFrame, elements: DataFrame, expected: DataFrame, terms: DataFrame,
    outcomes: DataFrame, max_tokens: int,
) -> DataFrame:
    """One row of parse quality metrics, each an average over the papers that have it.

    ``outcomes``: paper_id, success. A paper without passages is one of them: nothing of it is unstable (1) or a
    reference (1), and its table terms are not found (0).
    """
    violations = first.groupBy("paper_id").agg(
        F.count_if(F.col("token_count") > max_tokens).alias("violations")
    )
    asked = terms.select("paper_id", (F.size("table_terms") > 0).alias("_tables"), (F.size("reference_terms") > 0).alias("_references"))
    papers = (
        outcomes.join(heading_recall(elements, expected), "paper_id", "left")
        .join(term_metrics(first, terms), "paper_id", "left")
        .join(asked, "paper_id", "left")
        .join(stable_sources(first, second).drop("stable", "total"), "paper_id", "left")
        .join(violations, "paper_id", "left")
    ).withColumns({
        "table_isolation": F.coalesce("table_isolation", F.when(F.col("_tables"), 0.0)),
        "reference_filter_precision": F.coalesce("reference_filter_precision", F.when(F.col("_references"), 1.0)),
        "stable_source_ratio": F.coalesce("stable_source_ratio", F.lit(1.0)),
    })
    names = ("heading_recall", "table_isolation", "reference_filter_precision", "stable_source_ratio")
    return papers.agg(
        *[F.coalesce(F.round(F.avg(n), 6), F.lit(0.0)).alias(n) for n in names],
        F.coalesce(F.sum("violations"), F.lit(0)).alias("max_token_violation_count"),
        numeric.ratio(F.count_if("success"), F.count(F.lit(1))).alias("parse_success_rate"),
    )


def analysis_eval_metrics(
    verdicts: DataFrame, pairs: DataFrame, before: DataFrame, after: DataFrame, late: DataFrame,
    batches: DataFrame,
) -> DataFrame:
    """One row of analysis quality metrics.

    ``pairs``: duplicate pairs with their count; ``before``/``after``: cards around a
    replacement; ``late``: (paper_id, passage_id) that must be selected and cited.
    """
    base = verdicts.agg(
        numeric.ratio(F.count_if(F.col("reason") != "invalid_card"), F.count(F.lit(1))).alias("schema_validity_rate"),
        numeric.ratio(
            F.count_if("accepted"), F.count_if(F.col("reason") != "invalid_card")
        ).alias("source_grounding_rate"),
        F.count(F.lit(1)).alias("_cards"),
    )
    duplicates = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("_pairs"))
    mine = before.filter((F.col("created_by") != "ai") | F.col("user_edited")).select("id")
    kept = mine.join(after.select("id", F.lit(True).alias("_kept")), "id", "left").agg(
        numeric.ratio(F.count("_kept"), F.count(F.lit(1))).alias("user_card_preservation_rate")
    )
    selected = batches.select("paper_id", F.explode("source_passage_ids").alias("passage_id")).distinct()
    cited = verdicts.filter("accepted").select(
        "paper_id", F.explode("source_passage_ids").alias("passage_id")
    ).distinct()
    covered = late.join(selected, ["paper_id", "passage_id"], "left_semi").join(
        cited.withColumn("_c", F.lit(True)), ["paper_id", "passage_id"], "left"
    )
    coverage = late.agg(F.count(F.lit(1)).alias("_late")).withColumn("_k", F.lit(1)).join(
        covered.agg(F.count("_c").alias("_hit")).withColumn("_k", F.lit(1)), "_k"
    )
    one = F.lit(1).alias("_k")
    joined = (
        base.select("*", one).join(duplicates.select("*", one), "_k").join(kept.select("*", one), "_k")
        .join(coverage, "_k")
    )
    possible = F.col("_cards") * (F.col("_cards") - 1) / 2
    return joined.select(
        "schema_validity_rate", "source_grounding_rate",
        F.when(possible == 0, 1.0).otherwise(F.round(F.col("_pairs") / possible, 6)).alias("duplicate_card_rate"),
        "user_card_preservation_rate", numeric.ratio(F.col("_hit"), F.col("_late")).alias("late_section_coverage"),
    )


def threshold_failures(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Names of the metrics that miss their threshold."""
    at_most = {"max_token_violation_count", "duplicate_card_rate"}
    checks = [
        F.when(F.col(name) > limit if name in at_most else F.col(name) < limit, F.lit(name))
        for name, limit in thresholds.items()
    ]
    return metrics.withColumn("failures", F.filter(F.array(*checks), lambda f: f.isNotNull()))
