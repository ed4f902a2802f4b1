"""Queries over listings, edits, runs, validation and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from leafgrain.operators import analysis as an
from leafgrain.operators import cards as cd
from leafgrain.operators import chunking as ck
from leafgrain.operators import listing as ls
from leafgrain.operators import runs as rn
from leafgrain.operators.keyed import store_rows
from leafgrain.plans import oracle_base as o
from leafgrain.plans.chunk_queries import CHUNKS, chunks, headed, tables_of
from leafgrain.plans.corpus import Corpus
from leafgrain.plans.knowledge_queries import BUDGET, JUDGED, SIM, TOKENS
from leafgrain.plans.registry import query, setup, stamp

@setup
def columns() -> None:
    global NONE, NOW, d, number
    NONE = F.array().cast("array<string>")
    NOW = F.lit("2024-01-20 12:00:00").cast("timestamp")
    d = F.col("doc_id")
    number = F.split("paper_id", "-")[1].cast("long")

# ---------------------------------------------------------------- listings and edits


def active(c: Corpus):
    return c.spaces.filter("id = 'src1'").select(F.lit("active_space").alias("key"), F.col("id").alias("value"))


@query(
    "scope_to_space",
    o.sql("SELECT p.id FROM passages p JOIN spaces s ON s.id = p.space_id WHERE s.id = 'src1' AND status = 'active'",
          "passages", "spaces"),
)
def scope_to_space(c: Corpus):
    return ls.scope_to_space(c.passages, c.spaces, active(c)).select("id")


@query("list_spaces", o.sql("SELECT id, name, status FROM spaces WHERE status <> 'deleted'", "spaces"))
def list_spaces(c: Corpus):
    return ls.list_spaces(c.spaces).select("id", "name", "status")


@query(
    "list_papers",
    o.sql("SELECT space_id, id, title, " + o.stamp("imported_at") + " AS imported_at FROM papers", "papers"),
)
def list_papers(c: Corpus):
    return ls.list_papers(c.papers).select("space_id", "id", "title", stamp("imported_at").alias("imported_at"))


@query(
    "list_elements",
    o.sql(
        "SELECT id, place FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY element_index) AS place FROM"
        " elements WHERE element_type = 'paragraph') WHERE place <= 5", "elements",
    ),
)
def list_elements(c: Corpus):
    return ls.list_elements(c.elements, 5, "paragraph").select("id", "place")


@query(
    "list_tables",
    o.sql("SELECT 't-' || id AS id, page_number FROM elements WHERE element_type = 'table' AND element_index % 2 = 0",
          "elements"),
)
def list_tables(c: Corpus):
    return ls.list_tables(tables_of(c).withColumn("table_index", F.lit(0))).select("id", "page_number")


@query("list_passages", o.sql("SELECT id, page_number, section FROM passages", "passages"))
def list_passages(c: Corpus):
    return ls.list_passages(c.passages).select("id", "page_number", "section")


@query("list_runs", o.sql("SELECT id, status, " + o.stamp("started_at") + " AS started_at FROM runs", "runs"))
def list_runs(c: Corpus):
    return ls.list_runs(c.runs).select("id", "status", stamp("started_at").alias("started_at"))


def tracked(c: Corpus):
    return c.papers.withColumns({
        "metadata_sources": F.create_map(F.lit("title"), F.lit("document.title")),
        "metadata_confidence": F.create_map().cast("map<string,double>"),
        "user_edited_fields": F.when(d % 2 == 0, F.array(F.lit("year"))).otherwise(NONE),
        "metadata_status": F.lit("extracted"),
    })


@query(
    "apply_paper_edits",
    o.sql(
        "SELECT id, CASE WHEN e THEN 'Edited ' || id ELSE title END AS title, CASE WHEN e AND doc_id % 4 = 0 THEN"
        " 'supports' ELSE relation_to_idea END AS relation_to_idea, CASE WHEN e THEN 'user.edit' ELSE 'document.title' END"
        " AS title_source, CASE WHEN e THEN 'user_edited' ELSE 'extracted' END AS metadata_status, concat_ws('|', CASE WHEN"
        " e THEN 'title' END, CASE WHEN doc_id % 2 = 0 THEN 'year' END) AS fields FROM (SELECT *, doc_id % 3 = 0 AND doc_id"
        " % 5 <> 4 AS e FROM papers)", "papers",
    ),
)
def apply_paper_edits(c: Corpus):
    edits = c.papers.filter(d % 3 == 0).select(
        "id", "space_id", F.concat(F.lit("Edited "), "id").alias("title"),
        F.when(d % 5 == 4, "nonsense").when(d % 4 == 0, "supports").alias("relation_to_idea"),
    )
    return ls.apply_paper_edits(tracked(c), edits).select(
        "id", "title", "relation_to_idea", F.col("metadata_sources")["title"].alias("title_source"),
        "metadata_status", F.array_join("user_edited_fields", "|").alias("fields"),
    )


@query(
    "apply_space_status",
    o.sql(
        "SELECT id, CASE WHEN status = 'deleted' THEN status WHEN n % 3 = 1 THEN 'archived' WHEN n % 3 = 2 THEN 'deleted'"
        " ELSE status END AS status, n % 3 = 0 OR status = 'deleted' AS kept_pointer FROM (SELECT *, CAST(substr(id, 4) AS"
        " INT) AS n FROM spaces)", "spaces",
    ),
)
def apply_space_status(c: Corpus):
    """Every space is some user's active one; two thirds change."""
    n = F.substring("id", 4, 9).cast("int")
    changes = c.spaces.filter(n % 3 > 0).select("id", F.when(n % 3 == 1, "archived").otherwise("deleted").alias("status"))
    pointers = c.spaces.select(F.lit("active_space").alias("key"), F.col("id").alias("value"))
    updated, state = ls.apply_space_status(c.spaces, pointers, changes, NOW)
    left = state.select(F.col("value").alias("id"), F.lit(True).alias("_kept"))
    return updated.join(left, "id", "left").select(
        "id", "status", F.coalesce("_kept", F.lit(False)).alias("kept_pointer")
    )


# ---------------------------------------------------------------- runs

@query(
    "active_run_per_paper",
    o.sql(
        "SELECT paper_id, id, status FROM runs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY"
        " paper_id ORDER BY started_at DESC, id DESC) = 1", "runs",
    ),
)
def active_run_per_paper(c: Corpus):
    return rn.active_run_per_paper(c.runs).select("paper_id", "id", "status")


@query(
    "stale_runs",
    o.sql(
        "SELECT id, attempt_count, CASE WHEN attempt_count >= 2 THEN 'failed' ELSE 'queued' END AS status,"
        " 'analysis_worker_heartbeat_timeout' AS last_error FROM runs WHERE status = 'running' AND (heartbeat_at IS NULL OR"
        " heartbeat_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 900 SECOND)", "runs",
    ),
)
def stale_runs(c: Corpus):
    return rn.stale_runs(c.runs, NOW, "analysis").select("id", "attempt_count", "status", "last_error")


@query(
    "paper_status_rollup",
    o.sql(
        "SELECT papers.id AS paper_id, CASE WHEN a.done THEN 'parsed' WHEN a.last = 'failed' THEN 'error' ELSE 'pending' END AS"
        " parse_status, CASE WHEN b.full_ THEN 'completed' WHEN b.done THEN 'skipped' WHEN b.last = 'failed' THEN 'failed' ELSE"
        " 'pending' END AS embedding_status FROM papers LEFT JOIN (SELECT paper_id, bool_or(status = 'completed') AS done,"
        " arg_max(status, row(started_at, id)) AS last FROM runs WHERE worker % 2 = 0 GROUP BY 1) a ON a.paper_id = papers.id"
        " LEFT JOIN (SELECT paper_id, bool_or(status = 'completed') AS done, bool_or(status = 'completed' AND messages > 2)"
        " AS full_, arg_max(status, row(started_at, id)) AS last FROM runs WHERE worker % 2 = 1 GROUP BY 1) b ON b.paper_id ="
        " papers.id", "papers", "runs",
    ),
)
def paper_status_rollup(c: Corpus):
    """Runs of even workers as parse runs, of odd ones as embedding runs."""
    runs = c.runs.drop("space_id").join(
        c.papers.select(F.col("id").alias("paper_id"), "space_id"), "paper_id"
    )
    parse = runs.filter("worker % 2 = 0")
    embedding = runs.filter("worker % 2 = 1").withColumn("passage_count", F.col("messages") - 2)
    return rn.paper_status_rollup(c.papers, parse, embedding).drop("space_id")


@query(
    "run_stage_timings",
    o.sql(
        "SELECT run_id, string_agg(kind || '=' || printf('%.2f', s), ',' ORDER BY kind) AS timings, round(sum(s0), 4) AS total"
        " FROM (SELECT run_id, kind, sum(value) AS s0, round(sum(value), 4) AS s FROM run_events GROUP BY 1, 2) GROUP BY 1",
        "run_events",
    ),
)
def run_stage_timings(c: Corpus):
    events = c.run_events.select("run_id", F.col("kind").alias("stage"), F.col("value").alias("seconds"))
    text = F.transform(
        F.map_entries("timings"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.2f", e["value"]))
    )
    return rn.run_stage_timings(events).select("run_id", F.array_join(text, ",").alias("timings"), "total")


BATCH_EVENTS = dict(
    be="SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS batch_index, kind, worker,"
    " event_id FROM run_events",
)


@query(
    "analysis_progress",
    o.sql(
        "SELECT run_id, count(*) AS total_batches, count(*) FILTER (kind <> 'queued') AS completed_batches,"
        " CAST(sum(greatest(worker % 7 - 1, 0)) AS BIGINT) AS accepted_card_count, CAST(sum(worker % 3) AS BIGINT) AS"
        " rejected_card_count, coalesce(max(CASE WHEN kind <> 'queued' THEN batch_index END), -1) AS current_batch_index,"
        " string_agg('{\"batch_index\":' || batch_index || ',\"status\":\"' || CASE WHEN kind = 'queued' THEN 'pending' ELSE"
        " kind END || '\",\"accepted_card_count\":' || greatest(worker % 7 - 1, 0) || ',\"rejected_card_count\":' || worker % 3"
        " || CASE WHEN kind = 'failed' THEN ',\"error\":\"' || repeat('x', 500) || '\"' ELSE '' END || '}', chr(10) ORDER BY"
        " batch_index) AS batches FROM be GROUP BY 1", "run_events", **BATCH_EVENTS,
    ),
)
def analysis_progress(c: Corpus):
    """Messages of a run as outcomes of its batches."""
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("run_id").orderBy("event_id")) - 1
    batches = c.run_events.select(
        "run_id", place.alias("batch_index"), F.when(F.col("kind") == "queued", "pending").otherwise(F.col("kind")).alias("status"),
        (F.col("worker") % 7 - 1).alias("accepted"), (F.col("worker") % 3).alias("rejected"),
        F.when(F.col("kind") == "failed", F.repeat(F.lit("x"), F.lit(600))).alias("error"),
    )
    return rn.analysis_progress(batches).withColumns({
        "batches": F.array_join("batches", "\n"),
        "current_batch_index": F.coalesce("current_batch_index", F.lit(-1)),
    })


@query(
    "paper_diagnostics",
    o.sql(
        "SELECT p.id AS paper_id, l.status AS backend, CAST(l.messages AS BIGINT) AS warning_count, "
        + o.stamp("coalesce(l.seen_at, l.started_at)") + " AS last_parse_time, coalesce(a.id, CASE WHEN p.parse_status ="
        " 'error' AND l.status = 'failed' THEN l.id END, '') AS tracked_run FROM papers p JOIN (SELECT * FROM runs QUALIFY"
        " row_number() OVER (PARTITION BY paper_id ORDER BY started_at DESC, id DESC) = 1) l ON l.paper_id = p.id LEFT JOIN"
        " (SELECT * FROM runs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY"
        " started_at DESC, id DESC) = 1) a ON a.paper_id = p.id", "papers", "runs",
    ),
)
def paper_diagnostics(c: Corpus):
    runs = c.runs.drop("space_id").join(
        c.papers.select(F.col("id").alias("paper_id"), "space_id"), "paper_id"
    ).withColumns({
        "backend": F.col("status"), "quality_score": F.lit(1.0), "warning_count": F.col("messages"),
        "completed_at": F.col("seen_at"),
    })
    return rn.paper_diagnostics(c.papers, runs).select(
        "paper_id", F.col("parser_backend").alias("backend"), "warning_count",
        stamp("last_parse_time").alias("last_parse_time"),
        F.coalesce("tracked_run", F.lit("")).alias("tracked_run"),
    )


META = (
    "CASE worker % 4 WHEN 0 THEN '{\"paper_understanding_zh\":{\"one_sentence\":\" About ' || id || ' \",\"problem\":{\"text\":"
    "\"P ' || worker || '\"},\"method\":\"flat\",\"source_passage_ids\":[\"a\",\" \",\"b\"]}}' WHEN 1 THEN"
    " '{\"paper_understanding_zh\":{\"one_sentence\":\"  \"}}' WHEN 2 THEN 'broken' ELSE '{\"paper_understanding_zh\":"
    "{\"results\":{\"text\":\"R\"}}}' END"
)


@query(
    "latest_understanding",
    o.sql(
        "SELECT paper_id, CASE WHEN worker % 4 = 0 THEN 'About ' || id ELSE '' END AS one_sentence, CASE WHEN worker % 4 = 0"
        " THEN 'P ' || worker ELSE '' END AS problem, CASE WHEN worker % 4 = 0 THEN 'flat' ELSE '' END AS method, CASE WHEN"
        " worker % 4 = 3 THEN 'R' ELSE '' END AS results, CASE WHEN worker % 4 = 0 THEN 'a,b' ELSE '' END AS sources FROM"
        " (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY started_at DESC, id DESC) = 1) WHERE"
        " worker % 4 IN (0, 3)", "runs",
    ),
)
def latest_understanding(c: Corpus):
    runs = c.runs.withColumn("metadata_json", F.expr(META))
    fields = [F.coalesce(n, F.lit("")).alias(n) for n in ("one_sentence", "problem", "method", "results")]
    return rn.latest_understanding(runs).select(
        "paper_id", *fields, F.array_join("source_passage_ids", ",").alias("sources")
    )


@query(
    "run_progress_percent",
    o.sql(
        "SELECT id, CAST(CASE WHEN attempt_count % 2 = 1 THEN CASE WHEN status = 'queued' THEN 82 WHEN stage IS NULL THEN 92"
        " WHEN stage = 'metadata' THEN 84 WHEN stage = 'ranking' THEN 98 WHEN messages - 2 <= 0 THEN 92 ELSE least(98,"
        " greatest(84, floor(84 + least(1.0, greatest(0.0, (worker % 5) / (messages - 2))) * 14 + 0.5))) END ELSE"
        " least(100, greatest(0, floor(CASE WHEN worker % 3 = 0 THEN worker * 1.5 ELSE CASE status WHEN 'queued' THEN 8 WHEN"
        " 'running' THEN 38 WHEN 'completed' THEN 100 WHEN 'failed' THEN 100 ELSE 18 END END + 0.5))) END AS BIGINT) AS"
        " percent FROM (SELECT *, CASE worker % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'ranking' WHEN 2 THEN 'cards' END AS stage"
        " FROM runs)", "runs",
    ),
)
def run_progress_percent(c: Corpus):
    w = F.col("worker")
    runs = c.runs.withColumns({
        "kind": F.when(F.col("attempt_count") % 2 == 1, "analysis").otherwise("parse"),
        "stage": F.when(w % 4 == 0, "metadata").when(w % 4 == 1, "ranking").when(w % 4 == 2, "cards"),
        "completed_batches": w % 5, "total_batches": F.col("messages") - 2,
        "stored_percent": F.when(w % 3 == 0, w * 1.5),
    })
    return rn.run_progress_percent(runs).select("id", "percent")


@query(
    "progress_rollup",
    o.sql(
        "SELECT run_id, kind AS stage, CAST(least(100, greatest(0, worker * 2 - 20)) AS BIGINT) AS progress FROM run_events"
        " QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1", "run_events",
    ),
)
def progress_rollup(c: Corpus):
    events = c.run_events.select(
        "run_id", "ts", "event_id", F.col("kind").alias("stage"), (F.col("worker") * 2 - 20).alias("progress")
    )
    return rn.progress_rollup(events).select("run_id", "stage", "progress")


@query(
    "source_coverage",
    o.sql(
        "SELECT a.paper_id, round(coalesce(n, 0) / m, 6) AS source_coverage FROM (SELECT paper_id, count(*) AS m FROM"
        " passages GROUP BY 1) a LEFT JOIN (SELECT p.paper_id, count(DISTINCT p.id) AS n FROM card_sources s JOIN passages p ON"
        " p.id = s.passage_id AND p.paper_id = s.paper_id GROUP BY 1) b USING (paper_id)", "passages", "card_sources",
    ),
)
def source_coverage(c: Corpus):
    covered = rn.source_coverage(c.cards, c.passages).filter("source_coverage is not null")
    return covered.select("paper_id", F.round("source_coverage", 6).alias("source_coverage"))


@query(
    "analysis_quality",
    o.sql(
        "SELECT paper_id, ok AS accepted_card_count, CAST(no AS BIGINT) AS rejected_card_count, concat_ws('|', CASE WHEN num %"
        " 2 = 1 THEN 'no_paper_understanding_generated' END, CASE WHEN no > 0 THEN no || ' derived cards rejected' END) AS"
        " warnings, coalesce(diag, '') AS diagnostics FROM (SELECT paper_id, CAST(split_part(paper_id, '-', 2) AS BIGINT) AS"
        " num, count(*) FILTER (reason = '') AS ok, count(*) FILTER (reason <> '') AS no FROM cards JOIN jd USING (id) GROUP BY"
        " 1) LEFT JOIN (SELECT paper_id, string_agg(reason || '=' || n, '|' ORDER BY reason) AS diag FROM (SELECT paper_id,"
        " reason, count(*) AS n FROM cards JOIN jd USING (id) WHERE reason <> '' GROUP BY 1, 2) GROUP BY 1) USING (paper_id)",
        "cards", "passages", **JUDGED,
    ),
)
def analysis_quality(c: Corpus):
    understood = c.papers.filter(d % 2 == 0).select(F.col("id").alias("paper_id"), "space_id")
    text = F.transform(F.map_entries("diagnostics"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rn.analysis_quality(cd.verify_cards(c.cards, c.passages), understood).select(
        "paper_id", "accepted_card_count", "rejected_card_count", F.array_join("warnings", "|").alias("warnings"),
        F.coalesce(F.array_join(text, "|"), F.lit("")).alias("diagnostics"),
    )


# ---------------------------------------------------------------- validation

@query(
    "validate_passages",
    o.sql(
        "SELECT 'duplicate content_hash' AS rule, paper_id, content_hash AS row FROM passages GROUP BY ALL HAVING count(*) > 1"
        " UNION ALL SELECT 'passage references unknown element', paper_id, id FROM passages WHERE paragraph_index % 6 = 5 UNION"
        " ALL SELECT 'table references unknown element', paper_id, 't-' || id FROM elements WHERE element_type = 'table' AND"
        " element_index % 4 = 0 UNION ALL SELECT 'duplicate element id', paper_id, id FROM elements WHERE element_index % 50 ="
        " 7", "passages", "elements",
    ),
)
def validate_passages(c: Corpus):
    """Planted faults: some passages and tables name foreign elements, some elements come twice."""
    index = F.col("paragraph_index")
    e_id = F.concat("paper_id", F.lit("-e"), index)
    passages = c.passages.withColumn("element_ids", F.array(F.when(index % 6 == 5, "ghost").otherwise(e_id)))
    tables = tables_of(c).withColumn(
        "element_id", F.when(F.regexp_extract("element_id", "e([0-9]+)$", 1).cast("int") % 4 == 0, "ghost").otherwise(F.col("element_id"))
    )
    elements = c.elements.unionByName(c.elements.filter("element_index % 50 = 7"))
    return rn.validate_parse(passages, elements, tables)


@query(
    "validate_run_scope",
    o.sql("SELECT id FROM cards WHERE card_index % 3 <> 0 AND card_index % 3 <> 2", "cards"),
)
def validate_run_scope(c: Corpus):
    """Cards of a run per paper; a third name another paper's run, a third none."""
    papers = c.cards.select("paper_id", "space_id").distinct()
    runs = papers.withColumn("id", F.concat(F.lit("ar-"), "paper_id"))
    index = F.col("card_index")
    cards = c.cards.withColumn(
        "analysis_run_id",
        F.when(index % 3 == 0, F.concat(F.lit("ar-"), "paper_id")).when(index % 3 == 1, F.lit("ar-elsewhere")),
    )
    return rn.validate_run_scope(cards, runs).select("id")


REMAP = dict(
    mv="SELECT o.paper_id, o.id AS old_id, max(n.id) AS new_id FROM passages o LEFT JOIN (SELECT paper_id, content_hash, 'second-'"
    " || doc_id || ':' || id AS id FROM passages WHERE paragraph_index % 4 <> 2) n ON n.paper_id = o.paper_id AND"
    " n.content_hash = o.content_hash WHERE o.parse_run_id IS NOT NULL GROUP BY 1, 2",
)


@query(
    "remap_by_hash",
    o.sql(
        "SELECT 'card' AS kind, k.id, coalesce(CASE WHEN m.old_id IS NULL THEN source_passage_id ELSE m.new_id END, '') AS"
        " single, coalesce((SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT i, CASE WHEN mv.old_id IS NULL THEN s ELSE"
        " mv.new_id END AS x FROM (SELECT unnest(k.source_passage_ids) AS s, unnest(range(len(k.source_passage_ids))) AS i) u"
        " LEFT JOIN mv ON mv.old_id = u.s) WHERE x IS NOT NULL), '') AS listed FROM cards k LEFT JOIN mv m ON m.old_id ="
        " k.source_passage_id UNION ALL SELECT 'link', min(s.id), coalesce(mv.new_id, s.passage_id), '' FROM card_sources s LEFT"
        " JOIN mv ON mv.old_id = s.passage_id WHERE mv.old_id IS NULL OR mv.new_id IS NOT NULL GROUP BY s.card_id,"
        " coalesce(mv.new_id, s.passage_id)", "card_sources", "passages", **REMAP,
    ),
)
def remap_by_hash(c: Corpus):
    """A second parse that lost every fourth passage."""
    keys = ["paper_id", "space_id", "content_hash"]
    old = c.passages.filter("parse_run_id is not null").select("id", *keys)
    new = c.passages.filter("paragraph_index % 4 <> 2").withColumn(
        "id", F.concat(F.lit("second-"), number, F.lit(":"), "id")
    ).select("id", *keys)
    cards, links = rn.remap_by_hash(old, new, c.cards, c.card_sources)
    return cards.select(
        F.lit("card").alias("kind"), "id", F.coalesce("source_passage_id", F.lit("")).alias("single"),
        F.array_join("source_passage_ids", ",").alias("listed"),
    ).unionByName(links.select(
        F.lit("link").alias("kind"), "id", F.col("passage_id").alias("single"), F.lit("").alias("listed")
    ))


# ---------------------------------------------------------------- evaluation

@query(
    "stable_sources",
    o.sql(
        "SELECT paper_id, CAST(sum(CASE WHEN paragraph_index % 5 <> 3 THEN 1 ELSE 0 END) AS BIGINT) AS stable, count(*) AS total,"
        " round(sum(CASE WHEN paragraph_index % 5 <> 3 THEN 1 ELSE 0 END) / count(*), 6) AS stable_source_ratio FROM passages"
        " GROUP BY 1", "passages",
    ),
)
def stable_sources(c: Corpus):
    """Every fifth line reads differently in the second parse."""
    second = c.passages.withColumn(
        "original_text",
        F.when(F.col("paragraph_index") % 5 == 3, F.concat("original_text", F.lit("!"))).otherwise(F.col("original_text")),
    )
    return rn.stable_sources(c.passages, second)


def eval_inputs(c: Corpus):
    """Both parses are chunked once and stored; the second lost every twentieth element."""
    elements = headed(c)
    read = ["paper_id", "section", "heading_path", "page_number", "paragraph_index", "original_text", "token_count", "table_id"]
    first = store_rows(chunks(c).select(*read), "first")
    second = store_rows(ck.chunk_documents(elements.filter("element_index % 20 <> 13"), tables_of(c)).select(*read), "second")
    expected = c.elements.filter("element_type = 'heading' and text <> ''").select(
        "paper_id", F.when(F.col("element_index") % 4 == 3, F.lit("nowhere")).otherwise(F.col("text")).alias("heading")
    )
    terms = c.papers.select(
        F.col("id").alias("paper_id"), F.array(F.lit("table 12 "), F.lit("table 38")).alias("table_terms"),
        F.array(F.lit("zz")).alias("reference_terms"),
    )
    outcomes = c.papers.select(F.col("id").alias("paper_id"), (F.col("parse_status") == "parsed").alias("success"))
    return first, second, elements, expected, terms, outcomes


SECOND = {
    f"{name}_second": re.sub(r"\b(body|num|fold|grp|tail|cuts|psg|psg2)\b", r"\1_second", text)
    for name, text in CHUNKS.items() if name not in ("flat", "body")
}
SECOND = {"body_second": "SELECT * FROM body WHERE element_index % 20 <> 13", **SECOND}


@query(
    "parse_eval_metrics",
    o.sql(
        "SELECT (SELECT round(avg(r), 6) FROM (SELECT round(count(*) FILTER (element_index % 4 <> 3) / count(*), 6) AS r FROM"
        " elements WHERE element_type = 'heading' AND text <> '' GROUP BY paper_id)) AS heading_recall, (SELECT round(avg(CASE"
        " WHEN coalesce(m, 0) = 0 THEN 0.0 WHEN cov = 2 AND m = ins THEN 1.0 ELSE cov / 2 END), 6) FROM papers LEFT JOIN (SELECT"
        " paper_id, count(*) FILTER (t12"
        " OR t38) AS m, count(*) FILTER ((t12 OR t38) AND grid) AS ins, CAST(coalesce(bool_or(t12 AND grid), FALSE) AS INT) +"
        " CAST(coalesce(bool_or(t38 AND grid), FALSE) AS INT) AS cov FROM (SELECT *, contains(lower(txt), 'table 12 ') AS t12,"
        " contains(lower(txt), 'table 38') AS t38, is_table AND CAST(regexp_extract(ids[1], 'e([0-9]+)$', 1) AS INT) % 2 = 0"
        " AS grid FROM psg2) GROUP BY 1) ON paper_id = papers.id) AS table_isolation, (SELECT round(avg(coalesce(r, 1.0)), 6) FROM"
        " papers LEFT JOIN (SELECT paper_id, round(count(*) FILTER (NOT"
        " contains(lower(txt), 'zz')) / count(*), 6) AS r FROM psg2 GROUP BY paper_id) ON paper_id = papers.id) AS"
        " reference_filter_precision, (SELECT round(avg(coalesce(r, 1.0)), 6) FROM papers LEFT JOIN (SELECT paper_id,"
        " round(sum(least(a, b)) / greatest(sum(a), sum(b)), 6) AS r FROM (SELECT paper_id, sum(a) AS a, sum(b) AS b FROM (SELECT"
        " paper_id, heading_path, p0, idx, txt, 1 AS a, 0 AS b FROM psg2 UNION ALL SELECT paper_id, heading_path, p0, idx, txt, 0, 1"
        " FROM psg2_second) GROUP BY paper_id, heading_path, p0, idx, txt) GROUP BY 1) ON paper_id = papers.id) AS"
        " stable_source_ratio, (SELECT"
        f" count(*) FROM psg2 WHERE {o.tokens_n('txt')} > 900) AS max_token_violation_count, (SELECT round(count(*) FILTER"
        " (parse_status = 'parsed') / count(*), 6) FROM papers) AS parse_success_rate", "elements", "papers", recursive=True,
        **CHUNKS, **SECOND,
    ),
)
def parse_eval_metrics(c: Corpus):
    return rn.parse_eval_metrics(*eval_inputs(c), max_tokens=900)


@query(
    "analysis_eval_metrics",
    o.sql(
        "SELECT (SELECT round(count(*) FILTER (reason <> 'invalid_card') / count(*), 6) FROM jd) AS schema_validity_rate, (SELECT"
        " round(count(*) FILTER (reason = '') / count(*) FILTER (reason <> 'invalid_card'), 6) FROM jd) AS source_grounding_rate,"
        " (SELECT round((SELECT count(*) FROM t a JOIN t b ON a.paper_id = b.paper_id AND a.card_type = b.card_type AND a.id <"
        f" b.id AND len(list_intersect(a.source_passage_ids, b.source_passage_ids)) > 0 WHERE {SIM} >= 0.75) / (count(*) *"
        " (count(*) - 1) / 2), 6) FROM cards) AS duplicate_card_rate, 1.0::DOUBLE AS user_card_preservation_rate, (SELECT round("
        "count(*) FILTER (c.pid IS NOT NULL) / count(*), 6) FROM late LEFT JOIN (SELECT DISTINCT pid FROM ex JOIN jd USING (id)"
        " WHERE reason = '') c ON c.pid = late.passage_id) AS late_section_coverage", "cards", "passages", **JUDGED,
        t=f"SELECT *, list_distinct({TOKENS}) AS tk FROM cards",
        late="SELECT DISTINCT p.id AS passage_id FROM passages p JOIN cards k ON k.paper_id = p.paper_id WHERE p.paragraph_index"
        " <= 3 AND p.section NOT IN ('References')",
    ),
)
def analysis_eval_metrics(c: Corpus):
    """Cards are made and stored once, and so are the passages of papers that have cards: no other is cited or late.

    The batches are those of these papers, whole.
    """
    cards = store_rows(c.cards, "cards")
    passages = store_rows(c.passages.join(cards.select("paper_id").distinct(), "paper_id", "left_semi"), "passages")
    verdicts = store_rows(cd.verify_cards(cards, passages), "verdicts")
    pairs = cd.duplicate_card_pairs(cards)
    new = verdicts.filter("accepted").withColumn("id", F.concat(F.lit("new-"), "id"))
    after, _ = cd.replace_ai_cards(cards, c.card_sources, new, F.lit("run-2"), NOW)
    late = passages.filter("paragraph_index <= 3 and section <> 'References'").select(
        "paper_id", F.col("id").alias("passage_id")
    )
    batches = an.analysis_batches(an.prepared_passages(passages, BUDGET), BUDGET)
    return rn.analysis_eval_metrics(verdicts, pairs, cards, after, late, batches)


__all__ = ["an"]
