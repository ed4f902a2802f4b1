"""Streams run to the end of the given tables; their tables are compared with batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrain.operators import embeddings as em
from leafgrain.operators.keyed import work_dir
from leafgrain.plans import oracle_base as o
from leafgrain.plans.chunk_queries import CHUNK_COLUMNS, CHUNKS, chunks
from leafgrain.plans.corpus import MODEL, PROVIDER, Corpus
from leafgrain.plans.element_queries import REGISTERED, files_of, known_papers
from leafgrain.plans.registry import query, setup
from leafgrain.plans.search_queries import HASHED, stored_vectors
from leafgrain.sources.versions import Versions
from leafgrain.streaming import streams as st

@setup
def columns() -> None:
    global NOW
    NOW = F.lit("2024-02-01 00:00:00").cast("timestamp")


class BatchCorpus(Corpus):
    """The corpus of one micro-batch of documents."""

    def __init__(self, base: Corpus, documents: DataFrame):
        super().__init__(documents.sparkSession, base.root)
        self.documents = documents


def stream_of(c: Corpus, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern may name either, a plain path only a folder.

    All its files arrive together. Their order says nothing: one by one, rows of an older time would come too late.
    """
    return c.spark.readStream.schema(c.table(name).schema).parquet(f"{c.root}/{name}.parque[t]")


def events_of(c: Corpus) -> DataFrame:
    live = Corpus(c.spark, c.root)
    live.table = lambda name: stream_of(c, name)
    return live.run_events


def finish(q) -> None:
    q.awaitTermination()


@query("stream_register_documents", REGISTERED)
def stream_register_documents(c: Corpus):
    root = work_dir(c.spark, "register")
    known = known_papers(c).withColumn("title", F.lit(""))
    st.write_batch(known, f"{root}/papers", -1)
    files = files_of(BatchCorpus(c, stream_of(c, "documents")))
    finish(st.stream_register_documents(files, f"{root}/papers", f"{root}/report", f"{root}/state"))
    return c.spark.read.parquet(f"{root}/report").drop("batch_id")


@query("stream_chunk_and_index", o.sql(CHUNK_COLUMNS, "elements", recursive=True, **CHUNKS))
def stream_chunk_and_index(c: Corpus):
    root = work_dir(c.spark, "chunk")
    finish(st.stream_chunk_and_index(
        stream_of(c, "documents"), lambda batch: chunks(BatchCorpus(c, batch)), f"{root}/passages",
        f"{root}/postings", f"{root}/state",
    ))
    return c.spark.read.parquet(f"{root}/passages").select(
        "id", "paper_id", "paragraph_index", "content_hash", "page_number", "original_text", "passage_type",
        F.array_join("element_ids", ",").alias("element_ids"), "section", "token_count",
    )


@query("stream_replace_passages", o.sql(
    f"{CHUNK_COLUMNS} WHERE paper_id NOT IN (SELECT 'doc-' || doc_id FROM documents WHERE CAST(substr(source, 4, 9) AS INT) % 7 = 6)",
    "elements", recursive=True, **CHUNKS,
))
def stream_replace_passages(c: Corpus):
    """Every document arrives as a draft in capitals, then as it is; those of deleted spaces are withdrawn at the second time."""
    root = work_dir(c.spark, "replace")
    versions = Versions(c.spark, f"{root}/versions")
    gone = c.spaces.filter("status = 'deleted'").select(F.col("id").alias("source"), F.lit(True).alias("_gone"))
    drafts = c.documents.withColumns({"text": F.upper("text"), "withdrawn": F.lit(False)})
    final = c.documents.join(gone, "source", "left").withColumn("withdrawn", F.coalesce("_gone", F.lit(False)))

    def papers(batch: DataFrame) -> DataFrame:
        return batch.select(F.concat(F.lit("doc-"), "doc_id").alias("paper_id"), F.col("source").alias("space_id"), F.col("withdrawn").alias("deleted"))

    for step, arriving in enumerate((drafts, final)):
        arriving.select(*drafts.columns).write.parquet(f"{root}/in/{step}")
        stream = c.spark.readStream.schema(drafts.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        finish(st.stream_replace_passages(
            stream, lambda batch: chunks(BatchCorpus(c, batch.drop("withdrawn"))), papers, versions, f"{root}/state",
        ))
    return versions.current("passages").select(
        "id", "paper_id", "paragraph_index", "content_hash", "page_number", "original_text", "passage_type",
        F.array_join("element_ids", ",").alias("element_ids"), "section", "token_count",
    )


@query(
    "stream_embedding_delta",
    o.sql(
        "SELECT run AS parse_run_id, count(*) AS passage_count, count(*) FILTER (action = 'embed') AS"
        " embedded_count, count(*) FILTER (action = 'reuse') AS reused_count, count(*) FILTER"
        " (action = 'skip') AS skipped_count FROM plan GROUP BY 1", "passages", "emb", **HASHED,
    ),
)
def stream_embedding_delta(c: Corpus):
    root = work_dir(c.spark, "embed")
    finish(st.stream_embedding_delta(
        stream_of(c, "documents"),
        lambda batch: BatchCorpus(c, batch).passages,
        stored_vectors(c), em.hashing_encoder(64), PROVIDER, MODEL, NOW, f"{root}/vectors",
        f"{root}/stats", f"{root}/state",
    ))
    run = F.coalesce("parse_run_id", F.lit("")).alias("parse_run_id")
    return c.spark.read.parquet(f"{root}/stats").groupBy(run).agg(*[
        F.sum(n).alias(n) for n in ("passage_count", "embedded_count", "reused_count", "skipped_count")
    ])


STATES = dict(
    ev="SELECT run_id, kind, 'error of ' || worker AS error, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id)"
    " AS n FROM run_events WHERE kind <> 'heartbeat'",
    tr="SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{t}')" for (a, b), t in st.TRANSITIONS.items())
    + ") v(a, b, t)",
    walk="SELECT run_id, 0 AS n, '' AS status, 0 AS attempt_count, '' AS last_error, 0 AS violations FROM ev WHERE n = 1"
    " UNION ALL SELECT w.run_id, ev.n, coalesce(t, status), attempt_count + CASE WHEN t IS NOT NULL AND kind = 'claimed'"
    " THEN 1 ELSE 0 END, CASE WHEN t IS NULL THEN last_error WHEN kind = 'claimed' THEN '' WHEN kind = 'failed' THEN error"
    " ELSE last_error END, violations + CASE WHEN t IS NULL THEN 1 ELSE 0 END FROM walk w JOIN ev ON ev.run_id = w.run_id"
    " AND ev.n = w.n + 1 LEFT JOIN tr ON tr.a = w.status AND tr.b = ev.kind",
)
STATE_SQL = o.sql(
    "SELECT run_id, status, CAST(attempt_count AS BIGINT) AS attempt_count, last_error, CAST(violations AS BIGINT) AS"
    " violations FROM walk QUALIFY n = max(n) OVER (PARTITION BY run_id)", "run_events", recursive=True, **STATES,
)


def with_error(events: DataFrame) -> DataFrame:
    return events.withColumn("error", F.concat(F.lit("error of "), "worker"))


@query("run_states", STATE_SQL)
def run_states(c: Corpus):
    return st.run_states(with_error(c.run_events))


@query("run_state_stream", STATE_SQL)
def run_state_stream(c: Corpus):
    """State after the last micro-batch that touched each run; messages arrive in several, up to an hour late.

    Each quarter is written when those before it are done, as files of one folder would be read in any order.
    """
    root = work_dir(c.spark, "states")
    events = with_error(c.run_events).select("run_id", "ts", "event_id", "kind", "error")
    arrived = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3_600_000_000))
    first, last = events.agg(F.min(arrived), F.max(arrived)).first()
    quarter = F.floor((arrived - F.lit(first)) * 4 / F.lit((last or 0) - (first or 0) + 1)).cast("int")
    dealt = events.withColumn("_quarter", F.coalesce(quarter, F.lit(0)))
    for step in range(4):
        dealt.filter(F.col("_quarter") == step).drop("_quarter").write.parquet(f"{root}/in/{step}")
        live = c.spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        live = st.run_state_stream(live, "2 hours")
        finish(st.start(live, lambda b, i: st.write_batch(b, f"{root}/out", i), f"{root}/state", "update"))
    rows = c.spark.read.parquet(f"{root}/out")
    fields = F.struct("status", "attempt_count", "last_error", "violations")
    return rows.groupBy("run_id").agg(F.max_by(fields, "batch_id").alias("s")).select("run_id", "s.*")


@query(
    "stale_runs_stream",
    o.sql(
        "SELECT id AS run_id, attempt_count, CASE WHEN attempt_count >= 3 THEN 'failed' ELSE 'queued' END AS status FROM runs"
        " WHERE status = 'running' AND seen_at + INTERVAL 600 SECOND < (SELECT max(ts) FROM run_events) - INTERVAL 10 MINUTE",
        "runs",
    ),
)
def stale_runs_stream(c: Corpus):
    root = work_dir(c.spark, "stale")
    live = st.stale_runs_stream(events_of(c).select("run_id", "ts", "event_id", "kind"))
    finish(st.start(live, lambda b, i: st.write_batch(b, f"{root}/out", i), f"{root}/state"))
    return c.spark.read.parquet(f"{root}/out").select("run_id", "attempt_count", "status")


@query(
    "stream_progress_rollup",
    o.sql(
        "SELECT run_id, kind AS stage, CAST(least(100, greatest(0, worker * 2 - 20)) AS BIGINT) AS progress FROM run_events"
        " QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1", "run_events",
    ),
)
def stream_progress_rollup(c: Corpus):
    root = work_dir(c.spark, "progress")
    events = events_of(c).select(
        "run_id", "ts", "event_id", F.col("kind").alias("stage"), (F.col("worker") * 2 - 20).alias("progress")
    )
    live = st.stream_progress_rollup(events)
    finish(st.start(live, lambda b, i: st.write_batch(b, f"{root}/out", i), f"{root}/state", "update"))
    rows = c.spark.read.parquet(f"{root}/out")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("stage", "progress"), "batch_id").alias("p")).select(
        "run_id", "p.*"
    )
