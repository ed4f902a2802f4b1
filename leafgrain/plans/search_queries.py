"""Queries over the search and embedding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrain.functions import text as tx
from leafgrain.operators import embeddings as em
from leafgrain.operators import retrieval as rt
from leafgrain.operators import search_index as si
from leafgrain.operators import vector_index as vi
from leafgrain.operators.keyed import store_rows, work_dir
from leafgrain.plans import oracle_base as o
from leafgrain.plans.corpus import MODEL, PROVIDER, Corpus
from leafgrain.plans.registry import query, stamp

FIELD_TERMS = o.word_list(o.fold("concat_ws(' ', section, original_text)"))
POSTINGS = dict(
    toks=f"SELECT id AS passage_id, paper_id, space_id, {FIELD_TERMS} AS t FROM passages",
    postings="SELECT term, passage_id, paper_id, space_id, len(t) AS length, count(*) AS tf FROM"
    " (SELECT *, unnest(t) AS term FROM toks) GROUP BY ALL",
)
SCORED = dict(
    **POSTINGS,
    stats="SELECT count(*) AS n, avg(len(t)) AS mean FROM toks WHERE len(t) > 0",
    dfs="SELECT term, count(*) AS df FROM postings GROUP BY 1",
    qt=f"SELECT query_id, space_id, {o.fold('w')} AS term, count(*) AS weight FROM (SELECT *,"
    f" unnest({o.word_list('query')}) AS w FROM q) GROUP BY ALL",
    qn="SELECT query_id, count(*) AS n_terms FROM qt GROUP BY 1",
    hits="SELECT qt.query_id, p.passage_id, p.paper_id, p.space_id, round(-sum(weight *"
    " greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 *"
    " length / mean))), 6) AS fts_score, count(*) = any_value(n_terms) AS strict FROM qt JOIN postings p"
    " ON p.term = qt.term AND p.space_id = qt.space_id JOIN dfs ON dfs.term = qt.term"
    " JOIN qn ON qn.query_id = qt.query_id, stats GROUP BY 1, 2, 3, 4",
    allowed="SELECT * FROM hits h WHERE strict OR NOT EXISTS (SELECT 1 FROM hits s WHERE"
    " s.query_id = h.query_id AND s.strict)",
    ranked="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fts_score, passage_id)"
    " AS fts_rank FROM allowed",
)


def search_parts(c: Corpus):
    return rt.search_tables(c.passages)[:2]


@query(
    "build_postings",
    o.sql("SELECT term, passage_id, CAST(length AS BIGINT) AS length, tf FROM postings",
          "passages", **POSTINGS),
)
def build_postings(c: Corpus):
    return rt.build_postings(c.passages).select("term", "passage_id", "length", "tf")


@query(
    "fts_search",
    o.sql("SELECT query_id, passage_id, fts_score, fts_rank FROM ranked WHERE fts_rank <= 50",
          "passages", "q", **SCORED),
)
def fts_search(c: Corpus):
    postings, stats = search_parts(c)
    return rt.fts_rank(c.queries, postings, stats, 50).select(
        "query_id", "passage_id", "fts_score", "fts_rank"
    )


@query(
    "fts_topk",
    o.sql("SELECT query_id, passage_id, fts_rank FROM ranked WHERE fts_rank <= 5",
          "passages", "q", **SCORED),
)
def fts_topk(c: Corpus):
    postings, stats = search_parts(c)
    return rt.fts_rank(c.queries, postings, stats, 5).select("query_id", "passage_id", "fts_rank")


@query(
    "fts_results",
    o.sql(
        "SELECT query_id, passage_id, section, page_number, paragraph_index, title AS paper_title"
        " FROM ranked JOIN passages p ON p.id = passage_id JOIN papers ON papers.id = p.paper_id"
        " WHERE fts_rank <= 10", "passages", "papers", "q", **SCORED,
    ),
)
def fts_results(c: Corpus):
    postings, stats = search_parts(c)
    hits = rt.fts_rank(c.queries, postings, stats, 10)
    return rt.fts_results(hits, c.queries, c.passages, c.papers).select(
        "query_id", "passage_id", "section", "page_number", "paragraph_index", "paper_title"
    )


@query(
    "fts_snippets",
    o.sql(
        "SELECT query_id, passage_id, snippet FROM shown", "passages", "papers", "q", **SCORED,
        hit="SELECT query_id, passage_id, original_text AS body, (SELECT list(term) FROM qt WHERE qt.query_id ="
        " ranked.query_id) AS terms FROM ranked JOIN passages p ON p.id = passage_id WHERE fts_rank <= 10",
        **o.best_window("hit", "query_id, passage_id"),
    ),
)
def fts_snippets(c: Corpus):
    """Highlighted best windows of the hits."""
    postings, stats = search_parts(c)
    hits = rt.fts_rank(c.queries, postings, stats, 10)
    return rt.fts_results(hits, c.queries, c.passages, c.papers).select(
        "query_id", "passage_id", "snippet"
    )


@query(
    "stored_fts_search",
    o.sql("SELECT query_id, passage_id, fts_score, fts_rank FROM ranked WHERE fts_rank <= 50",
          "passages", "q", **SCORED),
)
def stored_fts_search(c: Corpus):
    """The index is written, read back, and searched by the blocks that can win."""
    index = si.write_search_index(c.passages, work_dir(c.spark, "index"))
    return si.search(index, c.queries, 50).select("query_id", "passage_id", "fts_score", "fts_rank")


@query("fts_blocks_read")
def fts_blocks_read(c: Corpus):
    """How many of a query's blocks a search by any term reads; how many it may leave is checked in the tests."""
    return si.blocks_read(si.write_search_index(c.passages, work_dir(c.spark, "index")), c.queries, 10)


COSINE = "round(list_cosine_similarity(qv.vector, emb.embedding), 6)"
VECTORS = dict(
    vec=f"SELECT qv.query_id, emb.passage_id, {COSINE} AS semantic_score FROM qv JOIN passages p"
    " ON p.space_id = qv.space_id JOIN emb ON emb.passage_id = p.id",
    vrank="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC,"
    " passage_id) AS semantic_rank FROM vec",
)


@query(
    "vector_search",
    o.sql("SELECT query_id, passage_id, semantic_score, semantic_rank FROM vrank WHERE"
          " semantic_rank <= 50", "passages", "qv", "emb", **VECTORS),
)
def vector_search(c: Corpus):
    return rt.vector_rank(c.query_vectors, c.embeddings, c.passages, 50)


@query(
    "stored_vector_search",
    o.sql("SELECT query_id, passage_id, semantic_score, semantic_rank FROM vrank WHERE"
          " semantic_rank <= 50", "passages", "qv", "emb", **VECTORS),
)
def stored_vector_search(c: Corpus):
    """Inverted lists are written, read back, and opened as far as their bounds demand."""
    index = vi.write_vector_index(c.embeddings, c.passages, work_dir(c.spark, "lists"))
    return vi.search(index, c.query_vectors, 50)


@query(
    "vector_topk",
    o.sql("SELECT query_id, passage_id, semantic_rank FROM vrank WHERE semantic_rank <= 3",
          "passages", "qv", "emb", **VECTORS),
)
def vector_topk(c: Corpus):
    return rt.vector_rank(c.query_vectors, c.embeddings, c.passages, 3).drop("semantic_score")


@query(
    "vector_results",
    o.sql(
        f"SELECT query_id, passage_id, semantic_score, section, {o.snippet('original_text')} AS"
        " snippet, title AS paper_title FROM vrank JOIN passages p ON p.id = passage_id JOIN papers"
        " ON papers.id = p.paper_id WHERE semantic_rank <= 10",
        "passages", "papers", "qv", "emb", **VECTORS,
    ),
)
def vector_results(c: Corpus):
    ranked = rt.vector_rank(c.query_vectors, c.embeddings, c.passages, 10)
    return rt.vector_results(ranked, c.passages, c.papers).select(
        "query_id", "passage_id", "semantic_score", "section", "snippet", "paper_title"
    )


@query(
    "restrict_to_candidates",
    o.sql(
        f"SELECT r.query_id, r.passage_id, {COSINE} AS semantic_score, row_number() OVER (PARTITION"
        " BY r.query_id ORDER BY " + COSINE + " DESC, r.passage_id) AS semantic_rank FROM ranked r"
        " JOIN qv ON qv.query_id = r.query_id JOIN emb ON emb.passage_id = r.passage_id"
        " WHERE fts_rank <= 200", "passages", "q", "qv", "emb", **SCORED,
    ),
)
def restrict_to_candidates(c: Corpus):
    postings, stats = search_parts(c)
    pool = rt.fts_rank(c.queries, postings, stats, 200)
    return rt.vector_rank_candidates(c.query_vectors, c.embeddings, pool, 200)


RRF_SQL = (
    "coalesce(1.0 / (60 + f.fts_rank), 0) + coalesce(1.0 / (60 + s.semantic_rank), 0)"
)


@query(
    "reciprocal_rank_fusion",
    o.sql(
        "SELECT query_id, passage_id, section, rrf_score, rank FROM (SELECT *, row_number() OVER"
        " (PARTITION BY query_id ORDER BY raw DESC, best, passage_id) AS rank, round(raw, 9) AS"
        " rrf_score FROM (SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.passage_id,"
        " s.passage_id) AS passage_id, coalesce(nullif(p1.section, ''), p2.section) AS section, "
        + RRF_SQL + " AS raw, least(f.fts_rank, s.semantic_rank) AS best FROM (SELECT * FROM ranked"
        " WHERE fts_rank <= 30) f FULL JOIN (SELECT * FROM vrank WHERE semantic_rank <= 30) s ON"
        " f.query_id = s.query_id AND f.passage_id = s.passage_id LEFT JOIN passages p1 ON p1.id ="
        " f.passage_id LEFT JOIN passages p2 ON p2.id = s.passage_id)) WHERE rank <= 20",
        "passages", "q", "qv", "emb", **SCORED, **VECTORS,
    ),
)
def reciprocal_rank_fusion(c: Corpus):
    postings, stats = search_parts(c)
    sections = c.passages.select(F.col("id").alias("passage_id"), "section")
    fts = rt.fts_rank(c.queries, postings, stats, 30).join(sections, "passage_id")
    semantic = rt.vector_rank(c.query_vectors, c.embeddings, c.passages, 30).join(
        sections, "passage_id"
    )
    return rt.reciprocal_rank_fusion(fts, semantic, 20, fields=["section"]).select(
        "query_id", "passage_id", "section", F.round("rrf_score", 9).alias("rrf_score"), "rank"
    )


@query(
    "rank_hits",
    o.sql(
        "SELECT 'fts' AS list, query_id, passage_id, fts_rank AS rank FROM ranked WHERE fts_rank <= 30 UNION ALL SELECT"
        " 'semantic', query_id, passage_id, semantic_rank FROM vrank WHERE semantic_rank <= 30",
        "passages", "q", "qv", "emb", **SCORED, **VECTORS,
    ),
)
def rank_hits(c: Corpus):
    postings, stats = search_parts(c)
    fts = rt.fts_rank(c.queries, postings, stats, 30)
    semantic = rt.vector_rank(c.query_vectors, c.embeddings, c.passages, 30)
    return fts.select(F.lit("fts").alias("list"), "query_id", "passage_id", F.col("fts_rank").alias("rank")).unionByName(
        semantic.select(
            F.lit("semantic").alias("list"), "query_id", "passage_id", F.col("semantic_rank").alias("rank")
        )
    )


@query(
    "rrf_join",
    o.sql(
        "SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.passage_id, s.passage_id) AS passage_id,"
        " coalesce(fts_rank, -1) AS fts_rank, coalesce(semantic_rank, -1) AS semantic_rank, coalesce(nullif(p1.section,"
        " ''), p2.section, '') AS section FROM (SELECT * FROM ranked WHERE fts_rank <= 30) f FULL JOIN (SELECT * FROM vrank"
        " WHERE semantic_rank <= 30) s ON f.query_id = s.query_id AND f.passage_id = s.passage_id LEFT JOIN passages p1 ON"
        " p1.id = f.passage_id LEFT JOIN passages p2 ON p2.id = s.passage_id",
        "passages", "q", "qv", "emb", **SCORED, **VECTORS,
    ),
)
def rrf_join(c: Corpus):
    postings, stats = search_parts(c)
    sections = c.passages.select(F.col("id").alias("passage_id"), "section")
    fts = rt.fts_rank(c.queries, postings, stats, 30).join(sections, "passage_id")
    semantic = rt.vector_rank(c.query_vectors, c.embeddings, c.passages, 30).join(sections, "passage_id")
    return rt.rrf_join(fts, semantic, ["section"]).select(
        "query_id", "passage_id", F.coalesce("fts_rank", F.lit(-1)).alias("fts_rank"),
        F.coalesce("semantic_rank", F.lit(-1)).alias("semantic_rank"),
        F.coalesce("section", F.lit("")).alias("section"),
    )


@query(
    "enrich_passages",
    o.sql(
        "SELECT k.id AS card_id, passage_id, coalesce(p.parse_run_id, '') AS parse_run_id, coalesce(p.parser_backend, '') AS"
        " parser_backend, coalesce(array_to_string(p.heading_path, ' > '), '') AS headings FROM (SELECT id, space_id,"
        " unnest(source_passage_ids) AS passage_id FROM cards) k LEFT JOIN passages p ON p.id = k.passage_id AND p.space_id ="
        " k.space_id", "cards", "passages",
    ),
)
def enrich_passages(c: Corpus):
    """Every citation of every card; ids that are no passage keep empty provenance."""
    cited = c.cards.select(F.col("id").alias("card_id"), "space_id", F.explode("source_passage_ids").alias("passage_id"))
    return rt.enrich_passages(cited, c.passages).select(
        "card_id", "passage_id", F.coalesce("parse_run_id", F.lit("")).alias("parse_run_id"),
        F.coalesce("parser_backend", F.lit("")).alias("parser_backend"),
        F.coalesce(F.array_join("heading_path", " > "), F.lit("")).alias("headings"),
    )


HYBRID = dict(
    **SCORED, **VECTORS,
    has="SELECT DISTINCT space_id FROM emb JOIN passages p ON p.id = emb.passage_id",
    modes="SELECT query_id, mode = 'hybrid' OR (mode = 'auto' AND space_id IN (SELECT space_id FROM"
    " has)) AS hybrid FROM q",
    pool="SELECT r.*, hybrid FROM ranked r JOIN modes USING (query_id) WHERE fts_rank <= 200",
    sem="SELECT v.* FROM vec v JOIN modes m USING (query_id) WHERE m.hybrid AND (NOT EXISTS (SELECT 1"
    " FROM pool WHERE pool.query_id = v.query_id) OR EXISTS (SELECT 1 FROM pool WHERE"
    " pool.query_id = v.query_id AND pool.passage_id = v.passage_id))",
    s="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, passage_id)"
    " AS semantic_rank FROM sem QUALIFY semantic_rank <= 200",
    fused="SELECT query_id, passage_id, fts_rank, semantic_rank, row_number() OVER (PARTITION BY"
    " query_id ORDER BY raw DESC, best, passage_id) AS rank, round(raw, 9) AS rrf_score, 'hybrid' AS"
    " search_mode FROM (SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.passage_id,"
    " s.passage_id) AS passage_id, fts_rank, semantic_rank, " + RRF_SQL + " AS raw, least(fts_rank,"
    " semantic_rank) AS best FROM (SELECT * FROM pool WHERE query_id IN (SELECT query_id FROM s)) f"
    " FULL JOIN s ON f.query_id = s.query_id AND f.passage_id = s.passage_id)",
    found="SELECT * FROM fused WHERE rank <= 50 UNION ALL BY NAME SELECT query_id, passage_id,"
    " fts_rank, NULL AS semantic_rank, fts_rank AS rank, NULL AS rrf_score, 'fts' AS search_mode"
    " FROM pool WHERE fts_rank <= 50 AND query_id NOT IN (SELECT query_id FROM s)",
)


def hybrid_parts(c: Corpus, limit: int):
    """The hits, and the homes of all passages (id, paper_id, space_id)."""
    postings, stats, homes = rt.search_tables(c.passages)
    hits = rt.hybrid_search(c.queries, c.query_vectors, homes, c.embeddings, postings, stats, limit)
    return hits, homes


def hybrid_hits(c: Corpus, limit: int = 50):
    return hybrid_parts(c, limit)[0]


@query(
    "hybrid_search",
    o.sql("SELECT query_id, passage_id, rank, search_mode, coalesce(fts_rank, -1) AS fts_rank,"
          " coalesce(semantic_rank, -1) AS semantic_rank, coalesce(rrf_score, 0) AS rrf_score"
          " FROM found", "passages", "q", "qv", "emb", **HYBRID),
)
def hybrid_search(c: Corpus):
    return hybrid_hits(c).select(
        "query_id", "passage_id", "rank", "search_mode",
        F.coalesce("fts_rank", F.lit(-1)).alias("fts_rank"),
        F.coalesce("semantic_rank", F.lit(-1)).alias("semantic_rank"),
        F.coalesce(F.round("rrf_score", 9), F.lit(0.0)).alias("rrf_score"),
    )


@query(
    "find_similar_results",
    o.sql(
        "SELECT query_id, passage_id, rank, coalesce(parse_run_id, '') AS parse_run_id,"
        " array_to_string(heading_path, ' > ') AS headings, parser_backend,"
        " array_to_string(quality_flags, ',') AS flags FROM found JOIN passages ON id = passage_id"
        " WHERE rank <= 10", "passages", "q", "qv", "emb", **HYBRID,
    ),
)
def find_similar_results(c: Corpus):
    hits = hybrid_hits(c, 10).join(c.queries.select("query_id", "space_id"), "query_id")
    return rt.enrich_passages(hits, c.passages).select(
        "query_id", "passage_id", "rank", F.coalesce("parse_run_id", F.lit("")).alias("parse_run_id"),
        F.array_join("heading_path", " > ").alias("headings"), "parser_backend",
        F.array_join("quality_flags", ",").alias("flags"),
    )


@query(
    "evidence_for_claim",
    o.sql(
        "SELECT query_id, 'passage' AS kind, passage_id AS item, rank FROM found WHERE rank <= 10"
        " UNION ALL SELECT query_id, 'card', id, n FROM q JOIN (SELECT *, row_number() OVER (PARTITION"
        " BY space_id ORDER BY created_at DESC, id) AS n FROM cards WHERE card_type = 'Evidence') k"
        " ON k.space_id = q.space_id WHERE n <= 10", "passages", "q", "qv", "emb", "cards", **HYBRID,
    ),
)
def evidence_for_claim(c: Corpus):
    passages, cards = rt.evidence_for_claim(c.queries, hybrid_hits(c, 10), c.cards, 10)
    return passages.select(
        "query_id", F.lit("passage").alias("kind"), F.col("passage_id").alias("item"), "rank"
    ).unionByName(cards.select(
        "query_id", F.lit("card").alias("kind"), F.col("id").alias("item"),
        F.col("card_rank").alias("rank"),
    ))


@query(
    "compare_with_literature",
    o.sql(
        "SELECT DISTINCT query_id, k.id AS card_id FROM found JOIN passages p ON p.id = passage_id"
        " JOIN cards k ON k.paper_id = p.paper_id AND k.space_id = p.space_id WHERE rank <= 10",
        "passages", "q", "qv", "emb", "cards", **HYBRID,
    ),
)
def compare_with_literature(c: Corpus):
    hits, homes = hybrid_parts(c, 10)
    return rt.compare_with_literature(hits, homes, c.cards).select(
        "query_id", F.col("id").alias("card_id")
    )


@query(
    "full_text",
    o.sql(
        "SELECT p.id, p.paper_id, page_number, paragraph_index, original_text FROM passages p JOIN"
        " papers ON papers.id = p.paper_id WHERE parse_status = 'parsed'", "passages", "papers",
    ),
)
def full_text(c: Corpus):
    return rt.full_text(c.papers.filter("parse_status = 'parsed'"), c.passages).select(
        "id", "paper_id", "page_number", "paragraph_index", "original_text"
    )


@query(
    "citation_record",
    o.sql(
        "SELECT id, title, authors, doi, arxiv_id, pubmed_id, venue, citation,"
        " coalesce(CAST(year AS VARCHAR), '') AS year FROM papers", "papers",
    ),
)
def citation_record(c: Corpus):
    return rt.citation_record(c.papers)


HASHED = dict(
    stored="SELECT e.*, p.content_hash FROM emb e JOIN passages p ON p.id = e.passage_id WHERE"
    " p.doc_id % 3 > 0",
    newest="SELECT content_hash, passage_id, created_at FROM stored QUALIFY row_number() OVER"
    " (PARTITION BY content_hash ORDER BY created_at DESC, passage_id DESC) = 1",
    plan="SELECT p.id, coalesce(p.parse_run_id, '') AS run, p.page_number, p.paragraph_index, CASE WHEN"
    " s.passage_id IS NOT NULL THEN 'skip' WHEN n.passage_id IS NOT NULL THEN 'reuse' ELSE 'embed'"
    " END AS action, n.passage_id AS origin FROM passages p LEFT JOIN stored s ON s.passage_id = p.id"
    " LEFT JOIN newest n ON n.content_hash = p.content_hash",
)


def stored_vectors(c: Corpus, passages=None):
    passages = c.passages if passages is None else passages
    hashes = passages.filter(F.col("doc_id") % 3 > 0) if "doc_id" in passages.columns else (
        passages.filter(F.split("paper_id", "-")[1].cast("long") % 3 > 0)
    )
    return c.embeddings.join(
        hashes.select(F.col("id").alias("passage_id"), "content_hash"), "passage_id"
    )


def plan_of(c: Corpus):
    return em.embedding_plan(c.passages, stored_vectors(c), PROVIDER, MODEL)


@query(
    "embedding_plan",
    o.sql(
        "SELECT id, action, CASE WHEN action = 'reuse' THEN origin ELSE '' END AS reused_from,"
        " CASE WHEN action = 'embed' THEN (row_number() OVER (PARTITION BY run, action ORDER BY"
        " page_number, paragraph_index, id) - 1) // 16 ELSE -1 END AS batch FROM plan",
        "passages", "emb", **HASHED,
    ),
)
def embedding_plan(c: Corpus):
    return plan_of(c).select(
        "id", "action", F.coalesce("reused_from", F.lit("")).alias("reused_from"),
        F.coalesce("batch", F.lit(-1)).alias("batch"),
    )


@query(
    "apply_reuse",
    o.sql(
        "SELECT id AS passage_id, round(list_sum(embedding), 5) AS total, CAST(dimension AS BIGINT) AS"
        " dimension FROM plan JOIN emb ON emb.passage_id = origin WHERE action = 'reuse'",
        "passages", "emb", **HASHED,
    ),
)
def apply_reuse(c: Corpus):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    copied = em.apply_reuse(plan_of(c), PROVIDER, MODEL, now)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return copied.select("passage_id", F.round(total, 5).alias("total"), "dimension")


@query("embed_passages")
def embed_passages(c: Corpus):
    """Every passage without a vector through the hashing encoder. Texts are made and hashed once; no batch is numbered."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    passages = store_rows(c.passages.select("id", "paper_id", "content_hash", "original_text"), "passages")
    plan = em.embedding_actions(passages.drop("paper_id"), stored_vectors(c, passages), PROVIDER, MODEL)
    made = em.embed_passages(plan, em.hashing_encoder(16), PROVIDER, MODEL, now)
    return made.select("passage_id", "dimension", F.array_max("embedding").alias("largest"))


@query(
    "latest_vector_by_hash",
    o.sql("SELECT content_hash, passage_id FROM newest", "passages", "emb", **HASHED),
)
def latest_vector_by_hash(c: Corpus):
    return em.latest_vector_by_hash(stored_vectors(c)).select("content_hash", "passage_id")


@query(
    "embedding_run_stats",
    o.sql(
        "SELECT run AS parse_run_id, count(*) AS passage_count, count(*) FILTER (action = 'embed') AS"
        " embedded_count, count(*) FILTER (action = 'reuse') AS reused_count, count(*) FILTER"
        " (action = 'skip') AS skipped_count, CAST(ceil(count(*) FILTER (action = 'embed') / 16.0) AS"
        " BIGINT) AS batch_count FROM plan GROUP BY 1", "passages", "emb", **HASHED,
    ),
)
def embedding_run_stats(c: Corpus):
    return em.embedding_run_stats(plan_of(c)).na.fill("", ["parse_run_id"])


@query(
    "sync_vector_table",
    o.sql(
        "SELECT passage_id, CAST(dimension AS BIGINT) AS dimension, "
        + o.stamp("created_at + to_seconds(CASE WHEN vec_id % 2 = 0 THEN 3600 ELSE 0 END)")
        + " AS created_at FROM (SELECT *, CAST(split_part(passage_id, '-', 2) AS BIGINT) AS vec_id"
        " FROM emb) WHERE vec_id % 5 <> 0", "emb",
    ),
)
def sync_vector_table(c: Corpus):
    """Even vectors are sent again an hour later (multiples of four broken); each fifth is deleted."""
    number = F.split("passage_id", "-")[1].cast("long")
    later = c.embeddings.filter(number % 2 == 0).withColumn(
        "created_at", F.col("created_at") + F.expr("interval 1 hour")
    )
    broken = later.filter(number % 4 == 0).withColumn("embedding", F.slice("embedding", 1, 3))
    gone = c.embeddings.filter(number % 5 == 0)
    synced = em.sync_vector_table(c.embeddings, later.unionByName(broken), gone)
    return synced.select("passage_id", "dimension", stamp("created_at").alias("created_at"))


@query(
    "sync_vector_lists",
    o.sql(
        "SELECT passage_id, CAST(dimension AS BIGINT) AS dimension, "
        + o.stamp("created_at + to_seconds(CASE WHEN vec_id % 2 = 0 AND vec_id % 4 <> 0 THEN 3600 ELSE 0 END)")
        + " AS created_at FROM (SELECT emb.*, CAST(split_part(passage_id, '-', 2) AS BIGINT) AS vec_id"
        " FROM emb JOIN passages p ON p.id = passage_id) WHERE vec_id % 5 <> 0", "passages", "emb",
    ),
)
def sync_vector_lists(c: Corpus):
    """Every second vector is sent again an hour later, every fourth broken; each fifth is deleted."""
    index = vi.write_vector_index(c.embeddings, c.passages, work_dir(c.spark, "lists"))
    number = F.split("passage_id", "-")[1].cast("long")
    later = c.embeddings.filter(number % 2 == 0).withColumn("created_at", F.col("created_at") + F.expr("interval 1 hour"))
    sent = later.withColumn("embedding", F.when(number % 4 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    synced = vi.sync_vector_index(index, sent, c.passages, c.embeddings.filter(number % 5 == 0))
    return synced.rows.select("passage_id", "dimension", stamp("created_at").alias("created_at"))


__all__ = ["tx"]
