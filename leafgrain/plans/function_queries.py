"""Queries that exercise the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrain.functions import meta, numeric
from leafgrain.functions import text as tx
from leafgrain.operators import retrieval as rt
from leafgrain.plans import oracle_base as o
from leafgrain.plans.corpus import Corpus
from leafgrain.plans.registry import query, setup, stamp

@setup
def columns() -> None:
    global d, text
    d, text = F.col("doc_id"), F.col("text")


@query("normalize_ws", f"SELECT doc_id, {o.ws('text')} AS value FROM documents")
def normalize_ws(c: Corpus):
    return c.documents.select("doc_id", tx.normalize_ws(text).alias("value"))


HYPHENED = "replace(text, ' de', '-' || chr(10) || ' de')"


@query("dehyphenate", f"SELECT doc_id, {o.dehyphen(HYPHENED)} AS value FROM documents")
def dehyphenate(c: Corpus):
    broken = F.replace(text, F.lit(" de"), F.lit("-\n de"))
    return c.documents.select("doc_id", tx.dehyphenate(broken).alias("value"))


@query(
    "word_tokens",
    f"SELECT doc_id, CAST(len({o.word_list('text')}) AS BIGINT) AS n,"
    f" array_to_string({o.word_list('text')}, '|') AS words FROM documents",
)
def word_tokens(c: Corpus):
    found = tx.word_tokens(text)
    return c.documents.select(
        "doc_id", F.size(found).alias("n"), F.array_join(found, "|").alias("words")
    )


@query("fold_term", f"SELECT doc_id, {o.fold('text')} AS value FROM documents")
def fold_term(c: Corpus):
    return c.documents.select("doc_id", tx.fold_term(text).alias("value"))


@query("plain_snippet", f"SELECT doc_id, {o.snippet('text')} AS value FROM documents")
def plain_snippet(c: Corpus):
    return c.documents.select("doc_id", tx.plain_snippet(text).alias("value"))


@query("truncate_text", f"SELECT doc_id, {o.truncated('text')} AS value FROM documents")
def truncate_text(c: Corpus):
    return c.documents.select("doc_id", tx.truncate_text(text).alias("value"))


@query("count_tokens", f"SELECT doc_id, CAST({o.tokens('text')} AS BIGINT) AS n FROM documents")
def count_tokens(c: Corpus):
    return c.documents.select("doc_id", tx.count_tokens(text).alias("n"))


@query(
    "highlight_snippet",
    o.sql(
        "SELECT doc_id, snippet FROM shown",
        docs="SELECT doc_id, text AS body, ['que', 'the', 'und', 'der'] AS terms FROM documents",
        **o.best_window("docs", "doc_id"),
    ),
)
def highlight_snippet(c: Corpus):
    """Marks four common words in every document, in the window that holds most of them."""
    terms = F.array(*[F.lit(w) for w in ("que", "the", "und", "der")])
    docs = c.documents.select("doc_id", "text", terms.alias("terms"))
    return rt.best_snippets(docs, ["doc_id"], "text", "terms").select("doc_id", "snippet")


RAW_DOI = (
    "CASE doc_id % 4 WHEN 0 THEN 'doi: https://doi.org/10.1234/A' || doc_id || '.,' WHEN 1 THEN"
    " 'https://dx.doi.org/10.99999/x-' || doc_id || ' tail' WHEN 2 THEN '  none ' ELSE"
    " 'DOI:10.1/short' || doc_id || ';' END"
)
RAW_ARXIV = (
    "CASE doc_id % 3 WHEN 0 THEN 'arXiv: 2401.' || (10000 + doc_id) || 'v2.' WHEN 1 THEN"
    " 'https://arxiv.org/abs/math.GT/0309' || (100 + doc_id % 900) ELSE ' hep-th/9901001 ;' END"
)


@query(
    "normalize_identifiers",
    f"SELECT doc_id, {o.doi(RAW_DOI)} AS doi, {o.arxiv(RAW_ARXIV)} AS arxiv_id,"
    rf" coalesce(CAST(nullif(regexp_extract(lang || ' in ' || (1700 + doc_id), "
    r"'\b((?:18|19|20)[0-9]{2})\b', 1), '') AS BIGINT), -1) AS year FROM documents",
)
def normalize_identifiers(c: Corpus):
    raw_doi = (
        F.when(d % 4 == 0, F.concat(F.lit("doi: https://doi.org/10.1234/A"), d, F.lit(".,")))
        .when(d % 4 == 1, F.concat(F.lit("https://dx.doi.org/10.99999/x-"), d, F.lit(" tail")))
        .when(d % 4 == 2, F.lit("  none "))
        .otherwise(F.concat(F.lit("DOI:10.1/short"), d, F.lit(";")))
    )
    raw_arxiv = (
        F.when(d % 3 == 0, F.concat(F.lit("arXiv: 2401."), 10000 + d, F.lit("v2.")))
        .when(d % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/math.GT/0309"), 100 + d % 900))
        .otherwise(F.lit(" hep-th/9901001 ;"))
    )
    year = meta.extract_year(F.concat("lang", F.lit(" in "), 1700 + d))
    return c.documents.select(
        "doc_id", meta.normalize_doi(raw_doi).alias("doi"),
        meta.normalize_arxiv(raw_arxiv).alias("arxiv_id"),
        F.coalesce(year, F.lit(-1)).alias("year"),
    )


@query(
    "clean_title_abstract",
    f"SELECT doc_id, {o.clean_title(chr(39) + 'Title:  ' + chr(39) + ' || text')} AS title,"
    f" {o.clean_abstract(chr(39) + 'ABSTRACT - ' + chr(39) + ' || text')} AS abstract,"
    f" {o.clean_abstract(chr(39) + 'Abstract ' + chr(39) + ' || text')} AS kept FROM documents",
)
def clean_title_abstract(c: Corpus):
    return c.documents.select(
        "doc_id",
        meta.clean_title(F.concat(F.lit("Title:  "), text)).alias("title"),
        meta.clean_abstract(F.concat(F.lit("ABSTRACT - "), text)).alias("abstract"),
        meta.clean_abstract(F.concat(F.lit("Abstract "), text)).alias("kept"),
    )


AUTHORS = "lang || ' Smith and ' || source || ' Lee; ' || lang || ' Smith ;; and Ann'"
AUTHOR_SPLIT = rf"regexp_split_to_array({AUTHORS}, '\s*(?:;|\band\b)\s*')"


@query(
    "author_list",
    f"SELECT doc_id, array_to_string({o.ordered_distinct(AUTHOR_SPLIT)}, '|') AS authors,"
    " CASE WHEN doc_id % 2 = 0 THEN 'Full ' || lang ELSE 'F ' || source END AS first_struct"
    " FROM documents",
)
def author_list(c: Corpus):
    line = F.concat("lang", F.lit(" Smith and "), "source", F.lit(" Lee; "), "lang",
                    F.lit(" Smith ;; and Ann"))
    person = F.struct(
        F.when(d % 2 == 0, F.concat(F.lit("Full "), "lang")).otherwise("").alias("full_name"),
        F.lit("F").alias("first"), F.col("source").alias("last"),
    )
    return c.documents.select(
        "doc_id", F.array_join(meta.author_list(line), "|").alias("authors"),
        meta.author_names(F.array(person))[0].alias("first_struct"),
    )


@query(
    "filename_title",
    o.sql(f"SELECT id, {o.file_title('file_path')} AS title FROM papers", "papers"),
)
def filename_title(c: Corpus):
    return c.papers.select("id", meta.filename_title(F.col("file_path")).alias("title"))


@query(
    "section_label",
    o.sql(f"SELECT id, {o.label('section')} AS label FROM passages", "passages"),
)
def section_label(c: Corpus):
    return c.passages.select("id", meta.section_label(F.col("section")).alias("label"))


HEADER_WORDS = (
    "abstract", "2. Methods", "Introduction", "3 RESULTS", "the  model", "Findings",
    "future work", "conclusion", "References", "Methods of work",
)
HEADER_SQL = f"list_extract({o.lit(HEADER_WORDS)}, CAST((doc_id + pos) % 10 + 1 AS BIGINT))"


@query(
    "detect_section_header",
    o.sql(
        f"SELECT doc_id, pos, coalesce({o.header(HEADER_SQL)}, '') AS named,"
        f" coalesce({o.header('line')}, '') AS own FROM lines", "lines",
    ),
)
def detect_section_header(c: Corpus):
    words = F.get(F.array(*[F.lit(w) for w in HEADER_WORDS]), ((d + F.col("pos")) % 10).cast("int"))
    return c.lines.select(
        "doc_id", "pos",
        F.coalesce(meta.detect_section_header(words), F.lit("")).alias("named"),
        F.coalesce(meta.detect_section_header(F.col("line")), F.lit("")).alias("own"),
    )


CELL = (
    "CASE doc_id % 4 WHEN 0 THEN doc_id || 'ms' WHEN 1 THEN (100 + doc_id) || ' .'"
    " WHEN 2 THEN ' ' || doc_id || '.5kg ' ELSE 'x ' || doc_id END"
)


@query(
    "table_cell_text",
    "SELECT doc_id, regexp_replace(regexp_replace("
    + o.ws(CELL)
    + r", '^([0-9]{2,})([0-9])\s+\.$', '\1.\2'), '^([0-9]+(?:\.[0-9]+)?)([A-Za-z]+)$', '\1 \2')"
    " AS cell FROM documents",
)
def table_cell_text(c: Corpus):
    cell = (
        F.when(d % 4 == 0, F.concat(d, F.lit("ms")))
        .when(d % 4 == 1, F.concat(100 + d, F.lit(" .")))
        .when(d % 4 == 2, F.concat(F.lit(" "), d, F.lit(".5kg ")))
        .otherwise(F.concat(F.lit("x "), d))
    )
    return c.documents.select("doc_id", meta.table_cell_text(cell).alias("cell"))


CJK = "summary || ' 图神经网络 of the x'' it''s 网'"


@query(
    "summary_tokens",
    o.sql(f"SELECT id, array_to_string({o.summary_tokens(CJK)}, '|') AS tokens FROM cards", "cards"),
)
def summary_tokens(c: Corpus):
    text_ = F.concat("summary", F.lit(" 图神经网络 of the x' it's 网"))
    return c.cards.select("id", F.array_join(tx.summary_tokens(text_), "|").alias("tokens"))


@query(
    "jaccard",
    o.sql(
        f"SELECT id, round({o.jaccard(o.summary_tokens('summary'), o.summary_tokens('evidence_quote'))}, 6)"
        " AS similarity FROM cards", "cards",
    ),
)
def jaccard(c: Corpus):
    value = tx.jaccard(
        tx.summary_tokens(F.col("summary")), tx.summary_tokens(F.col("evidence_quote"))
    )
    return c.cards.select("id", F.round(value, 6).alias("similarity"))


@query("evidence_norm", f"SELECT doc_id, {o.evidence('text')} AS value FROM documents")
def evidence_norm(c: Corpus):
    return c.documents.select("doc_id", tx.evidence_norm(text).alias("value"))


@query(
    "group_key",
    o.sql(
        "SELECT id, CASE WHEN len(heading_path) > 0 THEN passage_type || ':' ||"
        " array_to_string(heading_path, ' > ') ELSE passage_type END AS key FROM passages",
        "passages",
    ),
)
def group_key(c: Corpus):
    key = meta.group_key(F.col("passage_type"), F.col("heading_path"))
    return c.passages.select("id", key.alias("key"))


@query(
    "rrf_scores",
    "SELECT event_id, round(1.0 / (60 + user_id + 1), 12) AS score,"
    " coalesce(least(user_id, CASE WHEN event_id % 3 > 0 THEN event_id % 7 END), 1000000000) AS best"
    " FROM events",
)
def rrf_scores(c: Corpus):
    e, u = F.col("event_id"), F.col("user_id")
    return c.table("events").select(
        "event_id", F.round(numeric.rrf(u + 1), 12).alias("score"),
        numeric.best_rank(u, F.when(e % 3 > 0, e % 7)).alias("best"),
    )


@query(
    "age_exceeds",
    o.sql(
        "SELECT id, heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '2024-01-15 12:00:00'"
        " - INTERVAL 900 SECOND AS stale FROM runs", "runs",
    ),
)
def age_exceeds(c: Corpus):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return c.runs.select("id", numeric.age_exceeds(F.col("heartbeat_at"), now, 900).alias("stale"))


@query(
    "provenance_maps",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'user.edit' ELSE lang END AS title_source,"
    " CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS doi_source,"
    " CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS progress, 'new' AS stage FROM documents",
)
def provenance_maps(c: Corpus):
    sources = meta.put_provenance(
        F.create_map(F.lit("title"), F.col("lang"), F.lit("doi"), F.col("lang")),
        F.when(d % 2 == 0, "title").otherwise("doi"),
        F.when(d % 2 == 0, "user.edit").otherwise(""),
    )
    old = F.when(d % 3 == 0, F.create_map(F.lit("progress"), F.lit("old"), F.lit("stage"), F.lit("x")))
    old = old.otherwise(F.create_map(F.lit("stage"), F.lit("x")))
    new = F.create_map(F.lit("progress"), F.lit("new"), F.lit("stage"), F.lit("new"))
    merged = meta.merge_metadata(old, new)
    return c.documents.select(
        "doc_id", sources["title"].alias("title_source"), sources["doi"].alias("doi_source"),
        merged["progress"].alias("progress"), merged["stage"].alias("stage"),
    )


@query(
    "parse_dimension",
    "SELECT doc_id, coalesce(CASE WHEN TRY_CAST(v AS INT) > 0 THEN TRY_CAST(v AS BIGINT) END, -1)"
    " AS dimension FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' || doc_id WHEN 1 THEN"
    " '-' || doc_id WHEN 2 THEN lang ELSE '' END AS v FROM documents)",
)
def parse_dimension(c: Corpus):
    raw = (
        F.when(d % 4 == 0, d.cast("string"))
        .when(d % 4 == 1, F.concat(F.lit("-"), d))
        .when(d % 4 == 2, F.col("lang"))
        .otherwise("")
    )
    return c.documents.select(
        "doc_id", F.coalesce(meta.parse_dimension(raw), F.lit(-1)).alias("dimension")
    )


@query(
    "canonical_json",
    o.sql(
        "SELECT id, '{\"heading_path\":' || to_json(heading_path) || ',\"page_number\":' || page_number"
        " || ',\"text\":' || to_json(original_text) || '}' AS payload, parse_run_id || ':' || id AS"
        " storage_id FROM passages WHERE parse_run_id IS NOT NULL", "passages",
    ),
)
def canonical_json(c: Corpus):
    payload = F.struct("heading_path", "page_number", F.col("original_text").alias("text"))
    return c.passages.filter("parse_run_id is not null").select(
        "id", tx.canonical_json(payload).alias("payload"),
        tx.storage_id(F.col("parse_run_id"), F.col("id")).alias("storage_id"),
    )


@query(
    "bbox_functions",
    o.sql(
        "SELECT id, round(CASE WHEN ix <= 0 OR iy <= 0 THEN 0.0 ELSE ix * iy / 10000.0 END, 6) AS"
        " covered, greatest(0.0, least(bbox[4], 300.0) - greatest(bbox[2], 100.0)) AS overlap,"
        " element_index % 5 <> 3 AS valid FROM (SELECT *, least(bbox[3], 400.0) - greatest(bbox[1],"
        " 100.0) AS ix, least(bbox[4], 300.0) - greatest(bbox[2], 100.0) AS iy FROM elements)",
        "elements",
    ),
)
def bbox_functions(c: Corpus):
    frame = F.array(F.lit(100.0), F.lit(100.0), F.lit(400.0), F.lit(300.0))
    box = F.col("bbox")
    maybe = F.when(F.col("element_index") % 5 == 3, F.reverse(box)).otherwise(box)
    flipped = F.when(F.col("element_index") % 5 == 3, F.array(box[2], box[1], box[0], box[3]))
    return c.elements.select(
        "id",
        F.round(numeric.bbox_overlap_ratio(box, frame), 6).alias("covered"),
        numeric.vertical_overlap(box, frame).alias("overlap"),
        numeric.valid_bbox(F.coalesce(flipped, maybe)).alias("valid"),
    )


@query(
    "cosine_similarity",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),"
    " CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b"
    " ON b.vec_id = a.vec_id // 2",
)
def cosine_similarity(c: Corpus):
    left = c.table("embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = c.table("embeddings").select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    pairs = left.join(right, F.floor(F.col("vec_id") / 2) == F.col("other"))
    value = numeric.cosine_similarity(F.col("a"), F.col("b"))
    return pairs.select("vec_id", F.round(value, 6).alias("similarity"))


@query(
    "format_embedding_text",
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'passage: ' || {o.ws('text')} ELSE {o.ws('text')}"
    " END AS value FROM documents",
)
def format_embedding_text(c: Corpus):
    model = F.when(d % 2 == 0, "multilingual-E5-base").otherwise("plain-model")
    return c.documents.select(
        "doc_id", numeric.format_embedding_text(text, model, "passage").alias("value")
    )


@query(
    "source_priority",
    "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 1000 WHEN 1 THEN 900 WHEN 2 THEN 700 WHEN 3 THEN"
    " 600 WHEN 4 THEN 100 WHEN 5 THEN 50 ELSE 0 END::BIGINT AS priority FROM documents",
)
def source_priority(c: Corpus):
    names = ("user.edit", "regex.doi", "document.title", "llm.metadata", "filename.fallback",
             "other", "")
    source = F.get(F.array(*[F.lit(n) for n in names]), (d % 7).cast("int"))
    return c.documents.select("doc_id", meta.source_priority(source).alias("priority"))


@query(
    "ordered_distinct",
    o.sql(
        "SELECT l.doc_id, l.pos, coalesce(value, '') AS value FROM lines l LEFT JOIN (SELECT doc_id,"
        " pos, string_agg(v, '|' ORDER BY first) AS value FROM (SELECT doc_id, pos, v, min(i) AS first"
        f" FROM (SELECT doc_id, pos, {o.strip('w')} AS v, i FROM (SELECT doc_id, pos,"
        " unnest(string_split(line, ' ')) AS w, unnest(range(len(string_split(line, ' ')))) AS i"
        " FROM lines)) WHERE v <> '' GROUP BY ALL) GROUP BY ALL) t"
        " ON l.doc_id = t.doc_id AND l.pos = t.pos", "lines",
    ),
)
def ordered_distinct(c: Corpus):
    return c.lines.select(
        "doc_id", "pos",
        F.array_join(tx.ordered_distinct(F.split("line", " ")), "|").alias("value"),
    )


@query(
    "vector_row_key",
    None,
)
def vector_row_key(c: Corpus):
    """Stable 64-bit identity of a (passage, provider, model) vector row."""
    from leafgrain.operators.embeddings import vector_row_key as key

    return c.embeddings.select("passage_id", key().alias("row_key"))


__all__ = ["stamp"]
