"""Queries over metadata mining, evidence selection and cards."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from leafgrain.functions import text as tx
from leafgrain.operators import analysis as an
from leafgrain.operators import cards as cd
from leafgrain.operators import extraction as xt
from leafgrain.operators import metadata as md
from leafgrain.operators.keyed import work_dir
from leafgrain.operators.layout import promote_title
from leafgrain.plans import oracle_base as o
from leafgrain.plans.corpus import Corpus
from leafgrain.plans.registry import query, setup, stamp

@setup
def columns() -> None:
    global NONE, NOW, number
    NONE = F.array().cast("array<string>")
    NOW = F.lit("2024-02-01 00:00:00").cast("timestamp")
    number = F.split("paper_id", "-")[1].cast("long")

# ---------------------------------------------------------------- metadata

IDENT = dict(
    psg="SELECT *, original_text || CASE WHEN paragraph_index = doc_id % 3 AND doc_id % 4 > 0 THEN"
    " ' DOI: https://doi.org/10.2222/x' || doc_id || '. arXiv:24' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')"
    " || '.01234v2' ELSE '' END AS body FROM passages",
    elt="SELECT *, text || CASE WHEN element_index = 0 AND CAST(split_part(paper_id, '-', 2) AS BIGINT) % 8 = 0 THEN"
    " ' 10.9999/e' || split_part(paper_id, '-', 2) ELSE '' END AS body FROM (SELECT * REPLACE (CASE WHEN"
    " element_index = t THEN 'title' ELSE element_type END AS element_type) FROM (SELECT *, min(CASE WHEN"
    " element_type = 'paragraph' AND text <> '' AND len(string_split(text, ' ')) <= 16 THEN element_index END)"
    " OVER (PARTITION BY paper_id) AS t FROM elements))",
    texts="SELECT paper_id, 'passage' AS kind, id AS source_id, body AS text, 0 AS part, page_number AS a,"
    " paragraph_index AS b FROM psg UNION ALL SELECT paper_id, 'element', id, body, 1, element_index, 0 FROM elt",
    ids=f"SELECT paper_id, 'doi' AS field, {o.doi('v')} AS value, 'regex.doi' AS source, 0.98 AS confidence, CASE WHEN"
    " kind = 'passage' THEN source_id ELSE '' END AS source_id FROM (SELECT *, regexp_extract(text, '" + o.DOI + "')"
    " AS v FROM texts) WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY part, a, b, source_id)"
    f" = 1 UNION ALL SELECT paper_id, 'arxiv_id', {o.arxiv('v')}, 'regex.arxiv', 0.98, CASE WHEN kind = 'passage' THEN"
    " source_id ELSE '' END FROM (SELECT *, regexp_extract(text, '" + o.ARXIV + "', 1) AS v FROM texts) WHERE v <> ''"
    " QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY part, a, b, source_id) = 1",
    ttl=f"SELECT paper_id, 'title' AS field, {o.clean_title('body')} AS value, 'document.title' AS source, 0.75 AS"
    " confidence, id AS source_id FROM elt WHERE element_type = 'title' QUALIFY row_number() OVER (PARTITION BY"
    " paper_id ORDER BY CASE WHEN page_number IN (0, 1) THEN 0 ELSE 1 END, page_number, element_index) = 1",
    abs="SELECT paper_id, 'abstract' AS field, " + o.clean_abstract("body") + " AS value, 'document.abstract' AS source,"
    " 0.75 AS confidence, id AS source_id FROM psg WHERE section = 'Abstract' QUALIFY row_number() OVER (PARTITION BY"
    " paper_id ORDER BY page_number, paragraph_index, id) = 1",
    fil=f"SELECT id AS paper_id, 'title' AS field, {o.file_title('file_path')} AS value, 'filename.fallback' AS source,"
    " 0.1 AS confidence, '' AS source_id FROM papers",
    cand="SELECT * FROM ids UNION ALL SELECT * FROM ttl UNION ALL SELECT * FROM abs UNION ALL SELECT * FROM fil",
)
CAND_OUT = "paper_id, field, value, source, CAST(confidence AS DOUBLE) AS confidence, source_id"


def tagged(c: Corpus):
    """Passages and elements with identifiers planted in some of them."""
    n = F.col("paragraph_index")
    plant = F.when(
        (n == number % 3) & (number % 4 > 0),
        F.concat(
            F.lit(" DOI: https://doi.org/10.2222/x"), number, F.lit(". arXiv:24"),
            F.lpad((number % 100).cast("string"), 2, "0"), F.lit(".01234v2"),
        ),
    ).otherwise("")
    passages = c.passages.withColumn("original_text", F.concat("original_text", plant))
    mark = F.when(
        (F.col("element_index") == 0) & (number % 8 == 0), F.concat(F.lit(" 10.9999/e"), number)
    ).otherwise("")
    elements = promote_title(c.elements).withColumn("text", F.concat("text", mark))
    return passages, elements


@query(
    "source_texts",
    o.sql("SELECT paper_id, kind, source_id, text, CAST(a AS BIGINT) AS place FROM texts", "passages", "elements",
          psg=IDENT["psg"], elt=IDENT["elt"], texts=IDENT["texts"]),
)
def source_texts(c: Corpus):
    return md.source_texts(*tagged(c)).select(
        "paper_id", "kind", "source_id", "text", F.col("position.a").alias("place")
    )


@query("first_identifier", o.sql(f"SELECT {CAND_OUT} FROM ids", "passages", "elements",
                                 **{k: IDENT[k] for k in ("psg", "elt", "texts", "ids")}))
def first_identifier(c: Corpus):
    texts = md.source_texts(*tagged(c))
    return md.first_identifier(texts, "doi").unionByName(md.first_identifier(texts, "arxiv_id"))


@query("first_title", o.sql(f"SELECT {CAND_OUT} FROM ttl", "elements", elt=IDENT["elt"], ttl=IDENT["ttl"]))
def first_title(c: Corpus):
    return md.first_title(tagged(c)[1])


@query("first_abstract", o.sql(f"SELECT {CAND_OUT} FROM abs", "passages", psg=IDENT["psg"], abs=IDENT["abs"]))
def first_abstract(c: Corpus):
    return md.first_abstract(tagged(c)[0])


@query("extract_metadata_candidates",
       o.sql(f"SELECT {CAND_OUT} FROM cand", "passages", "elements", "papers", **IDENT))
def extract_metadata_candidates(c: Corpus):
    passages, elements = tagged(c)
    return md.extract_metadata_candidates(passages, elements, c.papers)


AI = dict(
    ai="SELECT id AS paper_id, unnest(['title', 'authors', 'year', 'doi', 'arxiv_id', 'venue', 'abstract']) AS field,"
    " unnest([trim(title), lang || ' A, ' || space_id || ' B', CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(1990 + doc_id % 35"
    " AS VARCHAR) END, CASE WHEN doc_id % 2 = 0 THEN '10.5555/a' || doc_id ELSE '' END, '', 'Conf ' || lang, '']) AS"
    " value, CASE WHEN doc_id % 3 = 0 THEN 0.6 ELSE 0.8 END AS confidence FROM (SELECT *, split_part(file_path, '/', 1)"
    " AS lang FROM papers)",
    aic="SELECT paper_id, field, value, 'llm.metadata' AS source, confidence, '' AS source_id FROM ai WHERE value <> ''",
)


def extractions(c: Corpus):
    d = F.col("doc_id")
    lang = F.split("file_path", "/")[0]
    return c.papers.select(
        F.col("id").alias("paper_id"), F.concat(F.lit("Title: "), "title").alias("title"),
        F.array(F.concat(lang, F.lit(" A")), F.concat("space_id", F.lit("  B")), F.concat(lang, F.lit(" A"))).alias("authors"),
        "year", F.when(d % 2 == 0, F.concat(F.lit("doi:10.5555/a"), d)).alias("doi"), F.lit("").alias("arxiv_id"),
        F.concat(F.lit("Conf  "), lang).alias("venue"), F.lit(None).cast("string").alias("abstract"),
        F.when(d % 3 > 0, 0.8).alias("confidence"),
    )


@query("ai_metadata_candidates",
       o.sql(f"SELECT {CAND_OUT} FROM aic", "papers", **AI))
def ai_metadata_candidates(c: Corpus):
    return md.ai_metadata_candidates(extractions(c))


MERGED = dict(
    **IDENT, **AI,
    merged=f"SELECT * FROM (SELECT *, 0 AS g FROM aic UNION ALL SELECT *, 1 FROM cand) QUALIFY row_number() OVER"
    f" (PARTITION BY paper_id, field ORDER BY {o.source_priority('source')} DESC, g) = 1",
)


@query("merge_metadata_candidates",
       o.sql(f"SELECT {CAND_OUT} FROM merged", "passages", "elements", "papers", **MERGED))
def merge_metadata_candidates(c: Corpus):
    passages, elements = tagged(c)
    parsed = md.extract_metadata_candidates(passages, elements, c.papers)
    return md.merge_metadata_candidates(md.ai_metadata_candidates(extractions(c)), parsed)


def paper_state(c: Corpus):
    """Papers with a source for the title (two thirds) and a frozen DOI (a quarter)."""
    d = F.col("doc_id")
    return c.papers.withColumns({
        "metadata_sources": F.when(d % 3 > 0, F.create_map(F.lit("title"), F.when(d % 3 == 1, "filename.fallback").otherwise("document.title")))
        .otherwise(F.create_map().cast("map<string,string>")),
        "metadata_confidence": F.create_map().cast("map<string,double>"),
        "user_edited_fields": F.when(d % 4 == 1, F.array(F.lit("doi"))).otherwise(NONE),
        "metadata_status": F.lit("empty"), "venue": F.lit(""), "authors": F.lit(""),
    })


def field_case(name: str, current: str, source: str) -> str:
    frozen = "doc_id % 4 = 1" if name == "doi" else "false"
    return (
        f"CASE WHEN m_{name}.value IS NOT NULL AND NOT ({frozen}) AND ({current} = '' OR {o.source_priority(source)} <"
        f" {o.source_priority(f'm_{name}.source')}) THEN m_{name}.value ELSE {current} END"
    )


TITLE_SOURCE = "CASE WHEN doc_id % 3 = 1 THEN 'filename.fallback' WHEN doc_id % 3 = 2 THEN 'document.title' ELSE 'user.edit' END"
JOINS = " ".join(
    f"LEFT JOIN merged m_{f} ON m_{f}.paper_id = papers.id AND m_{f}.field = '{f}'"
    for f in ("title", "doi", "venue", "abstract", "arxiv_id", "authors")
)
PROMOTED_SQL = (
    f"SELECT papers.id, {field_case('title', 'papers.title', TITLE_SOURCE)} AS title,"
    f" {field_case('doi', 'papers.doi', repr('user.edit'))} AS doi,"
    f" {field_case('venue', repr(''), repr('user.edit'))} AS venue,"
    f" {field_case('abstract', repr(''), repr('user.edit'))} AS abstract,"
    f" {field_case('authors', repr(''), repr('user.edit'))} AS authors,"
    " CASE WHEN doc_id % 4 = 1 THEN 'user_edited' ELSE 'enriched' END AS metadata_status"
    f" FROM papers {JOINS}"
)


@query("promote_metadata", o.sql(PROMOTED_SQL, "passages", "elements", "papers", **MERGED))
def promote_metadata(c: Corpus):
    passages, elements = tagged(c)
    parsed = md.extract_metadata_candidates(passages, elements, c.papers)
    both = md.merge_metadata_candidates(md.ai_metadata_candidates(extractions(c)), parsed)
    return md.promote_metadata(paper_state(c), both).select(
        "id", "title", "doi", "venue", "abstract", "authors", "metadata_status"
    )


@query(
    "metadata_from_parse",
    o.sql(
        "SELECT papers.id, coalesce(a.value, '') AS arxiv_id, coalesce(b.value, '') AS abstract FROM papers LEFT JOIN"
        " (SELECT * FROM ids WHERE field = 'arxiv_id') a ON a.paper_id = papers.id LEFT JOIN abs b ON b.paper_id ="
        " papers.id WHERE doc_id % 2 = 0", "passages", "elements", "papers",
        **{**IDENT, "psg": IDENT["psg"] + " WHERE parse_run_id IS NOT NULL AND doc_id % 2 = 0",
           "elt": IDENT["elt"].replace("FROM elements))", "FROM elements)) WHERE FALSE")},
    ),
)
def metadata_from_parse(c: Corpus):
    """Even papers, their run's passages only (elements carry other runs)."""
    passages, elements = tagged(c)
    runs = c.papers.filter("doc_id % 2 = 0").select(
        F.col("id").alias("paper_id"), F.concat(F.lit("run-"), "doc_id").alias("parse_run_id")
    )
    elements = elements.withColumn("parse_run_id", F.lit("other"))
    return md.metadata_from_parse(paper_state(c), passages, elements, runs).select(
        "id", "arxiv_id", "abstract"
    )


# ---------------------------------------------------------------- evidence selection

HP = o.analysis_path("heading_path", "section")
PAYLOAD = (
    "'{\"heading_path\":' || to_json(hp) || ',\"page_number\":' || page_number || ',\"passage_type\":\"' || kind ||"
    " '\",\"source_id\":\"' || id || '\",\"text\":' || to_json(original_text) || '}'"
)
EMPTY = PAYLOAD.replace("to_json(original_text)", "'\"\"'")
LABELLED = dict(
    lab0=f"SELECT *, {HP} AS hp FROM passages",
    lab=f"SELECT *, {o.is_reference('passage_type', 'section', 'hp')} AS ref, {o.analysis_type('passage_type', 'section', 'hp')}"
    " AS kind FROM lab0",
)
BUDGET = 8000
BATCH = dict(
    **LABELLED,
    pay0=f"SELECT *, {PAYLOAD} AS pay, {o.priority('kind')} AS pri FROM lab WHERE NOT ref",
    ov=f"SELECT id, string_split(original_text, ' ') AS ws, {BUDGET} - {o.tokens(EMPTY)} AS room FROM pay0 WHERE"
    f" {o.tokens('pay')} > {BUDGET}",
    cutw="SELECT id, 1 AS i, ws[1] AS word, 1 AS w, length(ws[1]) AS c, 0 AS f FROM ov UNION ALL SELECT id, i, word, CASE WHEN"
    " fits THEN w + 1 ELSE 1 END, CASE WHEN fits THEN c + 1 + length(word) ELSE length(word) END, CASE WHEN fits THEN f ELSE"
    " f + 1 END FROM (SELECT r.id, i + 1 AS i, ws[i + 1] AS word, w, c, f, greatest(w + 1, ceil((c + 1 + length(ws[i + 1]))"
    " / 4.0)) <= room AS fits FROM cutw r JOIN ov ON ov.id = r.id WHERE i < len(ws))",
    frg="SELECT id, f, string_agg(word, ' ' ORDER BY i) AS txt FROM cutw GROUP BY 1, 2",
    pay1="SELECT p.* REPLACE (coalesce(txt, original_text) AS original_text), coalesce(f, 0) AS f FROM pay0 p LEFT JOIN frg"
    " USING (id)",
    prep0=f"SELECT * REPLACE ({PAYLOAD} AS pay) FROM pay1",
    prep=f"SELECT *, {o.words(o.ws('pay'))} AS w, length({o.ws('pay')}) AS ch FROM prep0",
    firsts="SELECT *, min(paragraph_index) OVER (PARTITION BY paper_id, kind, hp) AS fp FROM prep",
    ordered="SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY pri, fp, kind, hp, paragraph_index, f) AS n FROM firsts",
    fold="SELECT paper_id, n, kind, hp, w, ch, 1 AS g FROM ordered WHERE n = 1 UNION ALL SELECT paper_id, n, kind, hp,"
    " CASE WHEN keep THEN fw + w ELSE w END, CASE WHEN keep THEN fc + 1 + ch ELSE ch END, CASE WHEN keep THEN fg ELSE"
    " fg + 1 END FROM (SELECT x.*, f.w AS fw, f.ch AS fc, f.g AS fg, x.kind = f.kind AND x.hp = f.hp AND greatest(f.w +"
    f" x.w, ceil((f.ch + 1 + x.ch) / 4.0)) <= {BUDGET} AS keep FROM fold f JOIN ordered x ON x.paper_id = f.paper_id AND x.n ="
    " f.n + 1)",
    bat="SELECT paper_id, g, any_value(kind) AS kind, any_value(hp) AS hp, sum(w) AS w, sum(ch) + count(*) - 1 AS ch,"
    " list(id ORDER BY n) AS ids FROM (SELECT o.paper_id, o.n, o.kind, o.hp, o.w, o.ch, id, g FROM ordered o JOIN (SELECT"
    " paper_id, n, g FROM fold) USING (paper_id, n)) GROUP BY 1, 2",
    mfold="SELECT paper_id, g, kind, w, ch, 1 AS m FROM bat WHERE g = 1 UNION ALL SELECT paper_id, g, kind, CASE WHEN keep"
    " THEN fw + w ELSE w END, CASE WHEN keep THEN fc + 1 + ch ELSE ch END, CASE WHEN keep THEN fm ELSE fm + 1 END FROM"
    " (SELECT b.*, f.w AS fw, f.ch AS fc, f.m AS fm, b.kind = 'body' AND f.kind = 'body' AND greatest(f.w + b.w,"
    f" ceil((f.ch + 1 + b.ch) / 4.0)) <= {BUDGET} AS keep FROM mfold f JOIN bat b ON b.paper_id = f.paper_id AND b.g = f.g + 1)",
    fin="SELECT bat.paper_id, m - 1 AS batch_index, any_value(bat.kind) AS passage_type, CASE WHEN count(*) > 1 THEN"
    " CAST([] AS VARCHAR[]) ELSE any_value(hp) END AS path, any_value(bat.paper_id) AS pp, flatten(list(ids ORDER BY bat.g)) AS ids0, CAST(sum(greatest("
    "bat.w, ceil(bat.ch / 4.0))) AS BIGINT) AS token_count FROM bat JOIN (SELECT paper_id, g, m FROM mfold) USING"
    " (paper_id, g) GROUP BY bat.paper_id, m",
    fin2="SELECT *, list_filter(ids0, lambda v, i: list_position(ids0, v) = i) AS ids FROM fin",
    place="SELECT paper_id, n, m - 1 AS batch_index FROM fold JOIN (SELECT paper_id, g, m FROM mfold) USING (paper_id, g)",
)


def batch_parts(c: Corpus):
    prepared = an.prepared_passages(c.passages, BUDGET)
    return prepared, an.analysis_batches(prepared, BUDGET)


@query(
    "analysis_batches",
    o.sql(
        "SELECT paper_id, CAST(batch_index AS BIGINT) AS batch_index, passage_type, CASE WHEN len(path) > 0 THEN"
        " passage_type || ':' || array_to_string(path, ' > ') ELSE passage_type END AS group_key, array_to_string(ids,"
        " ',') AS sources, token_count FROM fin2", "passages", recursive=True, **BATCH,
    ),
)
def analysis_batches(c: Corpus):
    _, batches = batch_parts(c)
    return batches.select(
        "paper_id", "batch_index", "passage_type", "group_key",
        F.array_join("source_passage_ids", ",").alias("sources"), "token_count",
    )


@query("split_to_budget")
def split_to_budget(c: Corpus):
    """Every passage cut to payloads of the default budget."""
    return an.prepared_passages(c.passages, BUDGET).select(
        "id", "fragment_index", "fragment_count", F.length("text").alias("chars"), "words"
    )


UNDERSTAND = dict(
    **LABELLED,
    rk="SELECT *, CASE WHEN contains(lb, 'limitation') OR contains(lb, 'future work') THEN least(r0, 45) ELSE r0 END AS r"
    " FROM (SELECT *, CASE kind WHEN 'abstract' THEN 0 WHEN 'introduction' THEN 10 WHEN 'method' THEN 20 WHEN 'result'"
    " THEN 30 WHEN 'discussion' THEN 40 WHEN 'limitation' THEN 50 WHEN 'body' THEN 70 WHEN 'appendix' THEN 90 ELSE 80"
    f" END AS r0, lower(array_to_string(list_concat([section, kind], hp), ' ')) AS lb, {o.tokens_n('original_text')} AS t"
    " FROM lab WHERE NOT ref)",
    no="SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY r, page_number, paragraph_index) AS n FROM rk",
    un="SELECT paper_id, n, [id] AS ids, t AS used FROM no WHERE n = 1 UNION ALL SELECT no.paper_id, no.n, CASE WHEN"
    " len(ids) < 24 AND used + t <= 12000 THEN list_append(ids, id) ELSE ids END, CASE WHEN len(ids) < 24 AND used + t <="
    " 12000 THEN used + t ELSE used END FROM un JOIN no ON no.paper_id = un.paper_id AND no.n = un.n + 1",
)


@query(
    "understanding_passages",
    o.sql(
        "SELECT paper_id, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM un QUALIFY n = max(n) OVER (PARTITION"
        " BY paper_id)", "passages", recursive=True, **UNDERSTAND,
    ),
)
def understanding_passages(c: Corpus):
    return an.understanding_passages(c.passages).select("paper_id", "id", "place")


@query(
    "metadata_passages",
    o.sql(
        "SELECT paper_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN plain THEN"
        " 0 ELSE r END, CASE WHEN plain THEN 0 ELSE page_number END, page_number, paragraph_index) AS place FROM (SELECT"
        " *, n <= 10 OR ok = 0 AS plain FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (r < 200) OVER w AS ok FROM"
        " rk WINDOW w AS (PARTITION BY paper_id))) WHERE plain OR r < 200) WHERE place <= 10",
        "passages", **LABELLED,
        rk0=f"SELECT *, array_to_string(list_transform(list_concat([section, kind], hp), lambda q: {o.label('q')}), ' ') AS"
        f" lb, replace(lower({o.ws('substr(original_text, 1, 240)')}), ' ', '') AS op FROM lab",
        rk="SELECT *, CASE WHEN ref THEN 200 ELSE least(100, CASE WHEN page_number <= 3 THEN 10 + page_number ELSE 100"
        " END, CASE WHEN contains(replace(lb, ' ', ''), 'abstract') OR contains(op, 'abstract') THEN 0 ELSE 100 END, CASE"
        " WHEN contains(lb, 'article info') OR contains(lb, 'keywords') THEN 1 ELSE 100 END, CASE WHEN page_number <= 1"
        " THEN 2 ELSE 100 END, CASE WHEN kind = 'introduction' OR contains(lb, 'introduction') THEN 30 ELSE 100 END) END"
        " AS r FROM rk0",
    ),
)
def metadata_passages(c: Corpus):
    return an.metadata_passages(c.passages).select("paper_id", "id", "place")


@query(
    "render_prompt_payload",
    o.sql(
        "SELECT f.paper_id, CAST(f.batch_index AS BIGINT) AS batch_index, 'Context: {\"paper_id\":\"' || f.paper_id ||"
        " '\",\"space_id\":\"' || any_value(space_id) || '\",\"batch_index\":' || f.batch_index ||"
        " ',\"source_passage_ids\":' || to_json(any_value(f.ids)) || '}' AS context, string_agg('{\"source_id\":\"' || p.id ||"
        " '\",\"page_number\":' || page_number || ',\"section\":' || to_json(section) || ',\"heading_path\":' ||"
        f" to_json(hp) || ',\"text\":' || to_json({o.truncated('original_text')}) || '}}', chr(10) ORDER BY p.n) AS sources FROM"
        " fin2 f JOIN place USING (paper_id, batch_index) JOIN ordered p ON p.paper_id = place.paper_id AND p.n = place.n"
        " GROUP BY 1, f.batch_index", "passages", recursive=True, **BATCH,
    ),
)
def render_prompt_payload(c: Corpus):
    prepared, batches = batch_parts(c)
    # The reference's cut, as in the twin; the operator itself cuts nothing unless asked.
    return an.render_prompt_payload(batches, prepared, limit=tx.PAYLOAD_CHARS).select(
        "paper_id", "batch_index", "context", "sources"
    )


SCORES = dict(
    sc=f"SELECT paper_id, id AS passage_id, CAST({o.section_score('kind')} AS BIGINT) AS score FROM lab WHERE NOT ref",
)


@query("section_scores", o.sql("SELECT * FROM sc", "passages", **LABELLED, **SCORES))
def section_scores(c: Corpus):
    prepared, batches = batch_parts(c)
    return an.section_scores(batches, prepared).select("paper_id", "passage_id", "score")


def scores_of(c: Corpus):
    from leafgrain.functions import meta

    labelled = an.with_labels(c.passages).filter(~F.col("is_reference"))
    return labelled.select(
        "paper_id", "space_id", F.col("id").alias("passage_id"),
        meta.section_score(F.col("passage_type")).alias("score"),
    )


@query(
    "analysis_eligible",
    o.sql(
        "SELECT id, parse_status = 'parsed' AND has AS eligible, CASE WHEN parse_status <> 'parsed' THEN 'parsing has not"
        " completed' WHEN NOT has THEN 'parsing has not produced passages' ELSE '' END AS reason FROM (SELECT *, id IN"
        " (SELECT paper_id FROM passages) AS has FROM papers)", "papers", "passages",
    ),
)
def analysis_eligible(c: Corpus):
    return an.analysis_eligible(c.papers, c.passages).drop("space_id")


# ---------------------------------------------------------------- cards

VALID = (
    "concat_ws(',', CASE WHEN trim(summary) = '' THEN 'summary' END, CASE WHEN trim(evidence_quote) = '' THEN"
    " 'evidence_quote' END, CASE WHEN reasoning_summary = '' THEN 'reasoning_summary' END)"
)


@query("validate_cards", o.sql(f"SELECT id, {VALID} AS errors FROM cards", "cards"))
def validate_cards(c: Corpus):
    return cd.validate_cards(c.cards).select("id", F.array_join("errors", ",").alias("errors"))


JUDGED = dict(
    ex=f"SELECT k.id, k.paper_id, {VALID} AS errors, unnest(source_passage_ids) AS pid, evidence_quote FROM cards k",
    ck=f"SELECT ex.*, {o.evidence('evidence_quote')} AS qn, {o.evidence('p.original_text')} AS tn FROM ex LEFT JOIN passages"
    " p ON p.id = ex.pid AND p.paper_id = ex.paper_id",
    tk=f"SELECT *, {o.evidence_tokens('qn')} AS qt, {o.evidence_tokens('tn')} AS tt FROM ck",
    sp="SELECT id, any_value(errors) AS errors, count(*) FILTER (tn IS NULL) AS missing, string_agg(pid, ',' ORDER BY pid)"
    " FILTER (tn IS NULL) AS missing_ids, coalesce(bool_or(qn <> '' AND tn <> '' AND (contains(tn, qn) OR (len(qt) >= 3"
    " AND len(list_filter(qt, lambda x: list_contains(tt, x))) >= 3 AND len(list_filter(qt, lambda x:"
    " list_contains(tt, x))) / len(qt) >= 0.8))), FALSE) AS supported FROM tk GROUP BY 1",
    jd="SELECT id, CASE WHEN errors <> '' THEN 'invalid_card' WHEN missing > 0 THEN 'missing_source' WHEN NOT supported"
    " THEN 'evidence_mismatch' ELSE '' END AS reason, missing_ids, supported FROM sp",
)


@query(
    "verify_cards",
    o.sql("SELECT id, reason = '' AS accepted, reason, CASE WHEN reason = 'missing_source' THEN missing_ids ELSE '' END AS"
          " missing FROM jd", "cards", "passages", **JUDGED),
)
def verify_cards(c: Corpus):
    missing = F.when(F.col("reason") == "missing_source", F.array_join("rejected_ids", ",")).otherwise("")
    return cd.verify_cards(c.cards, c.passages).select("id", "accepted", "reason", missing.alias("missing"))


@query(
    "verify_sources",
    o.sql("SELECT id, coalesce(missing_ids, '') AS missing FROM sp", "cards", "passages", **JUDGED),
)
def verify_sources(c: Corpus):
    return cd.cited_support(c.cards, c.passages).select("id", F.array_join("missing_ids", ",").alias("missing"))


@query(
    "evidence_supported",
    o.sql("SELECT id, supported FROM sp", "cards", "passages", **JUDGED),
)
def evidence_supported(c: Corpus):
    return cd.cited_support(c.cards, c.passages).select("id", "supported")


@query(
    "benchmark_evidence",
    f"SELECT item_id, bool_or(contains({o.evidence('d.text')}, {o.evidence('b.text')})) AS quoted FROM benchmark b CROSS JOIN"
    " documents d GROUP BY 1",
)
def benchmark_evidence(c: Corpus):
    """Every benchmark text as a quote against every document."""
    quotes = c.table("benchmark").select("item_id", tx.evidence_norm(F.col("text")).alias("quote"))
    texts = c.documents.select("doc_id", tx.evidence_norm(F.col("text")).alias("text"))
    return cd.quoted_anywhere(quotes, "item_id", texts, "doc_id").select("item_id", "quoted")


BATCHES_SQL = dict(
    bt="SELECT paper_id, card_index // 100 AS batch_index, list_distinct(flatten(list(source_passage_ids))) AS own, max(CASE"
    f" WHEN {VALID} <> '' THEN 1 ELSE 0 END) AS bad FROM cards GROUP BY 1, 2",
    vb="SELECT paper_id, batch_index, bad = 0 AND batch_index % 4 <> 3 AS valid FROM bt",
)


def card_batches(c: Corpus):
    """A conversation is a batch; every fourth batch forgets its sources."""
    keyed = c.cards.withColumn("batch_index", F.floor(F.col("card_index") / 100).cast("int"))
    own = keyed.select("paper_id", "space_id", "batch_index", F.explode("source_passage_ids").alias("s"))
    batches = own.groupBy("paper_id", "space_id", "batch_index").agg(F.collect_set("s").alias("_s"))
    ids = F.when(F.col("batch_index") % 4 == 3, NONE).otherwise(F.col("_s"))
    return batches.select("paper_id", "space_id", "batch_index", ids.alias("source_passage_ids")), keyed


@query("validate_card_batches",
       o.sql("SELECT * FROM vb", "cards", **BATCHES_SQL))
def validate_card_batches(c: Corpus):
    return cd.validate_card_batches(*card_batches(c)).select("paper_id", "batch_index", "valid")


@query(
    "verify_card_batches",
    o.sql(
        "SELECT k.paper_id, k.card_index // 100 AS batch_index, k.card_index, jd.reason FROM cards k JOIN jd USING (id) JOIN"
        " vb ON vb.paper_id = k.paper_id AND vb.batch_index = k.card_index // 100 WHERE valid UNION ALL SELECT paper_id,"
        " batch_index, -1, 'invalid_batch' FROM vb WHERE NOT valid", "cards", "passages", **JUDGED, **BATCHES_SQL,
    ),
)
def verify_card_batches(c: Corpus):
    batches, cards = card_batches(c)
    return cd.verify_card_batches(batches, cards, c.passages).select(
        "paper_id", "batch_index", "card_index", "reason"
    )


@query(
    "merge_repair_round",
    o.sql(
        "SELECT paper_id, batch_index, status, CAST(CASE WHEN status = 'failed' THEN 0 ELSE ok1 + CASE WHEN status IN"
        " ('repaired', 'partially_repaired') THEN ok2 ELSE 0 END END AS BIGINT) AS accepted_card_count, CAST(CASE status"
        " WHEN 'failed' THEN 1 WHEN 'completed' THEN 0 WHEN 'repair_failed' THEN no1 ELSE no2 END AS BIGINT) AS"
        " rejected_card_count FROM (SELECT *, CASE WHEN batch_index % 7 = 6 THEN 'failed' WHEN no1 = 0 THEN 'completed'"
        " WHEN batch_index % 5 = 4 THEN 'repair_failed' WHEN no2 = 0 THEN 'repaired' ELSE 'partially_repaired' END AS"
        " status FROM (SELECT paper_id, card_index // 100 AS batch_index, count(*) FILTER (reason = '') AS ok1, count(*)"
        " FILTER (reason <> '') AS no1, count(*) FILTER (reason <> '' AND card_index % 2 = 0) AS ok2, count(*) FILTER"
        " (reason <> '' AND card_index % 2 = 1 AND card_index % 3 = 0) AS no2 FROM cards JOIN jd USING (id) GROUP BY 1,"
        " 2))", "cards", "passages", **JUDGED,
    ),
)
def merge_repair_round(c: Corpus):
    batches, cards = card_batches(c)
    verdicts = cd.verify_cards(cards, c.passages)
    rejected = verdicts.filter(~F.col("accepted"))
    index = F.col("card_index")
    repaired = rejected.filter((index % 2 == 0) | (index % 3 == 0)).withColumn("accepted", index % 2 == 0)
    calls = batches.withColumns({
        "error": F.when(F.col("batch_index") % 7 == 6, "call failed"),
        "repair_error": F.when(F.col("batch_index") % 5 == 4, "repair failed"),
    })
    return cd.merge_repair_round(calls, verdicts, repaired).select(
        "paper_id", "batch_index", "status", "accepted_card_count", "rejected_card_count"
    )


@query(
    "extract_cards",
    o.sql(
        "SELECT paper_id, CAST(batch_index AS BIGINT) AS batch_index, CASE WHEN batch_index % 7 = 6 THEN 'failed' WHEN"
        " batch_index % 3 = 1 THEN 'repaired' ELSE 'completed' END AS status, CAST(CASE WHEN batch_index % 7 = 6 THEN 0 ELSE"
        " len(ids) END AS BIGINT) AS accepted_card_count, CAST(batch_index % 7 = 6 AS BIGINT) AS rejected_card_count FROM fin2",
        "passages", recursive=True, **BATCH,
    ),
)
def extract_cards(c: Corpus):
    """Outcomes of the extractor loop over all batches, with an extractor that quotes every source."""
    folder = work_dir(c.spark, "extraction")
    prepared = xt.prepared_once(c.passages, folder, BUDGET)
    batches = an.analysis_batches(prepared, BUDGET)
    found = xt.extract_cards(
        prepared, batches, c.passages, an.section_scores(batches, prepared), quoting_extractor, folder, waves=2,
    )
    return found.outcomes.select("paper_id", "batch_index", "status", "accepted_card_count", "rejected_card_count")


def quoting_extractor(batch: dict) -> list[dict]:
    """A card per source; some calls fail, and some answers start with a wrong quote that the repair round mends."""
    if batch["batch_index"] % 7 == 6:
        raise RuntimeError("no answer")
    sources = {}
    for line in map(json.loads, batch["sources"].split("\n")):
        sources.setdefault(line["source_id"], line["text"])
    cards = [
        {"card_type": "Claim", "summary": text, "source_passage_ids": [source], "evidence_quote": text, "reasoning_summary": "quoted",
         "confidence": 0.5} for source, text in sources.items()
    ]
    if batch["diagnostics"]:
        return [cards[r["reply_index"]] for r in json.loads(batch["diagnostics"])]
    if batch["batch_index"] % 3 == 1:
        cards[0]["evidence_quote"] = "xylophones quarrel zealously"
    return cards


@query(
    "derive_cards",
    o.sql(
        "SELECT id || ':' || f AS id, t AS card_type, CASE WHEN f = 'problem' THEN title ELSE f || ' of ' || id END AS"
        " summary, CASE WHEN f = 'problem' THEN title ELSE 'quote ' || doc_id END AS evidence_quote, CASE WHEN f = 'problem'"
        " THEN id || '-p1' ELSE id || '-p0' END AS first_source FROM (SELECT *, unnest(['problem', 'method', 'results',"
        " 'conclusion', 'limitations']) AS f, unnest(['Problem', 'Method', 'Result', 'Interpretation', 'Limitation']) AS t"
        " FROM papers) WHERE NOT (f = 'limitations' AND doc_id % 2 = 0) AND NOT (f = 'problem' AND title = '')", "papers",
    ),
)
def derive_cards(c: Corpus):
    def field(name):
        return F.struct(
            F.concat(F.lit(f"{name} of "), "id").alias("text"),
            F.array(F.concat("id", F.lit("-p0"))).alias("source_passage_ids"),
            F.concat(F.lit("quote "), "doc_id").alias("evidence_quote"), F.lit("why").alias("reasoning_summary"),
        )

    summaries = c.papers.select(
        F.col("id").alias("paper_id"), "space_id", F.array(F.concat("id", F.lit("-p1"))).alias("source_passage_ids"),
        F.col("title").alias("problem"), field("method").alias("method"), field("results").alias("results"),
        field("conclusion").alias("conclusion"),
        F.when(F.col("doc_id") % 2 == 1, field("limitations")).alias("limitations"),
    )
    return cd.derive_cards(summaries).select(
        "id", "card_type", "summary", "evidence_quote", F.col("source_passage_ids")[0].alias("first_source")
    )


RANKED = dict(
    **LABELLED, **SCORES,
    ks="SELECT k.*, coalesce((SELECT max(score) FROM sc WHERE sc.paper_id = k.paper_id AND list_contains("
    "k.source_passage_ids, sc.passage_id)), 0) AS score FROM cards k",
    kr="SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(confidence, 6) DESC, len(source_passage_ids)"
    " DESC, score DESC, card_index) AS n FROM ks",
)


@query("rank_cards", o.sql("SELECT id, n AS card_rank, CAST(score AS BIGINT) AS section_score FROM kr", "cards", "passages", **RANKED))
def rank_cards(c: Corpus):
    return cd.rank_cards(c.cards, scores_of(c)).select("id", "card_rank", "section_score")


@query(
    "top_cards_per_paper",
    o.sql("SELECT id, n AS card_rank, CASE WHEN n <= 20 THEN 'ranked' ELSE 'overflow' END AS verdict FROM kr", "cards",
          "passages", **RANKED),
)
def top_cards_per_paper(c: Corpus):
    return cd.top_cards_per_paper(c.cards, scores_of(c)).select("id", "card_rank", "verdict")


TOKENS = o.summary_tokens("summary")
SIM = o.jaccard("a.tk", "b.tk")


@query(
    "duplicate_card_pairs",
    o.sql(
        "SELECT ca AS left_id, cb AS right_id, any_value(similarity) AS similarity, count(*) AS pairs FROM (SELECT"
        " least(a.c, b.c) AS ca, greatest(a.c, b.c) AS cb, round(" + SIM + ", 6) AS similarity FROM t a JOIN t b ON"
        " a.paper_id = b.paper_id AND a.card_type = b.card_type AND a.id < b.id AND len(list_intersect(a.src, b.src)) > 0"
        " WHERE " + SIM + " >= 0.75) GROUP BY 1, 2", "cards",
        t0=f"SELECT *, list_sort(list_distinct({TOKENS})) AS tk, list_sort(source_passage_ids) AS src FROM cards",
        t="SELECT *, min(id) OVER (PARTITION BY paper_id, card_type, tk, src) AS c FROM t0",
    ),
)
def duplicate_card_pairs(c: Corpus):
    return cd.duplicate_card_pairs(c.cards).select(
        "left_id", "right_id", F.round("similarity", 6).alias("similarity"), "pairs"
    )


DEDUP = dict(
    **RANKED,
    t=f"SELECT *, list_distinct({TOKENS}) AS tk FROM kr",
    nb="SELECT b.id, list(a.n ORDER BY a.n) AS ns FROM t a JOIN t b ON a.paper_id = b.paper_id AND a.card_type = b.card_type"
    " AND a.n < b.n AND len(list_intersect(a.source_passage_ids, b.source_passage_ids)) > 0 WHERE " + SIM + " >= 0.75"
    " GROUP BY 1",
    seq="SELECT t.paper_id, t.n, t.id, coalesce(ns, []) AS ns FROM t LEFT JOIN nb USING (id)",
    walk="SELECT paper_id, n, [n] AS kept, CAST(NULL AS BIGINT) AS dup FROM seq WHERE n = 1 UNION ALL SELECT paper_id, n,"
    " CASE WHEN d IS NULL THEN list_append(kept, n) ELSE kept END, d FROM (SELECT s.paper_id, s.n, w.kept, list_min("
    "list_intersect(w.kept, s.ns)) AS d FROM walk w JOIN seq s ON s.paper_id = w.paper_id AND s.n = w.n + 1)",
    fin="SELECT s.id, CASE WHEN dup IS NULL THEN row_number() OVER (PARTITION BY s.paper_id, dup IS NULL ORDER BY s.n) END"
    " AS r, o.id AS dup_id FROM walk w JOIN seq s ON s.paper_id = w.paper_id AND s.n = w.n LEFT JOIN seq o ON o.paper_id ="
    " w.paper_id AND o.n = w.dup",
)


@query(
    "dedup_rank_cards",
    o.sql(
        "SELECT id, CASE WHEN dup_id IS NOT NULL THEN 'duplicate' WHEN r <= 20 THEN 'ranked' ELSE 'overflow' END AS verdict,"
        " coalesce(r, -1) AS card_rank, coalesce(dup_id, '') AS duplicate_of FROM fin", "cards", "passages", recursive=True,
        **DEDUP,
    ),
)
def dedup_rank_cards(c: Corpus):
    return cd.dedup_rank_cards(c.cards, scores_of(c)).select(
        "id", "verdict", F.coalesce("card_rank", F.lit(-1)).alias("card_rank"),
        F.coalesce("duplicate_of", F.lit("")).alias("duplicate_of"),
    )


@query(
    "replace_ai_cards",
    o.sql(
        "SELECT 'card' AS kind, id, created_by FROM cards WHERE NOT (created_by = 'ai' AND NOT user_edited AND paper_no % 2"
        " = 0) UNION ALL SELECT 'card', 'new-' || id, 'ai' FROM cards WHERE paper_no % 2 = 0 AND card_index % 2 = 0 UNION"
        " ALL SELECT 'link', id, '' FROM card_sources WHERE card_id NOT IN (SELECT id FROM cards WHERE created_by = 'ai' AND"
        " NOT user_edited AND paper_no % 2 = 0) UNION ALL SELECT 'link', 'new-' || s.id, '' FROM card_sources s JOIN cards k"
        " ON k.id = s.card_id WHERE paper_no % 2 = 0 AND card_index % 2 = 0",
        "card_sources",
    ).replace("FROM cards", "FROM (SELECT *, CAST(split_part(paper_id, '-', 2) AS BIGINT) AS paper_no FROM cards)").replace(
        "JOIN cards k", "JOIN (SELECT *, CAST(split_part(paper_id, '-', 2) AS BIGINT) AS paper_no FROM cards) k"
    ),
)
def replace_ai_cards(c: Corpus):
    new = c.cards.filter((number % 2 == 0) & (F.col("card_index") % 2 == 0)).withColumn(
        "id", F.concat(F.lit("new-"), "id")
    )
    cards, links = cd.replace_ai_cards(c.cards, c.card_sources, new, F.lit("run-2"), NOW)
    return cards.select(F.lit("card").alias("kind"), "id", "created_by").unionByName(
        links.select(F.lit("link").alias("kind"), "id", F.lit("").alias("created_by"))
    )


@query(
    "apply_card_edits",
    o.sql(
        "SELECT id, CASE WHEN e THEN 'edited ' || id ELSE summary END AS summary, CASE WHEN e THEN 'Claim' ELSE card_type END"
        " AS card_type, user_edited OR e AS user_edited, CASE WHEN e THEN 'user' ELSE created_by END AS created_by FROM"
        " (SELECT *, card_index % 4 = 1 AS e FROM cards)", "cards",
    ),
)
def apply_card_edits(c: Corpus):
    index = F.col("card_index")
    edits = c.cards.filter(index % 4 < 2).select(
        "id", "space_id", F.concat(F.lit("edited "), "id").alias("summary"),
        F.when(index % 4 == 0, "Nonsense").otherwise("Claim").alias("card_type"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return cd.apply_card_edits(c.cards, edits, NOW).select(
        "id", "summary", "card_type", "user_edited", "created_by"
    )


@query(
    "append_cards",
    o.sql(
        "SELECT id, CASE WHEN card_index % 6 = 5 THEN 'invalid card type' WHEN card_index % 7 = 3 THEN 'confidence must be"
        " between 0 and 1' WHEN card_index % 5 = 4 THEN 'paper not found' WHEN source_passage_id IS NOT NULL AND NOT EXISTS"
        " (SELECT 1 FROM passages p WHERE p.id = k.source_passage_id) THEN 'source passage must belong to the same paper and"
        " space' ELSE '' END AS reason FROM (SELECT id, card_index, 'doc-' || split_part(paper_id, '-', 2) || '-p' ||"
        " (card_index % 100) AS source_passage_id FROM cards) k", "cards", "passages",
    ),
)
def append_cards(c: Corpus):
    index = F.col("card_index")
    new = c.cards.select(
        "id", F.when(index % 5 == 4, "nowhere").otherwise(F.col("paper_id")).alias("paper_id"), "space_id",
        F.when(index % 6 == 5, "Nonsense").otherwise(F.col("card_type")).alias("card_type"), "summary",
        F.when(index % 7 == 3, 1.5).otherwise(F.col("confidence")).alias("confidence"),
        F.concat("paper_id", F.lit("-p"), index % 100).alias("source_passage_id"),
    )
    accepted, rejected = cd.append_cards(new, c.papers, c.passages)
    return accepted.select("id", F.lit("").alias("reason")).unionByName(rejected.select("id", "reason"))


@query(
    "delete_cards",
    o.sql(
        "SELECT 'card' AS kind, id FROM cards WHERE card_index % 3 > 0 UNION ALL SELECT 'link', s.id FROM card_sources s JOIN"
        " cards k ON k.id = s.card_id WHERE card_index % 3 > 0", "card_sources",
    ),
)
def delete_cards(c: Corpus):
    cards, links = cd.delete_cards(c.cards, c.card_sources, c.cards.filter(F.col("card_index") % 3 == 0))
    return cards.select(F.lit("card").alias("kind"), "id").unionByName(
        links.select(F.lit("link").alias("kind"), "id")
    )


@query(
    "cards_with_titles",
    o.sql(
        "SELECT k.id, title AS paper_title FROM cards k JOIN papers p ON p.id = k.paper_id AND p.space_id = k.space_id",
        "cards", "papers",
    ),
)
def cards_with_titles(c: Corpus):
    return cd.cards_with_titles(c.cards, c.papers).select("id", "paper_title")


ENRICHED = (
    "SELECT k.id, card_type, coalesce((SELECT string_agg(s.id || ':' || coalesce(s.parse_run_id, '') || ':' ||"
    " s.parser_backend, ',' ORDER BY list_position(k.source_passage_ids, s.id)) FROM passages s WHERE s.paper_id ="
    " k.paper_id AND s.space_id = k.space_id AND list_contains(k.source_passage_ids, s.id)), '') AS sources FROM cards k"
)


@query("enrich_cards", o.sql(ENRICHED, "cards", "passages"))
def enrich_cards(c: Corpus):
    """Every second card has link rows; the others cite through evidence and single source."""
    links = c.card_sources.filter(F.crc32("card_id") % 2 == 0)
    text = F.transform(
        "source_passages",
        lambda s: F.concat_ws(":", s["passage_id"], F.coalesce(s["parse_run_id"], F.lit("")), s["parser_backend"]),
    )
    return cd.enrich_cards(c.cards, links, c.passages).select(
        "id", "card_type", F.coalesce(F.array_join(text, ","), F.lit("")).alias("sources")
    )


@query(
    "cards_by_type",
    o.sql(f"SELECT id, sources FROM ({ENRICHED}) WHERE card_type = 'Method'", "cards", "passages"),
)
def cards_by_type(c: Corpus):
    text = F.transform(
        "source_passages",
        lambda s: F.concat_ws(":", s["passage_id"], F.coalesce(s["parse_run_id"], F.lit("")), s["parser_backend"]),
    )
    rows = cd.cards_by_type(c.cards, c.papers, c.card_sources, c.passages, "Method")
    return rows.select("id", F.coalesce(F.array_join(text, ","), F.lit("")).alias("sources"))


@query(
    "paper_summary",
    o.sql(
        "SELECT id AS paper_id, (SELECT count(*) FROM passages p WHERE p.paper_id = papers.id) AS passage_count, (SELECT"
        " count(*) FROM cards k WHERE k.paper_id = papers.id) AS card_count FROM papers", "papers", "passages", "cards",
    ),
)
def paper_summary(c: Corpus):
    return cd.paper_summary(c.papers, c.passages, c.cards).select("paper_id", "passage_count", "card_count")


@query(
    "list_cards",
    o.sql(
        "SELECT space_id, id, place, " + o.stamp("created_at") + " AS created_at FROM (SELECT *, row_number() OVER (PARTITION"
        " BY space_id ORDER BY created_at DESC, id) AS place FROM cards) WHERE place <= 20", "cards",
    ),
)
def list_cards(c: Corpus):
    """The newest cards of each space, as the agent listing returns them."""
    return cd.newest_cards(c.cards, ["space_id"], 20).select(
        "space_id", "id", "place", stamp("created_at").alias("created_at")
    )
