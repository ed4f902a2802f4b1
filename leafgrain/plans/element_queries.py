"""Queries over sources, markup and layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrain.functions import meta
from leafgrain.functions import text as tx
from leafgrain.operators import analysis as an
from leafgrain.operators import layout as ly
from leafgrain.operators.keyed import work_dir
from leafgrain.plans import oracle_base as o
from leafgrain.plans.corpus import Corpus
from leafgrain.plans.registry import query, setup
from leafgrain.sources import markup as mk
from leafgrain.sources import tables as tb

@setup
def columns() -> None:
    global d, p, NONE
    d, p = F.col("doc_id"), F.col("pos")
    NONE = F.array().cast("array<string>")


# ---------------------------------------------------------------- tables

@query(
    "load_tables",
    o.sql(
        "SELECT s.id, s.name, s.status, count(*) AS papers, count(*) FILTER (parse_status = 'parsed')"
        " AS parsed FROM spaces s JOIN papers p ON p.space_id = s.id GROUP BY 1, 2, 3",
        "spaces", "papers",
    ),
)
def load_tables(c: Corpus):
    """Papers and spaces written as typed tables, then read back with declared schemas."""
    root = work_dir(c.spark, "tables")
    tb.save_table(c.papers.drop("doc_id"), root, "papers")
    tb.save_table(c.spaces, root, "spaces")
    t = tb.load_tables(c.spark, root, ["papers", "spaces"])
    counts = t["papers"].groupBy("space_id").agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.col("parse_status") == "parsed").alias("parsed"),
    )
    joined = t["spaces"].join(counts, t["spaces"]["id"] == counts["space_id"])
    return joined.select("id", "name", "status", "papers", "parsed")


def files_of(c: Corpus):
    return c.documents.select(
        d.alias("file_id"), F.col("source").alias("space_id"),
        F.concat(d, F.lit("_"), "lang", F.lit(".pdf")).alias("filename"),
        F.col("text").cast("binary").alias("content"), d.alias("arrived"),
    )


def known_papers(c: Corpus):
    return c.papers.filter(d % 10 == 0).select(
        F.concat(F.lit("old-"), d).alias("id"), "space_id", "file_hash"
    )


FILE_TITLE = o.file_title("doc_id || '_' || lang || '.pdf'")
REGISTERED = (
    "SELECT doc_id AS file_id, space_id, file_hash, coalesce(known, 'paper-' || first) AS paper_id,"
    " known IS NULL AND doc_id = first AS is_new, NOT (known IS NULL AND doc_id = first) AS reparse,"
    f" CASE WHEN known IS NULL AND doc_id = first THEN {FILE_TITLE} ELSE '' END AS title,"
    " CASE WHEN known IS NULL AND doc_id = first THEN 'filename.fallback' ELSE '' END AS title_source,"
    " CASE WHEN known IS NULL AND doc_id = first THEN 0.1 ELSE 0.0 END::DOUBLE AS title_confidence,"
    " 'registered' AS status"
    " FROM (SELECT *, min(doc_id) OVER (PARTITION BY space_id, file_hash) AS first, min(CASE WHEN"
    " doc_id % 10 = 0 THEN 'old-' || doc_id END) OVER (PARTITION BY space_id, file_hash) AS known"
    " FROM (SELECT doc_id, lang, source AS space_id, sha256(text) AS file_hash FROM documents))"
)


@query("register_documents", REGISTERED)
def register_documents(c: Corpus):
    return tb.register_documents(files_of(c), known_papers(c))


FILES_SQL = (
    "SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM (SELECT doc_id // 40 * 2 + CAST(doc_id % 40 >= 22 AS INT)"
    " AS batch_id, doc_id AS file_id, CASE WHEN doc_id % 9 = 0 THEN 'a.txt' ELSE 'A.PDF' END AS filename,"
    " n_chars * 65536 AS size FROM documents)"
)


def batch_files(c: Corpus):
    """Uploads of 22 and 18 files in turn; a file has 65,536 bytes for each character."""
    batch = F.floor(d / 40) * 2 + (d % 40 >= 22).cast("int")
    return c.documents.select(
        batch.alias("batch_id"), d.alias("file_id"),
        F.when(d % 9 == 0, "a.txt").otherwise("A.PDF").alias("filename"),
        (F.col("n_chars") * 65536).alias("size"),
    )


@query(
    "ingest_report",
    f"SELECT batch_id, count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok)"
    f" AS failed FROM (SELECT *, n <= 20 AND lower(filename) LIKE '%.pdf' AND size <= 209715200 AS ok FROM"
    f" ({FILES_SQL})) GROUP BY 1",
)
def ingest_report(c: Corpus):
    return tb.ingest_report(batch_files(c), max_files=20)


LISTS = "CASE doc_id % 5 WHEN 0 THEN '[\"a\",\" b \",\"\"]' WHEN 1 THEN 'bad' WHEN 2 THEN '{\"k\":\"' || lang || '\"}' WHEN 3 THEN '[1,2]' ELSE '' END"


@query(
    "decode_json_columns",
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a|b' WHEN 3 THEN '1|2' ELSE '' END AS list,"
    " CASE WHEN doc_id % 5 = 2 THEN lang ELSE '' END AS value FROM documents",
)
def decode_json_columns(c: Corpus):
    raw = F.expr(LISTS.replace("||", "||"))
    decoded = tb.decode_json_columns(
        c.documents.select("doc_id", raw.alias("list"), raw.alias("object")), ["list"], ["object"]
    )
    return decoded.select(
        "doc_id", F.array_join("list", "|").alias("list"),
        F.coalesce(F.try_element_at("object", F.lit("k")), F.lit("")).alias("value"),
    )


def old_and_new(c: Corpus):
    """Stored outputs, and a second parse of every even paper."""
    number = F.split("paper_id", "-")[1].cast("long")
    passages = c.passages.select("id", "paper_id", "space_id", "parse_run_id", "content_hash")
    elements = c.elements.select("id", "paper_id", "space_id").withColumn(
        "parse_run_id", F.concat(F.lit("run-"), number)
    )
    run = F.concat(F.lit("second-"), number)
    new_elements = elements.filter(number % 2 == 0).withColumn("parse_run_id", run)
    new_passages = passages.filter((number % 2 == 0) & ~F.col("id").endswith("3")).withColumn(
        "parse_run_id", run
    )
    old = {"passages": passages, "document_elements": elements}
    return old, {"passages": new_passages, "document_elements": new_elements}


PARSED_PASSAGES = (
    "SELECT id, paper_id, coalesce(parse_run_id, '') AS parse_run_id, 'passages' AS kind FROM"
    " passages WHERE doc_id % 2 = 1 OR parse_run_id IS NULL UNION ALL SELECT 'second-' || doc_id ||"
    " ':' || id, paper_id, 'second-' || doc_id, 'passages' FROM passages WHERE doc_id % 2 = 0 AND id"
    " NOT LIKE '%3' UNION ALL SELECT CASE WHEN doc_id % 2 = 1 THEN id ELSE 'second-' || doc_id || ':'"
    " || id END, paper_id, CASE WHEN doc_id % 2 = 1 THEN 'run-' || doc_id ELSE 'second-' || doc_id END,"
    " 'elements' FROM (SELECT *, CAST(split_part(paper_id, '-', 2) AS BIGINT) AS doc_id FROM elements)"
)


@query("replace_parse_outputs", o.sql(PARSED_PASSAGES, "passages", "elements"))
def replace_parse_outputs(c: Corpus):
    result = tb.replace_parse_outputs(*old_and_new(c))
    run = F.coalesce("parse_run_id", F.lit("")).alias("parse_run_id")
    return result["passages"].select("id", "paper_id", run, F.lit("passages").alias("kind")).unionByName(
        result["document_elements"].select("id", "paper_id", run, F.lit("elements").alias("kind"))
    )


@query(
    "delete_parse_run",
    o.sql(
        "SELECT 'passages' AS kind, id FROM passages WHERE parse_run_id IS NULL OR doc_id % 3 <> 0"
        " UNION ALL SELECT 'embeddings', passage_id FROM emb WHERE passage_id NOT IN (SELECT id FROM"
        " passages WHERE parse_run_id IS NOT NULL AND doc_id % 3 = 0)", "passages", "emb",
    ),
)
def delete_parse_run(c: Corpus):
    runs = c.documents.filter(d % 3 == 0).select(F.concat(F.lit("run-"), d).alias("parse_run_id"))
    left = tb.delete_parse_run({"passages": c.passages, "embeddings": c.embeddings}, runs)
    return left["passages"].select(F.lit("passages").alias("kind"), "id").unionByName(
        left["embeddings"].select(F.lit("embeddings").alias("kind"), F.col("passage_id").alias("id"))
    )


@query(
    "cascade_delete_papers",
    o.sql(
        "SELECT 'papers' AS kind, id FROM papers WHERE parse_status <> 'error' UNION ALL SELECT"
        " 'passages', p.id FROM passages p JOIN papers ON papers.id = p.paper_id WHERE parse_status <>"
        " 'error' UNION ALL SELECT 'cards', k.id FROM cards k JOIN papers ON papers.id = k.paper_id"
        " WHERE parse_status <> 'error'", "papers", "passages", "cards",
    ),
)
def cascade_delete_papers(c: Corpus):
    ids = c.papers.filter("parse_status = 'error'").select(F.col("id").alias("paper_id"), "space_id")
    left = tb.cascade_delete_papers(
        {"papers": c.papers, "passages": c.passages, "cards": c.cards}, ids
    )
    parts = [df.select(F.lit(name).alias("kind"), "id") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "backfill_card_origin",
    o.sql("SELECT id, CASE WHEN user_edited THEN 'user' ELSE 'heuristic' END AS created_by FROM cards",
          "cards"),
)
def backfill_card_origin(c: Corpus):
    return tb.backfill_card_origin(c.cards).select("id", "created_by")


@query(
    "backfill_metadata_provenance",
    o.sql(
        "SELECT id, concat_ws('|', 'authors', CASE WHEN doi <> '' THEN 'doi' END, CASE WHEN title <> ''"
        " OR doc_id % 2 = 0 THEN 'title' END, 'venue', CASE WHEN year IS NOT NULL THEN 'year' END) AS"
        " fields, CASE WHEN doc_id % 2 = 0 THEN 'document.title' WHEN title <> '' THEN 'user.edit' ELSE"
        " '' END AS title_source, CASE WHEN doi <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS doi_confidence,"
        " 'user_edited' AS metadata_status FROM papers", "papers",
    ),
)
def backfill_metadata_provenance(c: Corpus):
    even = d % 2 == 0
    papers = c.papers.withColumns({
        "metadata_sources": F.when(even, F.create_map(F.lit("title"), F.lit("document.title")))
        .otherwise(F.create_map().cast("map<string,string>")),
        "metadata_confidence": F.create_map().cast("map<string,double>"),
        "user_edited_fields": F.when(even, F.array(F.lit("title"))).otherwise(NONE),
        "metadata_status": F.lit("empty"),
    })
    filled = tb.backfill_metadata_provenance(papers)
    return filled.select(
        "id", F.array_join("user_edited_fields", "|").alias("fields"),
        F.coalesce(F.try_element_at("metadata_sources", F.lit("title")), F.lit("")).alias("title_source"),
        F.coalesce(F.try_element_at("metadata_confidence", F.lit("doi")), F.lit(0.0)).alias("doi_confidence"),
        "metadata_status",
    )


@query(
    "backfill_embedding_status",
    o.sql(
        "SELECT id, CASE WHEN parse_status <> 'parsed' THEN 'old' WHEN id IN (SELECT paper_id FROM"
        " passages WHERE id IN (SELECT passage_id FROM emb)) THEN 'completed' ELSE 'pending' END AS"
        " embedding_status FROM papers", "papers", "passages", "emb",
    ),
)
def backfill_embedding_status(c: Corpus):
    papers = c.papers.withColumn("embedding_status", F.lit("old"))
    return tb.backfill_embedding_status(papers, c.passages, c.embeddings).select(
        "id", "embedding_status"
    )


# ---------------------------------------------------------------- markup

PARAGRAPHED = "replace(text, '.' || chr(10), '.' || chr(10) || chr(10))"


@query(
    "text_to_elements",
    "SELECT 'doc-' || doc_id AS paper_id, 'p0001-e' || lpad(CAST(i AS VARCHAR), 4, '0') AS id,"
    " i AS element_index, t AS text FROM (SELECT doc_id, unnest(ps) AS t, unnest(range(len(ps))) AS i"
    f" FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({o.strip(PARAGRAPHED)},"
    rf" '\n\s*\n'), lambda x: {o.dehyphen('x')}), lambda x: x <> '') AS ps FROM documents))",
)
def text_to_elements(c: Corpus):
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    docs = c.documents.select(F.concat(F.lit("doc-"), d).alias("paper_id"), text.alias("text"))
    return mk.text_to_elements(docs).select("paper_id", "id", "element_index", "text")


MARKDOWN = (
    "concat('# Paper ', doc_id, chr(10), chr(10), text, chr(10), '| k | v |', chr(10),"
    " '| --- | --- |', chr(10), '| id | ', doc_id, ' |', chr(10), 'tail ', lang, chr(10),"
    " chr(10), '## End', chr(10), '| lone |')"
)
MD_LINES = dict(
    md=f"SELECT doc_id, {MARKDOWN} AS text FROM documents",
    ml="SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text,"
    " chr(10))))) AS i FROM md",
    mt=r"SELECT *, regexp_matches(l, '^\s*\|(.*\|)?\s*$') AS tl, trim(regexp_replace(l,"
    r" '\s+$', '')) = '' AS blank FROM ml",
    ms="SELECT *, tl IS DISTINCT FROM lag(tl) OVER w OR coalesce(lag(blank) OVER w, TRUE) AS start FROM"
    " mt WINDOW w AS (PARTITION BY doc_id ORDER BY i)",
    mg="SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ms WHERE NOT blank",
    mb="SELECT doc_id, g, string_agg(l, chr(10) ORDER BY i) AS block FROM mg GROUP BY 1, 2",
    me="SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS element_index,"
    f" {o.strip('block')} AS block FROM mb",
)
SEPARATOR = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
CELLS_SQL = (
    "list_transform(list_filter(list_transform(string_split(block, chr(10)), lambda l: trim(l)),"
    rf" lambda l: regexp_matches(l, '^\|.*\|') AND NOT regexp_matches(l, '{SEPARATOR}')),"
    r" lambda l: list_transform(string_split(regexp_replace(l, '^\|+|\|+$', '', 'g'), '|'),"
    " lambda x: trim(x)))"
)
RENDERED_SQL = f"array_to_string(list_transform({CELLS_SQL}, lambda r: array_to_string(r, ' | ')), chr(10))"
IS_TABLE = f"coalesce(regexp_matches(trim(split_part(block, chr(10), 2)), '{SEPARATOR}'), false)"
IS_HEAD = r"(regexp_matches(block, '^(#{1,6})\s+(.+?)\s*$') AND NOT contains(block, chr(10)))"


def markdown_docs(c: Corpus):
    return c.documents.select(
        F.concat(F.lit("doc-"), d).alias("paper_id"), F.lit(1).alias("page_number"),
        F.expr(MARKDOWN).alias("text"),
    )


@query(
    "markdown_to_elements",
    o.sql(
        f"SELECT 'doc-' || doc_id AS paper_id, element_index, CASE WHEN {IS_TABLE} THEN 'table' WHEN"
        f" {IS_HEAD} THEN 'heading' ELSE 'paragraph' END AS element_type, CASE WHEN {IS_TABLE} THEN"
        f" {RENDERED_SQL} WHEN {IS_HEAD} THEN regexp_replace(block, '^#+\\s+', '') ELSE {o.ws('block')}"
        " END AS text FROM me", **MD_LINES,
    ),
)
def markdown_to_elements(c: Corpus):
    return mk.markdown_to_elements(markdown_docs(c)).select(
        "paper_id", "element_index", "element_type", "text"
    )


@query(
    "markdown_tables",
    o.sql(f"SELECT 'doc-' || doc_id AS paper_id, {RENDERED_SQL} AS cells FROM (SELECT doc_id, text AS"
          " block FROM md)", **MD_LINES),
)
def markdown_tables(c: Corpus):
    return markdown_docs(c).select(
        "paper_id", mk.render_cells(mk.table_rows(F.col("text"))).alias("cells")
    )


TABLE_HTML = (
    "concat(html, '<table><tr><th>Id</th><TH class=\"x\"> Url &amp; more</TH></tr><tr><td>', page_id,"
    " '</td><td><b>', replace(url, '&', '&amp;'), '</b> &lt;ok&gt;</td></tr><tr><td> </td></tr></table>')"
)


@query(
    "html_table_cells",
    "SELECT page_id, 'Id | Url & more' || chr(10) || page_id || ' | ' || url || ' <ok>' AS cells"
    " FROM pages",
)
def html_table_cells(c: Corpus):
    cells = mk.html_table_cells(F.expr(TABLE_HTML))
    return c.pages.select("page_id", mk.render_cells(cells).alias("cells"))


PAYLOAD_SPARK = """
CASE doc_id % 4
 WHEN 0 THEN to_json(named_struct('pages', array(
   named_struct('page', 7, 'items', array(
     named_struct('type', 'heading', 'value', concat('## H ', lang)),
     named_struct('type', 'table', 'value', ''),
     named_struct('type', 'text', 'value', text))),
   named_struct('page', 8, 'items', array(named_struct('type', 'text', 'value', ''))))))
 WHEN 1 THEN to_json(named_struct('items', named_struct('pages', array(
   named_struct('page_number', 3, 'md', concat('# T', doc_id, '\n\n', source))))))
 WHEN 2 THEN to_json(named_struct('data', array(
   named_struct('text', 'first'), named_struct('text', concat('second ', lang)))))
 ELSE to_json(named_struct('markdown', concat('# M\n\n', 'body ', source))) END
"""


@query(
    "payload_pages_to_items",
    "SELECT doc_id, page_index::BIGINT AS page_index, page_number::BIGINT AS page_number,"
    " item_index::BIGINT AS item_index, element_type, text FROM ("
    "SELECT doc_id, 0 AS page_index, 7 AS page_number, 0 AS item_index, 'heading' AS element_type,"
    " 'H ' || lang AS text FROM documents WHERE doc_id % 4 = 0 UNION ALL"
    " SELECT doc_id, 0, 7, 1, 'table', '' FROM documents WHERE doc_id % 4 = 0 UNION ALL"
    f" SELECT doc_id, 0, 7, 2, 'paragraph', {o.ws('text')} FROM documents WHERE doc_id % 4 = 0"
    f" AND {o.ws('text')} <> '' UNION ALL"
    " SELECT doc_id, 0, 3, 0, 'heading', 'T' || doc_id FROM documents WHERE doc_id % 4 = 1 UNION ALL"
    " SELECT doc_id, 0, 3, 1, 'paragraph', source FROM documents WHERE doc_id % 4 = 1 UNION ALL"
    " SELECT doc_id, 0, 1, 0, 'paragraph', 'first' FROM documents WHERE doc_id % 4 = 2 UNION ALL"
    " SELECT doc_id, 1, 2, 0, 'paragraph', 'second ' || lang FROM documents WHERE doc_id % 4 = 2"
    " UNION ALL SELECT doc_id, 0, 1, 0, 'heading', 'M' FROM documents WHERE doc_id % 4 = 3 UNION ALL"
    " SELECT doc_id, 0, 1, 1, 'paragraph', 'body ' || source FROM documents WHERE doc_id % 4 = 3)",
)
def payload_pages_to_items(c: Corpus):
    payloads = c.documents.select(d.alias("paper_id"), F.expr(PAYLOAD_SPARK).alias("payload"))
    return mk.payload_pages_to_items(payloads).withColumnRenamed("paper_id", "doc_id")


@query(
    "cells_to_grid",
    o.sql(
        "SELECT doc_id AS table_id, string_agg(line, chr(10) ORDER BY r) AS cells FROM (SELECT g.doc_id,"
        " g.r, string_agg(coalesce(text, ''), ' | ' ORDER BY g.k) AS line FROM grid g LEFT JOIN placed p"
        " ON p.doc_id = g.doc_id AND p.r = g.r AND p.k = g.k GROUP BY 1, 2) GROUP BY 1", "lines",
        placed=f"SELECT doc_id, pos // 4 AS r, pos % 3 AS k, arg_max({o.ws('line')}, pos) AS text FROM lines"
        " WHERE pos % 5 <> 4 GROUP BY ALL",
        dims="SELECT doc_id, max(r) AS mr, max(k) AS mk FROM placed GROUP BY 1",
        grid="SELECT doc_id, r, unnest(range(mk + 1)) AS k FROM (SELECT doc_id, unnest(range(mr + 1)) AS r,"
        " mk FROM dims)",
    ),
)
def cells_to_grid(c: Corpus):
    cells = c.lines.filter(p % 5 != 4).select(
        d.alias("table_id"), p.alias("seq"), F.floor(p / 4).cast("int").alias("row"),
        (p % 3).alias("col"), F.col("line").alias("text"),
    )
    return mk.cells_to_grid(cells).select("table_id", mk.render_cells(F.col("cells")).alias("cells"))


@query(
    "resolve_captions",
    o.sql(
        f"SELECT a.doc_id, a.pos, trim(concat_ws(' ', 'Figure ' || a.pos, CASE WHEN b.doc_id IS NULL THEN"
        f" '#/texts/' || (a.pos + 1) ELSE nullif({o.ws('b.line')}, '') END)) AS caption FROM lines a LEFT"
        " JOIN lines b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1", "lines",
    ),
)
def resolve_captions(c: Corpus):
    items = c.lines.select(
        d.alias("paper_id"), p.alias("item_index"),
        F.array(F.concat(F.lit("Figure "), p), F.concat(F.lit("#/texts/"), p + 1)).alias("captions"),
    )
    targets = c.lines.select(
        d.alias("paper_id"), F.lit("texts").alias("collection"), p.alias("index"),
        F.col("line").alias("text"),
    )
    return mk.resolve_captions(items, targets).select(
        F.col("paper_id").alias("doc_id"), F.col("item_index").alias("pos"), "caption"
    )


@query(
    "toc_headings",
    o.sql(
        "SELECT paper_id, element_index AS toc_index, CASE WHEN element_index % 2 = 0 THEN text ELSE"
        " text || ' x' END AS text, page_number + 1 AS page_number FROM elements e WHERE element_type ="
        " 'heading' AND text <> '' AND element_index % 2 = 1 AND NOT EXISTS (SELECT 1 FROM elements h"
        " WHERE h.element_type = 'heading' AND h.paper_id = e.paper_id AND h.page_number = e.page_number"
        " AND lower(h.text) = lower(e.text || ' x'))", "elements",
    ),
)
def toc_headings(c: Corpus):
    headings = c.elements.filter("element_type = 'heading' and text <> ''")
    index = F.col("element_index")
    toc = headings.select(
        "paper_id", "page_number", index.alias("toc_index"),
        F.when(index % 2 == 0, F.concat(F.lit("  "), "text")).otherwise(F.concat("text", F.lit(" x"))).alias("title"),
        (F.col("page_number") + 1).alias("item_page"),
    )
    return mk.toc_headings(toc, c.elements).select("paper_id", "toc_index", "text", "page_number")


# ---------------------------------------------------------------- layout

LABELS = ("section_header", "Text", "table", "picture", "list_item", "formula", "page_footer",
          "title", "caption", "code")
ITEM_TYPE = (
    "CASE (doc_id + pos) % 10 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'table' WHEN 3"
    " THEN 'figure' WHEN 4 THEN 'list' WHEN 5 THEN 'equation' WHEN 6 THEN 'page_footer' WHEN 7 THEN"
    " 'title' WHEN 8 THEN 'caption' ELSE 'code' END"
)
ITEMS = dict(
    items0=f"SELECT doc_id, pos, pos // 10 + 1 AS page_number, {ITEM_TYPE} AS element_type, {o.ws('line')}"
    " AS own, CASE WHEN pos % 4 = 0 THEN 'Cap ' || pos ELSE '' END AS caption, CASE WHEN pos % 6 = 5 THEN"
    " NULL ELSE pos % 4 END AS level FROM lines",
    items1="SELECT *, CASE WHEN element_type IN ('table', 'figure') THEN coalesce(nullif(caption, ''),"
    " nullif(own, ''), CASE WHEN element_type = 'table' THEN 'a | b' ELSE 'Figure' END) ELSE own END AS"
    " text FROM items0",
    items="SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS element_index FROM items1"
    " WHERE text <> '' OR element_type IN ('heading', 'table', 'figure')",
)


def layout_items(c: Corpus):
    labels = F.array(*[F.lit(x) for x in LABELS])
    return c.lines.select(
        d.alias("paper_id"), p.alias("item_index"), F.get(labels, ((d + p) % 10).cast("int")).alias("label"),
        F.col("line").alias("text"),
        F.when(p % 4 == 0, F.concat(F.lit("Cap "), p)).otherwise("").alias("caption"),
        F.array(F.array(F.lit("a"), F.lit("b"))).alias("cells"),
        (F.floor(p / 10) + 1).cast("int").alias("page_number"),
        F.when(p % 6 != 5, p % 4).alias("level"),
    )


@query(
    "layout_items_to_elements",
    o.sql(
        "SELECT doc_id AS paper_id, element_index, 'p' || lpad(CAST(page_number AS VARCHAR), 4, '0') ||"
        " '-e' || lpad(CAST(element_index AS VARCHAR), 4, '0') AS id, element_type, text FROM items",
        "lines", **ITEMS,
    ),
)
def layout_items_to_elements(c: Corpus):
    return ly.layout_items_to_elements(layout_items(c)).select(
        "paper_id", "element_index", "id", "element_type", "text"
    )


@query(
    "layout_tables_assets",
    o.sql(
        "SELECT doc_id AS paper_id, element_index, CASE WHEN element_type = 'table' THEN 'table-' ELSE"
        " 'asset-' END || lpad(CAST(n AS VARCHAR), 4, '0') AS id, element_type AS kind, caption FROM"
        " (SELECT *, row_number() OVER (PARTITION BY doc_id, element_type ORDER BY element_index) - 1 AS n"
        " FROM items WHERE element_type IN ('table', 'figure'))", "lines", **ITEMS,
    ),
)
def layout_tables_assets(c: Corpus):
    elements = ly.layout_items_to_elements(layout_items(c))
    rows = ly.layout_tables_assets(elements)
    return rows.select(
        "paper_id", F.regexp_extract("element_id", "e([0-9]+)$", 1).cast("int").alias("element_index"),
        "id", "kind", "caption",
    )


STACK = dict(
    **ITEMS,
    hs="SELECT doc_id, element_index, text, greatest(coalesce(level, 1), 1) AS level, row_number() OVER"
    " (PARTITION BY doc_id ORDER BY element_index) AS n FROM items WHERE element_type = 'heading'",
    fold="SELECT doc_id, element_index, n, CAST([] AS VARCHAR[]) AS before, CASE WHEN text = '' THEN"
    " CAST([] AS VARCHAR[]) ELSE [text] END AS after FROM hs WHERE n = 1 UNION ALL SELECT hs.doc_id,"
    " hs.element_index, hs.n, fold.after, CASE WHEN hs.text = '' THEN fold.after ELSE"
    " list_append(list_slice(fold.after, 1, hs.level - 1), hs.text) END FROM fold JOIN hs ON hs.doc_id ="
    " fold.doc_id AND hs.n = fold.n + 1",
)


@query(
    "heading_path_stack",
    o.sql(
        "SELECT i.doc_id AS paper_id, i.element_index, coalesce(array_to_string(CASE WHEN element_type ="
        " 'heading' THEN f.before ELSE f.after END, ' > '), '') AS path FROM items i ASOF LEFT JOIN fold f"
        " ON f.doc_id = i.doc_id AND f.element_index <= i.element_index", "lines", recursive=True, **STACK,
    ),
)
def heading_path_stack(c: Corpus):
    elements = ly.layout_items_to_elements(layout_items(c))
    return ly.heading_path_stack(elements).select(
        "paper_id", "element_index", F.array_join("heading_path", " > ").alias("path")
    )


@query(
    "heading_path_deeper",
    o.sql(
        "SELECT i.doc_id AS paper_id, i.element_index, coalesce(array_to_string(CASE WHEN element_type ="
        " 'heading' THEN f.before ELSE f.after END, ' > '), '') AS path FROM items i ASOF LEFT JOIN fold f"
        " ON f.doc_id = i.doc_id AND f.element_index <= i.element_index", "lines", recursive=True,
        **{**STACK, "hs": STACK["hs"].replace("greatest(coalesce(level, 1), 1)", "level"), "fold": STACK["fold"].replace(
            "list_slice(fold.after, 1, hs.level - 1)",
            "list_slice(fold.after, 1, greatest(coalesce(hs.level, len(fold.after) + 1), 1) - 1)",
        )},
    ),
)
def heading_path_deeper(c: Corpus):
    """The variant in which a heading without level goes one deeper."""
    elements = ly.layout_items_to_elements(layout_items(c))
    return ly.heading_path_stack(elements, "deeper").select(
        "paper_id", "element_index", F.array_join("heading_path", " > ").alias("path")
    )


RAW_TYPES = ("title", "Text", "paragraph", "table", "image", "figure", "equation", "formula", "aside")


@query(
    "content_list_types",
    o.sql(
        "SELECT doc_id, pos, CASE WHEN pos % 6 = 5 THEN CASE WHEN pos % 4 <= 1 AND pos % 7 > 2 THEN 'title' ELSE 'heading' END"
        " ELSE CASE (doc_id + pos) % 9 WHEN 0 THEN 'title' WHEN 3 THEN 'table' WHEN 4 THEN 'figure' WHEN 5 THEN 'figure' WHEN"
        " 6 THEN 'equation' WHEN 7 THEN 'equation' ELSE 'paragraph' END END AS element_type FROM lines", "lines",
    ),
)
def content_list_types(c: Corpus):
    """Types of flat content-list items; every sixth carries a text level."""
    raw = F.get(F.array(*[F.lit(x) for x in RAW_TYPES]), ((d + p) % 9).cast("int"))
    kind = ly.content_type(raw, F.when(p % 6 == 5, p % 4), p % 7 <= 2)
    return c.lines.select("doc_id", "pos", kind.alias("element_type"))


FLAT = (
    "SELECT *, CASE WHEN element_type IN ('heading', 'title') OR h IS NULL THEN CAST([] AS VARCHAR[])"
    " ELSE [h] END AS heading_path FROM (SELECT *, last_value(CASE WHEN element_type = 'heading' THEN text"
    " END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY element_index ROWS UNBOUNDED PRECEDING) AS h"
    " FROM elements)"
)


@query(
    "flat_heading_path",
    o.sql(f"SELECT id, array_to_string(heading_path, '') AS heading FROM ({FLAT})", "elements"),
)
def flat_heading_path(c: Corpus):
    return ly.flat_heading_path(c.elements).select(
        "id", F.array_join("heading_path", "").alias("heading")
    )


HEADERS = ("", "", "METHODS", "", "", "2. Results", "", "", "", "Discussion", "")
SECTION_LINES = (
    f"CASE WHEN pos % 4 = 1 AND list_extract({o.lit(HEADERS)}, CAST((doc_id + pos) % 11 + 1 AS BIGINT)) <>"
    f" '' THEN list_extract({o.lit(HEADERS)}, CAST((doc_id + pos) % 11 + 1 AS BIGINT)) ELSE line END"
)


@query(
    "sticky_section",
    o.sql(
        "SELECT doc_id AS paper_id, pos AS block_index, coalesce(s, 'introduction') AS section FROM (SELECT"
        " *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos // 10, pos % 10 // 2, pos % 2,"
        f" pos ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN length({o.strip('t')}) < 60 THEN"
        f" {o.header('t')} END AS h FROM (SELECT *, {SECTION_LINES} AS t FROM lines))) WHERE h IS NULL",
        "lines",
    ),
)
def sticky_section(c: Corpus):
    words = F.array(*[F.lit(x) for x in HEADERS])
    word = F.get(words, ((d + p) % 11).cast("int"))
    blocks = c.lines.select(
        d.alias("paper_id"), F.floor(p / 10).alias("page_number"), F.floor(p % 10 / 2).alias("y"),
        (p % 2).alias("x"), p.alias("block_index"),
        F.when((p % 4 == 1) & (word != ""), word).otherwise(F.col("line")).alias("text"),
    )
    return ly.sticky_section(blocks).select("paper_id", "block_index", "section")


@query(
    "drop_margins_and_fragments",
    o.sql(
        "SELECT paper_id, element_index, clean AS text FROM (SELECT *, count(*) OVER (PARTITION BY paper_id,"
        f" page_number) AS n, {o.dehyphen('text')} AS clean FROM elements WHERE text <> '') WHERE NOT (n > 3"
        " AND (bbox[2] < 56 OR bbox[4] > 744) AND length(text) < 150) AND length(clean) >= 30", "elements",
    ),
)
def drop_margins_and_fragments(c: Corpus):
    blocks = c.elements.select(
        "paper_id", "page_number", "element_index", F.col("bbox")[1].alias("y0"),
        F.col("bbox")[3].alias("y1"), F.lit(800.0).alias("page_height"), "text",
    )
    return ly.drop_margins_and_fragments(blocks).select("paper_id", "element_index", "text")


CHROME = dict(
    blk="SELECT source AS paper_id, doc_id AS page_number, unnest(b) AS block, unnest(range(len(b))) AS i,"
    " len(b) AS n FROM (SELECT doc_id, source, string_split(text, chr(10)) AS b0, list_filter("
    "regexp_split_to_array(text, '\\n[ \\t]*(?:\\n[ \\t]*)+'), lambda x: trim(x) <> '') AS b FROM documents)",
    edge=f"SELECT paper_id, page_number, 'h' AS role, {o.ws('lower(t)')} AS k FROM (SELECT paper_id,"
    " page_number, unnest([block, split_part(block, chr(10), 1)]) AS t FROM blk WHERE i = 0) UNION SELECT"
    f" paper_id, page_number, 'f', {o.ws('lower(t)')} FROM (SELECT paper_id, page_number, unnest([block,"
    " split_part(block, chr(10), -1)]) AS t FROM blk WHERE i = n - 1)",
    common="SELECT paper_id, role, k FROM edge WHERE k <> '' GROUP BY ALL HAVING count(*) >= 2",
)


@query(
    "mark_page_chrome",
    o.sql(
        "SELECT paper_id, page_number, element_type, count(*) AS blocks, sum(length(text))::BIGINT AS chars"
        " FROM (SELECT paper_id, page_number, CASE WHEN part = 0 THEN 'page_header' WHEN part = 2 THEN"
        " 'page_footer' WHEN part = 3 THEN 'page_header' WHEN part = 4 THEN 'page_footer' ELSE 'paragraph' END"
        f" AS element_type, {o.strip('t')} AS text FROM parts) WHERE text <> '' GROUP BY ALL",
        **CHROME,
        marks=f"SELECT *, {o.ws('lower(split_part(block, chr(10), 1))')} AS hl, {o.ws('lower(split_part(block, chr(10), -1))')}"
        f" AS fl, {o.ws('lower(block)')} AS kb, string_split(block, chr(10)) AS ls FROM blk WHERE n = 1",
        flags="SELECT *, len(ls) > 1 AND EXISTS (SELECT 1 FROM common c WHERE c.paper_id = m.paper_id AND"
        " c.role = 'h' AND c.k = m.hl) AS top, EXISTS (SELECT 1 FROM common c WHERE c.paper_id = m.paper_id"
        " AND c.role = 'h' AND c.k = m.kb) AS whole_h, EXISTS (SELECT 1 FROM common c WHERE c.paper_id ="
        " m.paper_id AND c.role = 'f' AND c.k = m.fl) AS tail_f, EXISTS (SELECT 1 FROM common c WHERE"
        " c.paper_id = m.paper_id AND c.role = 'f' AND c.k = m.kb) AS whole_f FROM marks m",
        cut="SELECT *, CASE WHEN top THEN ls[2:] ELSE ls END AS rest FROM flags",
        cut2="SELECT *, len(rest) > 1 AND tail_f AS bottom FROM cut",
        parts="SELECT paper_id, page_number, 0 AS part, ls[1] AS t FROM cut2 WHERE top UNION ALL SELECT"
        " paper_id, page_number, 2, ls[-1] FROM cut2 WHERE bottom UNION ALL SELECT paper_id, page_number,"
        " CASE WHEN bottom OR top THEN (CASE WHEN top AND NOT bottom AND len(rest) = 1 AND tail_f THEN 4 ELSE 1"
        " END) WHEN whole_h THEN 3 WHEN whole_f THEN 4 ELSE 1 END, array_to_string(CASE WHEN bottom THEN"
        " rest[:-2] ELSE rest END, chr(10)) FROM cut2",
    ),
)
def mark_page_chrome(c: Corpus):
    """Spaces as long papers, their documents as pages."""
    pages = c.documents.select(F.col("source").alias("paper_id"), d.alias("page_number"), "text")
    return ly.text_chrome(pages).filter("text <> ''").groupBy("paper_id", "page_number", "element_type").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars")
    )


BOX_KINDS = ("text", "page_header", "section-header", "picture", "list", "table", "other")
BOXES = dict(
    boxes=f"SELECT id, paper_id, page_number, bbox, CASE WHEN element_index % 10 IN (0, 9) AND element_index"
    f" % 3 > 0 THEN space_id ELSE text END AS text, list_extract({o.lit(BOX_KINDS)}, CAST(element_index % 7 +"
    " 1 AS BIGINT)) AS box_class, space_id FROM elements",
    rep=f"SELECT space_id, {o.ws('lower(text)')} AS k FROM boxes WHERE (bbox[4] <= 110 OR bbox[2] >= 600) AND"
    " text <> '' GROUP BY ALL HAVING count(*) >= 2",
)


def boxes_of(c: Corpus):
    """Elements as boxes; edge lines repeat their space name."""
    index = F.col("element_index")
    edge = (index % 10).isin(0, 9) & (index % 3 > 0)
    kinds = F.array(*[F.lit(x) for x in BOX_KINDS])
    return c.elements.select(
        "id", F.col("space_id").alias("paper_id"), "page_number", index.alias("box_index"),
        F.transform("bbox", lambda v: v + 0.0).alias("bbox"),
        F.when(edge, F.col("space_id")).otherwise(F.col("text")).alias("text"),
        F.get(kinds, (index % 7).cast("int")).alias("box_class"),
    ).withColumn("bbox", F.when(F.col("bbox")[1] >= 600, F.transform("bbox", lambda v: v + 100)).otherwise(F.col("bbox")))


@query(
    "classify_box_element",
    o.sql(
        "SELECT id, CASE WHEN box_class = 'page_header' THEN 'page_header' WHEN r AND bbox[4] <= 110 THEN"
        " 'page_header' WHEN r AND bbox[2] >= 600 THEN 'page_footer' WHEN box_class = 'section-header' THEN"
        " 'heading' WHEN box_class = 'table' THEN 'table' WHEN box_class = 'picture' THEN 'unknown' WHEN"
        " box_class = 'list' THEN 'list' WHEN box_class = 'text' THEN 'paragraph' ELSE 'unknown' END AS"
        f" element_type FROM (SELECT *, EXISTS (SELECT 1 FROM rep WHERE rep.space_id = b.space_id AND rep.k ="
        f" {o.ws('lower(b.text)')}) AS r FROM boxes b)", "elements", **BOXES,
    ),
)
def classify_box_element(c: Corpus):
    return ly.classify_box_element(ly.box_chrome(boxes_of(c))).select("id", "element_type")


@query(
    "promote_title",
    o.sql(
        "SELECT id, CASE WHEN element_index = t THEN 'title' ELSE element_type END AS element_type FROM"
        " (SELECT *, min(CASE WHEN element_type = 'paragraph' AND text <> '' AND len(string_split(text, ' '))"
        " <= 16 THEN element_index END) OVER (PARTITION BY paper_id) AS t FROM elements)", "elements",
    ),
)
def promote_title(c: Corpus):
    return ly.promote_title(c.elements).select("id", "element_type")


@query(
    "searchable_body",
    o.sql(
        f"SELECT id FROM ({FLAT}) WHERE element_type = 'paragraph' AND text <> '' AND lower(coalesce("
        "heading_path[1], '')) <> 'references'", "elements",
    ),
)
def searchable_body(c: Corpus):
    return ly.searchable_body(ly.flat_heading_path(c.elements)).select("id")


@query(
    "is_reference",
    o.sql(
        f"SELECT id, {o.is_reference('passage_type', 'section', 'heading_path')} AS is_reference FROM passages",
        "passages",
    ),
)
def is_reference(c: Corpus):
    flag = meta.is_reference(F.col("passage_type"), F.col("section"), F.col("heading_path"))
    return c.passages.select("id", flag.alias("is_reference"))


APATH = o.analysis_path("heading_path", "section")


@query(
    "classify_passage_type",
    o.sql(
        f"SELECT id, {o.heading_type('heading_path')} AS by_heading,"
        f" {o.analysis_type('passage_type', 'section', 'hp')} AS by_evidence, CASE WHEN"
        " starts_with(lo, 'abstract') THEN 'abstract' WHEN contains(lo, 'introduction') OR"
        " contains(lo, 'related work') THEN 'introduction' WHEN contains(lo, 'method') OR contains(lo,"
        " 'algorithm') OR contains(lo, 'architecture') THEN 'method' WHEN contains(lo, 'result') OR"
        " contains(lo, 'evaluation') OR contains(lo, 'experiment') THEN 'result' WHEN contains(lo,"
        " 'limitation') OR contains(lo, 'future work') THEN 'limitation' WHEN starts_with(lo, 'appendix')"
        " OR starts_with(lo, 'supplementary') THEN 'appendix' ELSE CASE WHEN"
        " upper(section) IN ('DISCUSSION') THEN 'discussion' WHEN upper(section) = 'REFERENCES' THEN"
        f" 'appendix' ELSE 'body' END END AS by_header FROM (SELECT *, {APATH} AS hp, lower(section) AS lo"
        " FROM passages)", "passages",
    ),
)
def classify_passage_type(c: Corpus):
    """The three rules side by side."""
    rows = an.with_labels(c.passages.withColumn("_by_heading", meta.heading_passage_type(F.col("heading_path"))))
    return rows.select(
        "id", F.col("_by_heading").alias("by_heading"), F.col("passage_type").alias("by_evidence"),
        meta.section_passage_type(meta.guess_section(F.col("section"))).alias("by_header"),
    )


@query(
    "section_priority",
    o.sql(
        f"SELECT id, {o.priority(o.analysis_type('passage_type', 'section', 'hp'))} AS priority FROM (SELECT"
        f" *, {APATH} AS hp FROM passages)", "passages",
    ),
)
def section_priority(c: Corpus):
    return an.with_labels(c.passages).select("id", meta.priority_of(F.col("passage_type")).alias("priority"))


@query(
    "union_bbox",
    o.sql(
        "SELECT paper_id, page_number, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1,"
        " max(bbox[4]) AS y1 FROM elements GROUP BY 1, 2", "elements",
    ),
)
def union_bbox(c: Corpus):
    box = F.col("bbox")
    return ly.union_bbox(c.elements, ["paper_id", "page_number"]).select(
        "paper_id", "page_number", box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"),
        box[3].alias("y1"),
    )


@query(
    "bbox_exclusion",
    o.sql(
        "SELECT b.id FROM elements b WHERE b.element_type <> 'table' AND NOT EXISTS (SELECT 1 FROM elements t"
        " WHERE t.element_type = 'table' AND t.paper_id = b.paper_id AND t.page_number = b.page_number AND"
        " greatest(0, least(b.bbox[3], t.bbox[3] + 250) - greatest(b.bbox[1], t.bbox[1])) * greatest(0,"
        " least(b.bbox[4], t.bbox[4] + 60) - greatest(b.bbox[2], t.bbox[2] - 30)) / 10000.0 >= 0.5)",
        "elements",
    ),
)
def bbox_exclusion(c: Corpus):
    box = F.col("bbox")
    tables = c.elements.filter("element_type = 'table'").withColumn(
        "bbox", F.array(box[0], box[1] - 30, box[2] + 250, box[3] + 60)
    )
    return ly.bbox_exclusion(c.elements.filter("element_type <> 'table'"), tables).select("id")


# ---------------------------------------------------------------- pages

PAGES = dict(
    words="SELECT paper_id, page_number, bbox[1] + (k % 4) * 50 AS x0, bbox[1] + (k % 4) * 50 + 40 AS x1 FROM"
    " (SELECT *, unnest(range(len(string_split(text, ' ')))) AS k FROM elements WHERE text <> '')",
    rules="SELECT paper_id, page_number, CASE WHEN element_index % 5 = 0 THEN 'rect' ELSE 'line' END AS kind,"
    " element_index % 3 AS m FROM elements",
    pgs="SELECT paper_id, page_number, sum(length(text)) AS chars, count(*) FILTER (element_type = 'table')"
    " AS tables FROM elements GROUP BY 1, 2",
    wc="SELECT paper_id, page_number, count(*) AS words, count(*) FILTER ((x0 + x1) / 2 < 255) AS l, count(*)"
    " FILTER ((x0 + x1) / 2 > 285) AS r FROM words GROUP BY 1, 2",
    rc="SELECT paper_id, page_number, sum(CASE WHEN kind = 'rect' THEN 2 WHEN m = 0 THEN 1 ELSE 0 END) AS h,"
    " sum(CASE WHEN kind = 'rect' THEN 2 WHEN m = 1 THEN 1 ELSE 0 END) AS v FROM rules GROUP BY 1, 2",
    two="SELECT paper_id, page_number FROM wc WHERE l >= 8 AND r >= 8 AND EXISTS (SELECT 1 FROM elements a JOIN"
    " elements b ON a.paper_id = b.paper_id AND a.page_number = b.page_number WHERE a.paper_id = wc.paper_id"
    " AND a.page_number = wc.page_number AND a.text <> '' AND b.text <> '' AND a.bbox[3] <= 255 AND b.bbox[1] >="
    " 285 AND least(a.bbox[4], b.bbox[4] - 40) - greatest(a.bbox[2], b.bbox[2] - 40) >= 20)",
    sig="SELECT paper_id, page_number, CAST(chars AS BIGINT) AS chars, coalesce(words, 0) AS words,"
    " CAST(coalesce(h, 0) AS BIGINT) AS h_lines, CAST(coalesce(v, 0) AS BIGINT) AS v_lines, native,"
    " native AND coalesce(words, 0) >= 6 AND (tables > 0 OR (h >= 3 AND v >= 3)) AS has_table, native AND two"
    " AS two_column FROM (SELECT p.*, words, h, v, chars >= 20 OR coalesce(words, 0) >= 3 AS native,"
    " (p.paper_id, p.page_number) IN (SELECT (paper_id, page_number) FROM two) AS two FROM pgs p LEFT JOIN wc"
    " USING (paper_id, page_number) LEFT JOIN rc USING (paper_id, page_number))",
)


def page_parts(c: Corpus):
    e = c.elements
    index, box = F.col("element_index"), F.col("bbox")
    k = F.col("k")
    words = e.filter("text <> ''").select(
        "paper_id", "page_number", "bbox", F.posexplode(F.split("text", " ")).alias("k", "w")
    ).select(
        "paper_id", "page_number", (box[0] + k % 4 * 50).alias("x0"),
        (box[0] + k % 4 * 50 + 40).alias("x1"), F.lit(540.0).alias("page_width"),
    )
    right = box[0] >= 285
    blocks = e.select(
        "paper_id", "page_number", "text", F.lit(540.0).alias("page_width"),
        F.when(right, F.array(box[0], box[1] - 40, box[2], box[3] - 40)).otherwise(box).alias("bbox"),
    )
    rules = e.select(
        "paper_id", "page_number", F.when(index % 5 == 0, "rect").otherwise("line").alias("kind"),
        F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"),
        F.when(index % 3 == 0, 90.0).otherwise(10.0).alias("x1"),
        F.when(index % 3 == 1, 90.0).otherwise(11.0).alias("y1"),
    )
    pages = e.groupBy("paper_id", "page_number").agg(
        F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("element_type") == "table").alias("tables"),
    )
    return pages, words, blocks, rules


@query("page_signals", o.sql("SELECT * FROM sig", "elements", **PAGES))
def page_signals(c: Corpus):
    return ly.page_signals(*page_parts(c))


@query("two_column_pages", o.sql("SELECT * FROM two", "elements", **PAGES))
def two_column_pages(c: Corpus):
    _, words, blocks, _ = page_parts(c)
    return ly.two_column_pages(words, blocks)


@query(
    "document_quality",
    o.sql(
        "SELECT paper_id, page_count, native_text_pages, image_only_pages, table_pages, two_column_pages,"
        " image_only_pages > 0 OR native_text_pages / page_count < 0.5 AS needs_ocr, table_pages > 0 OR"
        " two_column_pages > 0 AS needs_layout, round(greatest(0, least(1, native_text_pages / page_count -"
        " CASE WHEN table_pages > 0 OR two_column_pages > 0 THEN 0.15 ELSE 0 END)), 6) AS quality_score,"
        " concat_ws(',', CASE WHEN image_only_pages > 0 THEN 'image_only_pages_detected' END, CASE WHEN"
        " table_pages > 0 THEN 'tables_detected' END, CASE WHEN two_column_pages > 0 THEN"
        " 'two_column_layout_detected' END, CASE WHEN native_text_pages = 0 THEN 'no_native_text_detected'"
        " END) AS warnings FROM (SELECT paper_id, count(*) AS page_count, count(*) FILTER (native) AS"
        " native_text_pages, count(*) FILTER (NOT native) AS image_only_pages, count(*) FILTER (has_table) AS"
        " table_pages, count(*) FILTER (two_column) AS two_column_pages FROM sig GROUP BY 1)",
        "elements", **PAGES,
    ),
)
def document_quality(c: Corpus):
    report = ly.document_quality(ly.page_signals(*page_parts(c)))
    return report.withColumn("quality_score", F.round("quality_score", 6)).withColumn(
        "warnings", F.array_join("warnings", ",")
    )


__all__ = ["tx"]
