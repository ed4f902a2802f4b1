"""Queries over the chunker."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrain.functions import text as tx
from leafgrain.operators import chunking as ck
from leafgrain.operators import layout as ly
from leafgrain.operators import splitting as sp
from leafgrain.operators.keyed import number_rows
from leafgrain.plans import oracle_base as o
from leafgrain.plans.corpus import Corpus
from leafgrain.plans.element_queries import FLAT
from leafgrain.plans.registry import query, setup
from leafgrain.schemas import MAX_TOKENS

@setup
def columns() -> None:
    global NO_BOX
    NO_BOX = F.lit(None).cast("array<double>")


def headed(c: Corpus):
    return ly.flat_heading_path(c.elements)


def tables_of(c: Corpus, every: bool = False):
    """Every second (or every) table element owns a stored table: its words, six to a row."""
    index = F.col("element_index")
    words = F.split("text", " ")
    rows = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 6).cast("int")),
        lambda r: F.slice(words, r * 6 + 1, F.lit(6)),
    )
    return c.elements.filter((F.col("element_type") == "table") & (F.lit(every) | (index % 2 == 0))).select(
        F.concat(F.lit("t-"), "id").alias("id"), "paper_id", "space_id", F.col("id").alias("element_id"),
        "page_number", F.concat(F.lit("Table "), index).alias("caption"), rows.alias("cells"),
        F.lit(1).alias("header_rows"), NO_BOX.alias("bbox"),
    )


TABLE_TEXT = (
    "'Table ' || element_index || ' ' || array_to_string(list_transform(range((len(string_split(text, ' ')) -"
    " 1) // 6 + 1), lambda r: array_to_string(list_slice(string_split(text, ' '), r * 6 + 1, r * 6 + 6), ' | ')"
    "), ' ')"
)
PACK = dict(
    flat=FLAT,
    body=f"SELECT *, element_type = 'table' AS is_table, CASE WHEN element_type = 'table' AND element_index % 2"
    f" = 0 THEN {TABLE_TEXT} ELSE text END AS t FROM flat WHERE text <> '' AND (element_type = 'table' OR"
    " (element_type = 'paragraph' AND lower(coalesce(heading_path[1], '')) <> 'references'))",
    num=f"SELECT *, {o.words('text')} AS w, length(text) AS ch, row_number() OVER (PARTITION BY paper_id ORDER"
    " BY element_index) AS n FROM body",
    fold="SELECT paper_id, n, is_table, heading_path, w, ch, 1 AS g FROM num WHERE n = 1 UNION ALL SELECT"
    " paper_id, n, is_table, heading_path, CASE WHEN keep THEN fw + w ELSE w END, CASE WHEN keep THEN fc + 1 +"
    " ch ELSE ch END, CASE WHEN keep THEN fg ELSE fg + 1 END FROM (SELECT num.*, f.w AS fw, f.ch AS fc, f.g AS"
    " fg, NOT num.is_table AND NOT f.is_table AND num.heading_path = f.heading_path AND greatest(f.w + num.w,"
    " ceil((f.ch + 1 + num.ch) / 4.0)) <= LIMIT_ AS keep FROM fold f JOIN num ON num.paper_id = f.paper_id AND"
    " num.n = f.n + 1)",
)


def packed(limit: int) -> dict[str, str]:
    return {k: v.replace("LIMIT_", str(limit)) for k, v in PACK.items()}


BODY_ONLY = dict(packed(900))
BODY_ONLY["body"] = (
    "SELECT *, FALSE AS is_table FROM flat WHERE text <> '' AND element_type = 'paragraph' AND"
    " lower(coalesce(heading_path[1], '')) <> 'references'"
)


@query(
    "pack_elements",
    o.sql(
        "SELECT num.id, CAST(fold.g - 1 AS BIGINT) AS group_no FROM num JOIN fold USING (paper_id, n)",
        "elements", recursive=True, **BODY_ONLY,
    ),
)
def pack_elements(c: Corpus):
    return ck.pack_elements(headed(c)).select("id", "group_no")


SOFT = packed(700)
CHUNKS = dict(
    **SOFT,
    grp="SELECT n1.paper_id, g, any_value(n1.is_table) AS is_table, any_value(n1.heading_path) AS heading_path,"
    " list(id ORDER BY n) AS ids, list(greatest(n1.w, ceil(n1.ch / 4.0))::BIGINT ORDER BY n DESC) AS sizes,"
    " list(id ORDER BY n DESC) AS rids, string_agg(t, ' ' ORDER BY n) AS t, min(page_number) AS p0,"
    " max(page_number) AS p1 FROM num n1 JOIN (SELECT paper_id, n, g FROM fold) f USING (paper_id, n) GROUP BY"
    " 1, 2",
    tail="SELECT paper_id, g, string_agg(rid, ',' ORDER BY i DESC) AS tail FROM (SELECT *, coalesce(sum(sz) OVER"
    " (PARTITION BY paper_id, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM"
    " (SELECT paper_id, g, unnest(rids) AS rid, unnest(sizes) AS sz, unnest(range(len(rids))) AS i FROM grp))"
    " WHERE i = 0 OR (before < 100 AND before + sz <= 100) GROUP BY 1, 2",
    cuts=f"SELECT paper_id, g, 0 AS k, 1 AS s, {o.tokens('t')} > 900 AS over FROM grp UNION ALL SELECT c.paper_id,"
    " c.g, k + 1, s + 3600 + CASE WHEN substr(t, s + 3600, 1) = ' ' THEN 1 ELSE 0 END, over FROM cuts c JOIN grp"
    " ON grp.paper_id = c.paper_id AND grp.g = c.g WHERE over AND s + 3600 <= length(t)",
    psg="SELECT grp.paper_id, grp.g, k, is_table, heading_path, ids, p0, p1, rtrim(CASE WHEN over THEN substr(t, s,"
    " 3600) ELSE t END) AS txt, CASE WHEN NOT is_table THEN coalesce(lag(tail) OVER (PARTITION BY grp.paper_id,"
    " is_table, heading_path, k ORDER BY grp.g), '') ELSE '' END AS overlap0, row_number() OVER (PARTITION BY"
    " grp.paper_id ORDER BY grp.g, k) - 1 AS idx FROM grp JOIN cuts USING (paper_id, g) JOIN tail USING"
    " (paper_id, g)",
    psg2="SELECT * REPLACE (first_value(overlap0) OVER (PARTITION BY paper_id, g ORDER BY k) AS overlap0), sha256("
    "'{\"element_ids\":' || to_json(ids) || ',\"heading_path\":' || to_json(heading_path) || ',\"page_range\":['"
    " || p0 || ',' || p1 || '],\"text\":' || to_json(txt) || '}') AS h FROM psg",
)
CHUNK_COLUMNS = (
    f"SELECT 'passage-' || substr(h, 1, 16) || '-' || lpad(CAST(idx AS VARCHAR), 4, '0') AS id, paper_id, idx AS"
    f" paragraph_index, h AS content_hash, p0 AS page_number, txt AS original_text, {o.heading_type('heading_path')}"
    f" AS passage_type, array_to_string(ids, ',') AS element_ids, coalesce(heading_path[1], '') AS section,"
    f" CAST({o.tokens_n('txt')} AS BIGINT) AS token_count FROM psg2"
)


def chunks(c: Corpus):
    return ck.chunk_documents(headed(c), tables_of(c))


@query("chunk_documents", o.sql(CHUNK_COLUMNS, "elements", recursive=True, **CHUNKS))
def chunk_documents(c: Corpus):
    return chunks(c).select(
        "id", "paper_id", "paragraph_index", "content_hash", "page_number", "original_text", "passage_type",
        F.array_join("element_ids", ",").alias("element_ids"), "section", "token_count",
    )


@query(
    "overlap_provenance",
    o.sql("SELECT paper_id, idx AS paragraph_index, overlap0 AS overlap FROM psg2", "elements",
          recursive=True, **CHUNKS),
)
def overlap_provenance(c: Corpus):
    ids = F.coalesce(F.array_join("overlap_element_ids", ","), F.lit(""))
    return chunks(c).select("paper_id", "paragraph_index", ids.alias("overlap"))


@query(
    "table_passages",
    o.sql(
        "SELECT id, CASE WHEN element_index % 2 = 0 THEN 't-' || id ELSE '' END AS table_id, "
        f"CASE WHEN element_index % 2 = 0 THEN {TABLE_TEXT} ELSE text END AS text FROM elements WHERE element_type ="
        " 'table' AND text <> ''", "elements",
    ),
)
def table_passages(c: Corpus):
    rows = ck.table_passages(headed(c), tables_of(c), 10**6)
    return rows.select("id", "table_id", F.explode("pieces.text").alias("text")).withColumn(
        "text", tx.normalize_ws(F.col("text"))
    )


@query("split_table_rows")
def split_table_rows(c: Corpus):
    """Every table element as a stored table, packed; equality with brute force is in the tests."""
    rows = ck.table_passages(headed(c), tables_of(c, every=True), MAX_TOKENS)
    return rows.filter("table_id <> ''").select("table_id", F.posexplode("pieces").alias("n", "piece")).select(
        "table_id", "n", "piece.row_start", "piece.row_end", F.length("piece.text").alias("chars")
    )


@query("split_single_row")
def split_single_row(c: Corpus):
    """Tables of one long row: every line of every document under a short header."""
    cells = F.array(F.array(F.lit("System"), F.lit("Recall")), F.array(tx.normalize_ws(F.col("line")), F.lit("x")))
    rows = c.lines.select(
        "doc_id", "pos", sp.table_pieces(F.lit("Cap"), cells, F.lit(1), MAX_TOKENS).alias("pieces")
    )
    return rows.select("doc_id", "pos", F.posexplode("pieces").alias("n", "piece")).select(
        "doc_id", "pos", "n", "piece.split_index", "piece.split_count", "piece.text"
    )


@query("split_oversize_text")
def split_oversize_text(c: Corpus):
    """Whole documents, cut to 900 tokens by characters where they are longer."""
    over = tx.count_tokens(F.col("text")) > 900
    text = tx.normalize_ws(F.col("text"))
    pieces = F.coalesce(sp.text_pieces(F.when(over, text), 900), F.array(text))
    return c.documents.select("doc_id", F.posexplode(pieces).alias("n", "piece")).select(
        "doc_id", "n", tx.count_tokens(F.col("piece")).alias("tokens"), F.sha2("piece", 256).alias("digest")
    )


@query(
    "passage_identity",
    o.sql(
        "SELECT id, sha256('{\"element_ids\":[' || to_json(id) || '],\"heading_path\":' || to_json(heading_path) ||"
        " ',\"page_range\":[' || page_number || ',' || page_number || '],\"text\":' || to_json(original_text) || '}')"
        " AS content_hash FROM passages", "passages",
    ),
)
def passage_identity(c: Corpus):
    pages = F.array("page_number", "page_number")
    digest = ck.content_hash(F.array("id"), F.col("heading_path"), pages, F.col("original_text"))
    return c.passages.select("id", digest.alias("content_hash"))


@query(
    "renumber_passages",
    o.sql(
        "SELECT id, row_number() OVER (PARTITION BY paper_id ORDER BY page_number, paragraph_index) - 1 AS"
        " paragraph_index FROM passages", "passages",
    ),
)
def renumber_passages(c: Corpus):
    numbered = number_rows(
        c.passages.withColumnRenamed("paragraph_index", "_at"), ["paper_id"], "page_number", [F.col("_at")],
        "paragraph_index",
    )
    return numbered.select("id", "paragraph_index")
