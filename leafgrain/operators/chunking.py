"""Heading-aware chunking of elements into token-bounded passages.

A paper is one uploaded file, capped at registration (``MAX_FILE_BYTES``), so its
elements are a bounded array. They are brought together by one shuffle; packing,
joining, overlap and numbering all happen on that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrain.functions import meta
from leafgrain.functions import text as tx
from leafgrain.operators import splitting as sp
from leafgrain.operators.layout import searchable_body
from leafgrain.schemas import MAX_TOKENS, OVERLAP_TOKENS, SOFT_TOKENS

KEYS = ["paper_id", "space_id"]
PIECES = (
    "array<struct<text:string,row_start:int,row_end:int,split_index:int,split_count:int>>"
)


def header_row_count(cells: Column, header_rows: Column) -> Column:
    default = F.when(F.size(cells) > 0, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.coalesce(header_rows, default), F.size(cells)))


def render_table(caption: Column, cells: Column) -> Column:
    """Caption and rows as lines of ``a | b``."""
    rows = F.transform(
        cells, lambda row: F.array_join(F.transform(row, lambda c: tx.normalize_ws(c)), " | ")
    )
    parts = F.concat(F.array(tx.normalize_ws(F.coalesce(caption, F.lit("")))), rows)
    return F.array_join(F.filter(parts, lambda line: line != ""), "\n")


def _body_rows(elements: DataFrame, max_tokens: int) -> DataFrame:
    text = tx.normalize_ws(F.col("text"))
    rows = searchable_body(elements).withColumn("text", text).withColumns({
        "words": tx.word_count(F.col("text")), "chars": F.length("text"),
    })
    over = tx.tokens_of(F.col("words"), F.col("chars")) > max_tokens
    cut = sp.text_pieces(F.when(over, F.col("text")), max_tokens)
    pieces = F.transform(
        cut,
        lambda t, i: F.struct(
            t.alias("text"), F.lit(None).cast("int").alias("row_start"),
            F.lit(None).cast("int").alias("row_end"), i.alias("split_index"),
            F.lit(None).cast("int").alias("split_count"),
        ),
    )
    return rows.select(
        *KEYS, "element_index", F.lit(False).alias("is_table"), "id", "text", "words", "chars",
        "page_number", "bbox", "heading_path", pieces.cast(PIECES).alias("pieces"),
        F.lit("").alias("table_id"),
    )


def table_passages(elements: DataFrame, tables: DataFrame, max_tokens: int) -> DataFrame:
    """Table elements with the texts of their passages (column ``pieces``).

    A table that fits is one passage; otherwise its rows are packed. A table
    element without a stored table falls back to its own text.
    """
    grids = tables.select(
        "paper_id", F.col("element_id").alias("id"), F.col("id").alias("table_id"), "caption",
        "cells", "header_rows", F.col("page_number").alias("_page"), F.col("bbox").alias("_bbox"),
    )
    rows = elements.filter("element_type = 'table'").join(grids, ["paper_id", "id"], "left")
    own = F.when(F.col("table_id").isNull(), tx.normalize_ws(F.col("text"))).otherwise(
        render_table(F.col("caption"), F.col("cells"))
    )
    rows = rows.withColumn("text", own).filter("text <> ''")
    over = tx.count_tokens(F.col("text")) > max_tokens
    split_text = sp.text_pieces(F.when(over & F.col("table_id").isNull(), F.col("text")), max_tokens)
    split_grid = sp.table_pieces(
        F.col("caption"), F.when(over & F.col("table_id").isNotNull(), F.col("cells")),
        header_row_count(F.col("cells"), F.col("header_rows")), max_tokens,
    )
    nothing = F.lit(None).cast("int")

    def piece(text: Column, index: Column, count: Column) -> Column:
        return F.struct(
            text.alias("text"), nothing.alias("row_start"), nothing.alias("row_end"),
            index.alias("split_index"), count.alias("split_count"),
        )

    whole = F.array(piece(tx.normalize_ws(F.col("text")), nothing, nothing)).cast(PIECES)
    cut = F.transform(
        F.col("_cut"), lambda t, i: piece(t, i, F.size(F.col("_cut")))
    ).cast(PIECES)
    staged = rows.withColumns({"_cut": split_text, "_grid": split_grid.cast(PIECES)})
    pieces = F.coalesce(cut, F.col("_grid"), whole)
    return staged.select(
        *KEYS, "element_index", F.lit(True).alias("is_table"), "id", F.lit("").alias("text"),
        F.lit(0).alias("words"), F.lit(0).alias("chars"),
        F.coalesce(F.when(F.col("_page") > 0, F.col("_page")), F.col("page_number")).alias("page_number"),
        F.coalesce("_bbox", "bbox").alias("bbox"), "heading_path", pieces.alias("pieces"),
        F.coalesce("table_id", F.lit("")).alias("table_id"),
    )


def group_starts(rows: Column, limit: int) -> Column:
    """Start positions of the packed groups of a paper's ordered rows.

    Token totals of joined texts are sums (words add; characters add plus one
    per join), so the fold carries two integers and never joins strings. Tables
    stand alone and close the group before them; so does a change of heading.
    """
    start = F.struct(
        F.lit(0).alias("words"), F.lit(0).alias("chars"),
        F.lit(None).cast("array<string>").alias("path"), F.array().cast("array<int>").alias("starts"),
        F.lit(0).alias("pos"),
    )

    def step(state: Column, row: Column) -> Column:
        words, chars = state["words"] + row["words"], state["chars"] + row["chars"] + 1
        stays = (
            ~row["is_table"] & F.coalesce(state["path"] == row["heading_path"], F.lit(False))
            & (tx.tokens_of(words, chars) <= limit)
        )
        return F.struct(
            F.when(stays, words).otherwise(row["words"]).cast("int").alias("words"),
            F.when(stays, chars).otherwise(row["chars"]).cast("int").alias("chars"),
            F.when(~row["is_table"], row["heading_path"]).alias("path"),
            F.when(stays, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(state["pos"]))).alias("starts"),
            (state["pos"] + 1).alias("pos"),
        )

    return F.aggregate(rows, start, step, lambda s: s["starts"])


def overlap_ids(rows: Column, overlap_tokens: int) -> Column:
    """Trailing element ids of a group, up to the overlap, at least one."""
    start = F.struct(
        F.array().cast("array<string>").alias("ids"), F.lit(0).alias("total"), F.lit(False).alias("done")
    )

    def step(state: Column, row: Column) -> Column:
        size = tx.tokens_of(row["words"], row["chars"])
        stop = state["done"] | ((F.size(state["ids"]) > 0) & (state["total"] + size > overlap_tokens))
        total = F.when(stop, state["total"]).otherwise(state["total"] + size).cast("int")
        return F.struct(
            F.when(stop, state["ids"]).otherwise(F.concat(state["ids"], F.array(row["id"]))).alias("ids"),
            total.alias("total"), (stop | (total >= overlap_tokens)).alias("done"),
        )

    return F.reverse(F.aggregate(F.reverse(rows), start, step, lambda s: s["ids"]))


def pack_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Groups of a paper's rows in order: (keys, group_no, rows)."""
    fields = F.struct(
        "element_index", "is_table", "id", "text", "words", "chars", "page_number", "bbox",
        "heading_path", "pieces", "table_id",
    )
    papers = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    papers = papers.withColumn("starts", group_starts(F.col("rows"), limit))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("rows")))
    groups = F.zip_with(
        "starts", ends, lambda a, b: F.slice(F.col("rows"), a + 1, b - a)
    )
    return papers.select(*KEYS, F.posexplode(groups).alias("group_no", "rows"))


def pack_elements(elements: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Hard-limit packing only: group number of each body element."""
    groups = pack_rows(_body_rows(elements, limit), limit)
    return groups.select(*KEYS, "group_no", F.explode("rows.id").alias("id"))


def content_hash(element_ids: Column, headings: Column, pages: Column, text: Column) -> Column:
    payload = F.struct(
        element_ids.alias("element_ids"),
        F.transform(headings, lambda h: tx.normalize_ws(h)).alias("heading_path"),
        pages.alias("page_range"), text.alias("text"),
    )
    return F.sha2(tx.canonical_json(payload), 256)


def passage_id(digest: Column, index: Column) -> Column:
    return F.concat(F.lit("passage-"), F.substring(digest, 1, 16), F.format_string("-%04d", index))


def chunk_documents(
    elements: DataFrame, tables: DataFrame, max_tokens: int = MAX_TOKENS,
    soft_tokens: int = SOFT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Passages of every paper, in emission order (``paragraph_index``)."""
    if min(max_tokens, soft_tokens) <= 0 or overlap_tokens < 0:
        raise ValueError("token limits must be positive and the overlap not negative")
    rows = _body_rows(elements, max_tokens).unionByName(table_passages(elements, tables, max_tokens))
    groups = pack_rows(rows, min(soft_tokens, max_tokens))

    first = F.element_at("rows", 1)
    boxes = F.filter(F.col("rows.bbox"), lambda b: b.isNotNull())
    union = F.when(
        F.size(boxes) > 0,
        F.array(
            F.array_min(F.transform(boxes, lambda b: b[0])), F.array_min(F.transform(boxes, lambda b: b[1])),
            F.array_max(F.transform(boxes, lambda b: b[2])), F.array_max(F.transform(boxes, lambda b: b[3])),
        ),
    )
    groups = groups.select(
        *KEYS, "group_no", first["is_table"].alias("is_table"), first["heading_path"].alias("heading_path"),
        first["table_id"].alias("table_id"), first["pieces"].alias("pieces"),
        F.col("rows.id").alias("ids"), F.col("rows.page_number").alias("pages"), union.alias("bbox"),
        F.array_join("rows.text", " ").alias("text"),
        overlap_ids(F.col("rows"), overlap_tokens).alias("_tail"),
    )
    # Both windows are satisfied by the partitioning of the grouping above.
    same_heading = W.partitionBy(*KEYS, "is_table", "heading_path").orderBy("group_no")
    before = W.partitionBy(*KEYS).orderBy("group_no").rowsBetween(W.unboundedPreceding, -1)
    single = F.array(F.struct(
        F.col("text"), F.lit(None).cast("int").alias("row_start"),
        F.lit(None).cast("int").alias("row_end"), F.lit(None).cast("int").alias("split_index"),
        F.lit(None).cast("int").alias("split_count"),
    )).cast(PIECES)
    overlap = F.lag("_tail").over(same_heading) if overlap_tokens > 0 else F.lit(None)
    placed = groups.withColumns({
        "overlap_element_ids": F.when(~F.col("is_table"), overlap.cast("array<string>")),
        "pieces": F.coalesce("pieces", single), "is_split": F.col("pieces").isNotNull() & ~F.col("is_table"),
    })
    placed = placed.withColumn("_offset", F.coalesce(F.sum(F.size("pieces")).over(before), F.lit(0)))
    passages = placed.select(
        *KEYS, "is_table", "is_split", "heading_path", "table_id", "ids", "pages", "bbox",
        "overlap_element_ids", "_offset", F.posexplode("pieces").alias("_n", "piece"),
    )
    text = F.col("piece.text")
    positive = F.filter("pages", lambda n: n > 0)
    pages = F.when(F.size(positive) > 0, F.array(F.array_min(positive), F.array_max(positive))).otherwise(
        F.array(F.lit(0), F.lit(0))
    )
    index = (F.col("_offset") + F.col("_n")).cast("int")
    staged = passages.select(
        *KEYS, "heading_path", "table_id", "ids", "bbox", "overlap_element_ids",
        tx.normalize_ws(text).alias("original_text"), pages.alias("page_range"),
        index.alias("paragraph_index"), "piece.row_start", "piece.row_end", "piece.split_index",
        "piece.split_count",
        F.when(F.col("is_split"), "element_text")
        .when(F.col("piece.row_start").isNotNull(), "table_rows").otherwise("").alias("split_source"),
    )
    staged = staged.withColumn(
        "content_hash",
        content_hash(F.col("ids"), F.col("heading_path"), F.col("page_range"), F.col("original_text")),
    )
    return staged.select(
        passage_id(F.col("content_hash"), F.col("paragraph_index")).alias("id"), *KEYS,
        F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("")).alias("section"),
        F.col("page_range")[0].cast("int").alias("page_number"), "paragraph_index", "original_text",
        F.lit(1.0).alias("parse_confidence"),
        meta.heading_passage_type(F.col("heading_path")).alias("passage_type"),
        F.col("ids").alias("element_ids"), "heading_path", "bbox",
        tx.count_tokens(F.col("original_text")).alias("token_count"),
        F.length("original_text").alias("char_count"), "content_hash", "table_id",
        "overlap_element_ids", "split_source", "split_index", "split_count", "row_start", "row_end",
    )
