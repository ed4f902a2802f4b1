"""Text, markdown, HTML and parser payloads to ordered elements and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.functions import text as tx

# Markdown shapes.
HEADING_PATTERN = r"^(#{1,6})\s+(.+?)\s*$"
TABLE_SEPARATOR_PATTERN = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
TABLE_LINE = r"[ \t]*\|(?:.*\|)?[ \t]*"
# Character references decoded in table cells.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
# Payload item kinds.
HEADING_KINDS = ("heading", "title", "section_header", "section-heading")


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, normalized."""
    parts = F.split(tx.strip(text), r"\n\s*\n")
    return F.filter(F.transform(parts, tx.dehyphenate), lambda p: p != "")


def element_id(page: Column, index: Column) -> Column:
    return F.format_string("p%04d-e%04d", page.cast("int"), index.cast("int"))


def text_to_elements(docs: DataFrame) -> DataFrame:
    """Paragraph elements of plain-text documents (paper_id, text)."""
    rows = docs.select("paper_id", F.posexplode(paragraphs(F.col("text"))).alias("element_index", "text"))
    return rows.select(
        element_id(F.lit(1), F.col("element_index")).alias("id"), "paper_id", "element_index",
        F.lit("paragraph").alias("element_type"), "text", F.lit(1).alias("page_number"),
    )


def markdown_blocks(text: Column) -> Column:
    """Blank-line blocks; runs of table lines are blocks of their own.

    Blank lines are put around table runs with two regex passes over the row, so
    no line is exploded, windowed or shuffled.
    """
    opened = F.regexp_replace(text, rf"(?m)^(?!{TABLE_LINE}$)(.*)\n(?={TABLE_LINE}$)", "$1\n\n")
    closed = F.regexp_replace(opened, rf"(?m)^({TABLE_LINE})\n(?!{TABLE_LINE}$)", "$1\n\n")
    blocks = F.transform(F.split(closed, r"\n\s*\n"), tx.strip)
    return F.filter(blocks, lambda b: b != "")


def table_rows(block: Column) -> Column:
    """Cell matrix of the pipe lines of a block, separator rows removed."""
    rows = F.transform(tx.lines(block), tx.strip)
    rows = F.filter(
        rows, lambda r: r.rlike(r"^\|.*\|") & ~r.rlike(TABLE_SEPARATOR_PATTERN)
    )
    inner = F.transform(rows, lambda r: F.regexp_replace(r, r"^\|+|\|+$", ""))
    return F.transform(inner, lambda r: F.transform(F.split(r, r"\|"), tx.strip))


def render_cells(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, " | ")), "\n")


def markdown_to_elements(docs: DataFrame) -> DataFrame:
    """Headings, tables and paragraphs of markdown documents (paper_id, page_number, text)."""
    block = F.col("block")
    second = F.get(tx.lines(block), F.lit(1))
    is_table = F.coalesce(tx.strip(second).rlike(TABLE_SEPARATOR_PATTERN), F.lit(False))
    is_heading = block.rlike(HEADING_PATTERN) & ~block.contains("\n")
    kind = F.when(is_table, "table").when(is_heading, "heading").otherwise("paragraph")
    text = (
        F.when(is_table, render_cells(table_rows(block)))
        .when(is_heading, F.regexp_extract(block, HEADING_PATTERN, 2))
        .otherwise(tx.normalize_ws(block))
    )
    return docs.select(
        "paper_id", "page_number",
        F.posexplode(markdown_blocks(F.col("text"))).alias("element_index", "block"),
    ).select(
        element_id(F.col("page_number"), F.col("element_index")).alias("id"), "paper_id",
        "page_number", "element_index", kind.alias("element_type"), text.alias("text"),
        F.when(is_table, table_rows(block)).alias("cells"),
    )


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_table_cells(html: Column) -> Column:
    """Cell matrix of the table rows of a page; rows without any text are dropped."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = F.transform(
        rows,
        lambda row: F.transform(
            F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)),
            lambda cell: tx.normalize_ws(
                decode_entities(F.regexp_replace(cell, r"(?s)<[^>]*>", ""))
            ),
        ),
    )
    return F.filter(cells, lambda row: F.exists(row, lambda cell: cell != ""))


def payload_pages(payloads: DataFrame) -> DataFrame:
    """One row per page of parser payloads (paper_id, payload), whatever their shape.

    Pages come from ``pages``, ``items.pages`` or ``data``; else one markdown page.
    """
    doc = F.try_parse_json("payload")
    listed = F.coalesce(*[
        F.try_variant_get(doc, path, "array<variant>") for path in ("$.pages", "$.items.pages", "$.data")
    ])
    whole = F.coalesce(
        F.try_variant_get(doc, "$.markdown", "string"), F.try_variant_get(doc, "$.text", "string")
    )
    pages = payloads.select("paper_id", F.posexplode_outer(listed).alias("n", "page"), whole.alias("whole"))
    page = F.col("page")
    number = F.coalesce(*[
        F.try_variant_get(page, path, "int") for path in ("$.page", "$.page_number", "$.pageNumber")
    ], F.coalesce(F.col("n") + 1, F.lit(1)))
    markdown = F.coalesce(*[
        F.try_variant_get(page, path, "string") for path in ("$.markdown", "$.md", "$.text")
    ], F.when(page.isNull(), F.col("whole")), F.lit(""))
    return pages.filter("page is not null or whole is not null").select(
        "paper_id", F.coalesce("n", F.lit(0)).alias("page_index"), number.alias("page_number"),
        markdown.alias("markdown"),
        F.try_variant_get(page, "$.items", "array<variant>").alias("items"),
    )


def payload_pages_to_items(payloads: DataFrame) -> DataFrame:
    """Items of each payload page; a page without items yields its markdown blocks."""
    pages = payload_pages(payloads)
    item = F.col("item")
    raw = F.lower(F.coalesce(
        F.try_variant_get(item, "$.type", "string"), F.try_variant_get(item, "$.item_type", "string"),
        F.lit(""),
    ))
    kind = (
        F.when(raw.isin(*HEADING_KINDS), "heading").when(raw == "table", "table")
        .when(raw.isin("image", "figure"), "figure").otherwise("paragraph")
    )
    text = F.coalesce(*[
        F.try_variant_get(item, path, "string") for path in ("$.value", "$.text", "$.md", "$.markdown")
    ], F.lit(""))
    heading = F.regexp_extract(text, HEADING_PATTERN, 2)
    text = F.when(heading != "", heading).otherwise(tx.normalize_ws(text))
    listed = pages.filter(F.size("items") > 0).select(
        "paper_id", "page_index", "page_number", F.posexplode("items").alias("item_index", "item")
    ).select(
        "paper_id", "page_index", "page_number", "item_index", kind.alias("element_type"),
        text.alias("text"),
    ).filter("text <> '' or element_type in ('table', 'figure')")
    plain = pages.filter("items is null or size(items) = 0").select(
        "paper_id", "page_index", "page_number", F.col("markdown").alias("text")
    )
    blocks = markdown_to_elements(plain.withColumn("paper_id", F.struct("paper_id", "page_index")))
    written = blocks.select(
        "paper_id.paper_id", "paper_id.page_index", "page_number",
        F.col("element_index").alias("item_index"), "element_type", "text",
    )
    return listed.unionByName(written)


def cells_to_grid(cells: DataFrame) -> DataFrame:
    """Positioned cells (table_id, seq, row, col, text) to dense matrices, gaps empty.

    The later cell wins a position. A matrix is one table's rows by columns.
    """
    placed = cells.filter("row is not null and col is not null").groupBy("table_id", "row", "col").agg(
        F.max_by(tx.normalize_ws(F.col("text")), "seq").alias("text")
    )
    grid = placed.groupBy("table_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws(":", "row", "col"), "text"))
        ).alias("at"),
        F.max("row").alias("rows"), F.max("col").alias("cols"),
    )
    cell = F.col("at")
    matrix = F.transform(
        F.sequence(F.lit(0), F.col("rows")),
        lambda r: F.transform(
            F.sequence(F.lit(0), F.col("cols")),
            lambda c: F.coalesce(F.try_element_at(cell, F.concat_ws(":", r, c)), F.lit("")),
        ),
    )
    return grid.select("table_id", matrix.alias("cells"))


def resolve_captions(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Caption text of tables and figures.

    ``items``: paper_id, item_index, captions (array of texts or ``#/collection/index``
    references). ``targets``: paper_id, collection, index, text.
    """
    part = F.col("part")
    pattern = r"^#/([^/]+)/([0-9]+)"
    parts = items.select(
        "paper_id", "item_index", F.posexplode_outer("captions").alias("pos", "part")
    ).select(
        "paper_id", "item_index", "pos", "part",
        F.regexp_extract(part, pattern, 1).alias("collection"),
        F.regexp_extract(part, pattern, 2).try_cast("int").alias("index"),
    )
    found = targets.select("paper_id", "collection", "index", F.col("text").alias("_text"))
    is_ref = F.coalesce(part.startswith("#/"), F.lit(False))
    text = F.when(is_ref & F.col("_text").isNotNull(), F.col("_text")).otherwise(part)
    resolved = parts.join(found, ["paper_id", "collection", "index"], "left").withColumn(
        "text", tx.normalize_ws(F.coalesce(text, F.lit("")))
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]
    )
    return resolved.groupBy("paper_id", "item_index").agg(
        F.array_join(F.filter(ordered, lambda t: t != ""), " ").alias("caption")
    )


def toc_headings(toc: DataFrame, elements: DataFrame) -> DataFrame:
    """Headings to add for contents entries that are not headings on their page yet.

    ``toc``: paper_id, page_number, toc_index, title, item_page.
    """
    known = elements.filter("element_type = 'heading'").select(
        "paper_id", "page_number", F.lower("text").alias("_title")
    )
    wanted = toc.withColumn("title", tx.strip(F.col("title"))).filter("title <> ''").withColumn(
        "_title", F.lower("title")
    )
    return wanted.join(known, ["paper_id", "page_number", "_title"], "left_anti").select(
        "paper_id", "toc_index", F.col("title").alias("text"),
        F.coalesce("item_page", "page_number").alias("page_number"),
        F.lit("heading").alias("element_type"),
    )
