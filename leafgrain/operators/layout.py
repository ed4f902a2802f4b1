"""Layout items, heading paths, page furniture, page signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrain.functions import meta, numeric
from leafgrain.functions import text as tx
from leafgrain.operators.keyed import carry_last, first_per_key, number_rows
from leafgrain.schemas import SEARCHABLE_ELEMENT_TYPES
from leafgrain.sources.markup import HEADING_PATTERN, element_id, render_cells, table_rows

# Rows of a paper are numbered and carried in blocks of this many positions.
BLOCK = 4096
#: Order of a paper's elements; text and level decide between equal indexes.
READING_ORDER = ("element_index", "text", "level")

# Label fragments and the element type they mean, first match wins.
LABEL_TYPES = (
    (("page_header",), "page_header"),
    (("page_footer",), "page_footer"),
    (("title",), "title"),
    (("heading", "header", "section"), "heading"),
    (("table",), "table"),
    (("picture", "figure", "image"), "figure"),
    (("caption",), "caption"),
    (("formula", "equation"), "equation"),
    (("code",), "code"),
    (("list",), "list"),
)
# Types of a flat content list.
CONTENT_TYPES = {
    "title": "title", "text": "paragraph", "paragraph": "paragraph", "table": "table",
    "image": "figure", "figure": "figure", "equation": "equation", "formula": "equation",
}
# Page margins (points), text thresholds.
HEADER_BOTTOM, FOOTER_TOP = 110, 700
SECTION_NAMES = ("abstract", "introduction", "method", "methods", "results")


def label_type(label: Column) -> Column:
    kind = F.lit("paragraph")
    for fragments, name in reversed(LABEL_TYPES):
        kind = F.when(meta.contains_any(label, fragments), F.lit(name)).otherwise(kind)
    return kind


def content_type(raw: Column, text_level: Column, title_seen: Column) -> Column:
    """Type of a content-list item; a text level makes it a title (once) or heading."""
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    plain = F.coalesce(F.try_element_at(table, F.lower(raw)), F.lit("paragraph"))
    levelled = F.when((text_level <= 1) & ~title_seen, "title").otherwise("heading")
    return F.when(text_level.isNotNull(), levelled).otherwise(plain)


def layout_items_to_elements(items: DataFrame) -> DataFrame:
    """Typed elements with ids from layout items.

    ``items``: paper_id, item_index, label, text, caption, cells, page_number.
    Empty rows other than headings, tables and figures are dropped before
    numbering.
    """
    kind = label_type(F.lower("label"))
    own = tx.normalize_ws(F.coalesce("text", F.lit("")))
    caption = tx.normalize_ws(F.coalesce("caption", F.lit("")))
    shown = F.when(caption != "", caption).otherwise(own)
    cells = F.col("cells")
    text = (
        F.when(
            kind == "table",
            F.when(shown != "", shown)
            .when(F.size(cells) > 0, tx.strip(render_cells(cells)))
            .otherwise("Table"),
        )
        .when(kind == "figure", F.when(shown != "", shown).otherwise("Figure"))
        .otherwise(own)
    )
    kept = (
        items.withColumns({"element_type": kind, "_text": text, "_caption": caption})
        .filter("_text <> '' or element_type in ('heading', 'table', 'figure')")
        .withColumn("_block", F.floor(F.col("item_index") / BLOCK))
    )
    numbered = number_rows(kept, ["paper_id"], "_block", [F.col("item_index")], "element_index")
    return numbered.withColumn(
        "id", element_id(F.col("page_number"), F.col("element_index"))
    ).select(
        "id", "paper_id", "element_index", "element_type", F.col("_text").alias("text"),
        "page_number", "level", "cells", F.col("_caption").alias("caption"), "item_index",
    )


def layout_tables_assets(elements: DataFrame) -> DataFrame:
    """Table and figure rows of elements with their own per-paper indexes."""
    rows = elements.filter("element_type in ('table', 'figure')").withColumn(
        "_block", F.floor(F.col("element_index") / BLOCK)
    )
    numbered = number_rows(
        rows, ["paper_id", "element_type"], "_block", [F.col("element_index")], "row_index"
    )
    prefix = F.when(F.col("element_type") == "table", "table").otherwise("asset")
    return numbered.select(
        F.format_string("%s-%04d", prefix, F.col("row_index")).alias("id"), "paper_id",
        F.col("id").alias("element_id"), F.col("element_type").alias("kind"), "row_index",
        "page_number", F.col("caption"), "cells",
    )


def heading_paths(headings: DataFrame, missing_level: str = "root") -> DataFrame:
    """Path in force after the n-th heading of a paper: (paper_id, heading_no, path).

    ``headings``: paper_id, element_index, text, level. A level-n heading keeps the first n-1 entries of the current
    path; padding is dropped at once. A heading without level starts a new path (``root``) or goes one deeper
    (``deeper``); one with empty text changes nothing.

    The i-th heading lies at depth ``min(depth before + 1, level)``, so at ``i + min(0, level_j - j for j <= i)``: a
    running minimum. A path can only grow by one entry at a time, hence its entry at depth d is the last heading of that
    depth. All windows read a paper's headings as a stream over one shuffle; nothing is gathered but the paths themselves.
    """
    pushed = F.col("text").isNull() | (F.col("text") != "")
    level = F.greatest(F.col("level"), F.lit(1))
    level = level if missing_level == "root" else F.when(F.col("level").isNotNull(), level)
    order = W.partitionBy("paper_id").orderBy(*READING_ORDER)
    running = order.rowsBetween(W.unboundedPreceding, 0)
    rows = headings.select("paper_id", *READING_ORDER).withColumns({
        "heading_no": F.row_number().over(order), "_n": F.count_if(pushed).over(running),
    }).withColumn("_depth", F.col("_n") + F.least(F.lit(0), F.min(F.when(pushed, level - F.col("_n"))).over(running)))

    # One row per entry of each path: as many as the result has.
    entries = rows.filter("_depth > 0").withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("_depth").cast("int"))))
    own = F.when(pushed & (F.col("_at") == F.col("_depth")), F.struct("text"))
    same_depth = W.partitionBy("paper_id", "_at").orderBy("heading_no").rowsBetween(W.unboundedPreceding, 0)
    entry = F.struct("_at", F.last(own, ignorenulls=True).over(same_depth)["text"].alias("text"))
    return entries.withColumn("_entry", entry).groupBy("paper_id", "heading_no").agg(
        F.transform(F.array_sort(F.collect_list("_entry")), lambda e: e["text"]).alias("path")
    )


def heading_path_stack(elements: DataFrame, missing_level: str = "root") -> DataFrame:
    """Attach the heading path in force at each element (a heading sees the one before it)."""
    heading = F.coalesce(F.col("element_type") == "heading", F.lit(False))
    so_far = W.partitionBy("paper_id").orderBy(*READING_ORDER).rowsBetween(W.unboundedPreceding, 0)
    numbered = elements.withColumn("_no", F.count_if(heading).over(so_far) - heading.cast("int"))
    paths = heading_paths(elements.filter(heading), missing_level).select(
        F.col("paper_id").alias("_paper"), F.col("heading_no").cast("bigint").alias("_at"), F.col("path").alias("heading_path")
    )
    found = (F.col("_paper").eqNullSafe(F.col("paper_id"))) & (F.col("_at") == F.col("_no"))
    return numbered.drop("heading_path").join(paths, found, "left").drop("_paper", "_at", "_no").withColumn(
        "heading_path", F.coalesce("heading_path", F.array().cast("array<string>"))
    )


def flat_heading_path(elements: DataFrame) -> DataFrame:
    """One-heading variant: the last heading, none on headings and titles."""
    own = F.when(F.col("element_type") == "heading", F.col("text"))
    blocked = elements.withColumn("_block", F.floor(F.col("element_index") / BLOCK))
    carried = carry_last(blocked, ["paper_id"], "_block", [F.col("element_index")], own, "_heading")
    outside = F.col("element_type").isin("heading", "title") | F.col("_heading").isNull()
    return carried.withColumn(
        "heading_path",
        F.when(outside, F.array().cast("array<string>")).otherwise(F.array("_heading")),
    ).drop("_heading", "_block")


def sticky_section(blocks: DataFrame) -> DataFrame:
    """Section of each block: set by short header blocks, which are removed.

    ``blocks``: paper_id, page_number, y, x, block_index, text. Pages are worked on
    separately; one section per page is carried over.
    """
    header = F.when(F.length(tx.strip(F.col("text"))) < 60, meta.detect_section_header(F.col("text")))
    order = [F.col("page_number"), F.col("y"), F.col("x"), F.col("block_index")]
    marked = blocks.withColumn("_header", header)
    carried = carry_last(marked, ["paper_id"], "page_number", order, F.col("_header"), "_section")
    return (
        carried.filter("_header is null")
        .withColumn("section", F.coalesce("_section", F.lit("introduction")))
        .drop("_header", "_section")
    )


def drop_margins_and_fragments(blocks: DataFrame) -> DataFrame:
    """Drop short margin blocks of busy pages, blank blocks and fragments.

    ``blocks``: paper_id, page_number, y0, y1, page_height, text.
    """
    text = tx.strip(F.col("text"))
    filled = blocks.filter(text != "")
    counts = filled.groupBy("paper_id", "page_number").agg(F.count(F.lit(1)).alias("_blocks"))
    margin = (F.col("y0") < F.col("page_height") * 0.07) | (F.col("y1") > F.col("page_height") * 0.93)
    drop = (F.col("_blocks") > 3) & margin & (F.length(text) < 150)
    clean = tx.dehyphenate(text)
    return (
        filled.join(counts, ["paper_id", "page_number"])
        .filter(~drop & (F.length(clean) >= 30))
        .withColumn("text", clean).drop("_blocks")
    )


def norm_repeated(text: Column) -> Column:
    return F.lower(tx.normalize_ws(text))


def repeated_key(text: Column) -> Column:
    """Digest of the comparison form, null when blank: long blocks meet by 64 characters."""
    return F.sha2(F.nullif(norm_repeated(text), F.lit("")), 256)


def clean_markdown(block: Column) -> Column:
    stripped = tx.strip(block)
    heading = F.regexp_extract(stripped, HEADING_PATTERN, 2)
    is_heading = stripped.startswith("#") & ~stripped.contains("\n") & (heading != "")
    return F.when(is_heading, tx.strip(heading)).otherwise(stripped)


def text_chrome(pages: DataFrame) -> DataFrame:
    """Blocks of text pages with repeated headers and footers marked.

    ``pages``: paper_id, page_number, text. The first and last block or line of a
    page is furniture when it opens (closes) at least two pages of the paper.
    Each page contributes at most four digests; texts are never compared or shuffled
    by content.
    """
    split = F.filter(F.split("text", r"\n[^\S\n]*(?:\n[^\S\n]*)+"), lambda b: tx.strip(b) != "")
    # Exploding a one-element array makes the split a stored column, computed once a row.
    paged = pages.select("paper_id", "page_number", F.explode(F.array(split)).alias("blocks"))
    paged = paged.filter(F.size("blocks") > 0)
    first, last = F.element_at("blocks", 1), F.element_at("blocks", -1)
    head_line = F.substring_index(first, "\n", 1)
    tail_line = F.substring_index(last, "\n", -1)
    keyed = paged.withColumns({
        "hb": repeated_key(clean_markdown(first)), "hl": repeated_key(clean_markdown(head_line)),
        "fl": repeated_key(clean_markdown(tail_line)),
    })
    alone = F.size("blocks") == 1
    keyed = keyed.withColumn(
        "fb", F.when(alone, F.col("hb")).otherwise(repeated_key(clean_markdown(last)))
    )
    roles = F.array(
        F.struct(F.lit("header").alias("role"), F.array_distinct(F.array("hb", "hl")).alias("texts")),
        F.struct(F.lit("footer").alias("role"), F.array_distinct(F.array("fb", "fl")).alias("texts")),
    )
    repeated = (
        keyed.select("paper_id", "page_number", F.inline(roles))
        .select("paper_id", "page_number", "role", F.explode("texts").alias("norm"))
        .filter("norm is not null")
    )
    common = repeated.groupBy("paper_id", "role", "norm").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n >= 2").drop("n")
    flags = (
        repeated.join(common, ["paper_id", "role", "norm"])
        .groupBy("paper_id", "page_number")
        .agg(
            F.collect_set(F.when(F.col("role") == "header", F.col("norm"))).alias("headers"),
            F.collect_set(F.when(F.col("role") == "footer", F.col("norm"))).alias("footers"),
        )
    )
    marked = keyed.join(flags, ["paper_id", "page_number"], "left")
    none = F.array().cast("array<string>")
    headers, footers = F.coalesce("headers", none), F.coalesce("footers", none)

    # A repeated first or last line of a longer block becomes a block of its own.
    rest = F.substr(first, F.length(head_line) + 2)
    opened = F.when(
        first.contains("\n") & F.array_contains(headers, F.col("hl")),
        F.concat(F.array(head_line, rest), F.slice("blocks", F.lit(2), F.size("blocks"))),
    ).otherwise(F.col("blocks"))
    step = marked.select(
        "paper_id", "page_number", headers.alias("headers"), footers.alias("footers"), "fl",
        opened.alias("blocks"),
    )
    tail = F.substring_index(F.element_at("blocks", -1), "\n", -1)
    body = F.left(F.element_at("blocks", -1), F.length(F.element_at("blocks", -1)) - F.length(tail) - 1)
    closed = F.when(
        F.element_at("blocks", -1).contains("\n") & F.array_contains("footers", F.col("fl")),
        F.concat(F.slice("blocks", F.lit(1), F.size("blocks") - 1), F.array(body, tail)),
    ).otherwise(F.col("blocks"))
    shown = step.select(
        "paper_id", "page_number", "headers", "footers",
        F.filter(closed, lambda b: tx.strip(b) != "").alias("blocks"),
    )
    rows = shown.select(
        "paper_id", "page_number", "headers", "footers", F.size("blocks").alias("n"),
        F.posexplode("blocks").alias("block_index", "block"),
    ).withColumn("text", clean_markdown(F.col("block")))
    text, key = F.col("text"), repeated_key(F.col("text"))
    top = (F.col("block_index") == 0) & (F.size("headers") > 0)
    bottom = (F.col("block_index") == F.col("n") - 1) & (F.size("footers") > 0)
    kind = (
        F.when(top & F.array_contains("headers", key), "page_header")
        .when(bottom & F.array_contains("footers", key), "page_footer")
        .otherwise(markdown_type(F.col("block")))
    )
    return rows.select(
        "paper_id", "page_number", "block_index", kind.alias("element_type"), text.alias("text")
    )


def markdown_type(block: Column) -> Column:
    stripped = tx.strip(block)
    return (
        F.when(stripped.startswith("#") & ~stripped.contains("\n") & stripped.rlike(HEADING_PATTERN), "heading")
        .when(block.contains("|") & (F.size(table_rows(block)) > 0), "table")
        .otherwise("paragraph")
    )


def box_chrome(boxes: DataFrame) -> DataFrame:
    """Mark boxes whose margin text repeats in the paper (column ``repeated``).

    ``boxes``: paper_id, page_number, box_index, bbox, text.
    """
    box = F.col("bbox")
    keyed = boxes.withColumn("_norm", norm_repeated(clean_markdown(F.col("text"))))
    margin = (box[3] <= HEADER_BOTTOM) | (box[1] >= FOOTER_TOP)
    common = (
        keyed.filter(margin & (F.col("_norm") != "")).groupBy("paper_id", "_norm")
        .agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
        .select("paper_id", "_norm", F.lit(True).alias("repeated"))
    )
    return keyed.join(common, ["paper_id", "_norm"], "left").withColumn(
        "repeated", F.coalesce("repeated", F.lit(False))
    ).drop("_norm")


def classify_box_element(boxes: DataFrame) -> DataFrame:
    """Element type of layout boxes from class, text, position and repetition."""
    name = F.lower(F.translate("box_class", "_", "-"))
    text, box = F.col("text"), F.col("bbox")
    stripped_heading = text.rlike(HEADING_PATTERN) & ~text.contains("\n")
    kind = (
        F.when(name == "page-header", "page_header")
        .when(name == "page-footer", "page_footer")
        .when(F.col("repeated") & (box[3] <= HEADER_BOTTOM), "page_header")
        .when(F.col("repeated") & (box[1] >= FOOTER_TOP), "page_footer")
        .when(name.isin("section-header", "heading", "title") | stripped_heading, "heading")
        .when((name == "table") | (F.size(table_rows(text)) > 0), "table")
        .when(name.isin("image", "figure", "graphic"), "figure")
        .when(name.isin("list", "caption", "equation", "code", "reference"), name)
        .when(name == "text", "paragraph")
        .otherwise("unknown")
    )
    return boxes.withColumn("element_type", kind)


def promote_title(elements: DataFrame) -> DataFrame:
    """The first title-like paragraph of a paper becomes its title, unless one came before."""
    text = F.col("text")
    likely = (
        (F.col("element_type") == "paragraph") & (text != "") & ~text.contains("\n")
        & (tx.word_count(F.col("_plain")) <= 16) & ~F.lower(text).isin(*SECTION_NAMES)
    )
    plain = elements.select("paper_id", "element_index", "element_type", "text", tx.once(tx.normalize_ws(text)).alias("_plain"))
    first = first_per_key(
        plain.filter(likely | (F.col("element_type") == "title")).select(
            "paper_id", "element_index", "element_type"
        ),
        ["paper_id"], [F.col("element_index")],
    )
    chosen = first.filter("element_type = 'paragraph'").select(
        "paper_id", "element_index", F.lit(True).alias("_title")
    )
    return elements.join(chosen, ["paper_id", "element_index"], "left").withColumn(
        "element_type", F.when(F.col("_title"), "title").otherwise(F.col("element_type"))
    ).drop("_title")


def searchable_body(elements: DataFrame) -> DataFrame:
    """Body elements the chunker packs: searchable types, not blank, not references."""
    under_references = F.coalesce(
        F.exists("heading_path", lambda h: F.lower(tx.normalize_ws(h)) == "references"), F.lit(False)
    )
    return elements.filter(
        F.col("element_type").isin(*SEARCHABLE_ELEMENT_TYPES)
        & ~under_references & (tx.normalize_ws(F.col("text")) != "")
    )


def union_bbox(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around the elements of each key."""
    box = F.col("bbox")
    return elements.groupBy(*keys).agg(
        F.array(F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])).alias("bbox")
    )


def bbox_exclusion(blocks: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Drop text blocks at least half covered by a table box of their page."""
    boxes = tables.select("paper_id", "page_number", F.col("bbox").alias("_table"))
    covered = (
        (blocks["paper_id"] == boxes["paper_id"]) & (blocks["page_number"] == boxes["page_number"])
        & (numeric.bbox_overlap_ratio(blocks["bbox"], boxes["_table"]) >= share)
    )
    return blocks.join(boxes, covered, "left_anti")


def grid_rules(rules: DataFrame) -> DataFrame:
    """Horizontal and vertical rule counts per page (kind line or rect, corner points)."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    line, rect = F.col("kind") == "line", F.col("kind") == "rect"
    return rules.groupBy("paper_id", "page_number").agg(
        (F.count_if(line & (dy <= 1.5) & (dx >= 20)) + 2 * F.count_if(rect)).alias("h_lines"),
        (F.count_if(line & (dx <= 1.5) & (dy >= 20)) + 2 * F.count_if(rect)).alias("v_lines"),
    )


def two_column_pages(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with text side by side (paper_id, page_number).

    ``words``: x0, x1, page_width; ``blocks``: bbox, page_width. A left and a
    right block must share 20 points of height. Because only the existence of
    such a pair matters, the few blocks of a page are tested inside its row, up to
    the first hit; pairs never become rows.
    """
    keys = ["paper_id", "page_number"]
    middle, gap = F.col("page_width") / 2, F.col("page_width") * 0.025
    center = (F.col("x0") + F.col("x1")) / 2
    enough = words.groupBy(*keys).agg(
        F.count_if(center < middle - gap).alias("left"),
        F.count_if(center > middle + gap).alias("right"),
    ).filter("left >= 8 and right >= 8").select(*keys)
    box = F.col("bbox")
    side = F.when(box[2] <= middle - gap, "l").when(box[0] >= middle + gap, "r")
    spans = (
        blocks.join(enough, keys, "left_semi").withColumn("side", side).filter("side is not null")
        .filter(tx.strip(F.col("text")) != "")
        .groupBy(*keys)
        .agg(
            F.collect_set(F.when(F.col("side") == "l", F.struct(box[1].alias("a"), box[3].alias("b")))).alias("l"),
            F.collect_set(F.when(F.col("side") == "r", F.struct(box[1].alias("a"), box[3].alias("b")))).alias("r"),
        )
    )
    meets = F.exists(
        "l", lambda x: F.exists(
            "r", lambda y: F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"]) >= 20
        )
    )
    return spans.filter(meets).select(*keys)


def page_signals(
    pages: DataFrame, words: DataFrame, blocks: DataFrame, rules: DataFrame
) -> DataFrame:
    """Native text, table and column signals of each page.

    ``pages``: paper_id, page_number, chars, tables (found by a table finder).
    """
    keys = ["paper_id", "page_number"]
    counts = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"))
    columns = two_column_pages(words, blocks).withColumn("_two", F.lit(True))
    joined = (
        pages.join(counts, keys, "left").join(grid_rules(rules), keys, "left")
        .join(columns, keys, "left").na.fill(0, ["words", "h_lines", "v_lines"])
    )
    native = (F.col("chars") >= 20) | (F.col("words") >= 3)
    table = (F.col("words") >= 6) & (
        (F.col("tables") > 0) | ((F.col("h_lines") >= 3) & (F.col("v_lines") >= 3))
    )
    return joined.select(
        *keys, "chars", "words", "h_lines", "v_lines", native.alias("native"),
        (native & table).alias("has_table"),
        (native & F.coalesce("_two", F.lit(False))).alias("two_column"),
    )


def document_quality(signals: DataFrame) -> DataFrame:
    """Page counts, warnings, needs and score of each paper."""
    counts = signals.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("native").alias("native_text_pages"),
        F.count_if(~F.col("native")).alias("image_only_pages"),
        F.count_if("has_table").alias("table_pages"),
        F.count_if("two_column").alias("two_column_pages"),
    )
    coverage = F.col("native_text_pages") / F.col("page_count")
    layout = (F.col("table_pages") > 0) | (F.col("two_column_pages") > 0)
    warnings = F.filter(
        F.array(
            F.when(F.col("image_only_pages") > 0, "image_only_pages_detected"),
            F.when(F.col("table_pages") > 0, "tables_detected"),
            F.when(F.col("two_column_pages") > 0, "two_column_layout_detected"),
            F.when(F.col("native_text_pages") == 0, "no_native_text_detected"),
        ),
        lambda w: w.isNotNull(),
    )
    return counts.withColumns({
        "needs_ocr": (F.col("image_only_pages") > 0) | (coverage < 0.5),
        "needs_layout": layout,
        "quality_score": numeric.quality_score(F.col("page_count"), coverage, layout),
        "warnings": warnings,
    })
