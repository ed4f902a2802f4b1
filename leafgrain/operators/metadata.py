"""Bibliographic metadata: candidates with provenance, and their promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.functions import meta
from leafgrain.functions import text as tx
from leafgrain.operators.keyed import first_per_key
from leafgrain.schemas import CORE_METADATA_FIELDS

# A candidate row: paper_id, field, value (text), source, confidence, source_id.
LIST_SEPARATOR = ", "


def _candidate(field: str, value: Column, source: str, confidence, source_id: Column) -> list[Column]:
    level = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return [
        F.col("paper_id"), F.lit(field).alias("field"), value.alias("value"),
        F.lit(source).alias("source"), level.alias("confidence"), source_id.alias("source_id"),
    ]


def source_texts(passages: DataFrame, elements: DataFrame) -> DataFrame:
    """Passages, then elements, as one stream of texts in reading order.

    A text is a stored column: what reads it several times does not strip it several times.
    """
    first = passages.select(
        "paper_id", F.lit("passage").alias("kind"), F.col("id").alias("source_id"),
        tx.once(tx.strip(F.col("original_text"))).alias("text"),
        F.struct(
            F.lit(0).alias("part"), F.col("page_number").cast("long").alias("a"),
            F.col("paragraph_index").cast("long").alias("b"), F.col("id").alias("c"),
        ).alias("position"),
    )
    second = elements.select(
        "paper_id", F.lit("element").alias("kind"), F.col("id").alias("source_id"),
        tx.once(tx.strip(F.col("text"))).alias("text"),
        F.struct(
            F.lit(1).alias("part"), F.col("element_index").cast("long").alias("a"),
            F.lit(0).cast("long").alias("b"), F.col("id").alias("c"),
        ).alias("position"),
    )
    return first.unionByName(second)


def first_identifier(texts: DataFrame, field: str) -> DataFrame:
    """First DOI or arXiv id of each paper; only passages are named as source."""
    find, source = {
        "doi": (meta.first_doi, "regex.doi"), "arxiv_id": (meta.first_arxiv, "regex.arxiv"),
    }[field]
    hits = texts.withColumn("value", find(F.col("text"))).filter("value <> ''").drop("text")
    best = first_per_key(hits, ["paper_id"], [F.col("position")])
    named = F.when(F.col("kind") == "passage", F.col("source_id")).otherwise("")
    return best.select(*_candidate(field, F.col("value"), source, 0.98, named))


def first_identifiers(texts: DataFrame) -> DataFrame:
    """First DOI and first arXiv id of each paper, in one pass over the texts; only what is found is normalized."""
    written = texts.select(
        "paper_id", "kind", "source_id", "position", meta.doi_match(F.col("text")).alias("_doi"),
        meta.arxiv_match(F.col("text")).alias("_arxiv"),
    ).filter("_doi <> '' or _arxiv <> ''")
    found = written.select(
        "paper_id", "kind", "source_id", "position", meta.normalize_doi(F.col("_doi")).alias("doi"),
        meta.normalize_arxiv(F.col("_arxiv")).alias("arxiv_id"),
    ).filter("doi <> '' or arxiv_id <> ''")
    named = F.when(F.col("kind") == "passage", F.col("source_id")).otherwise("")

    def first(field: str, source: str) -> Column:
        hit = F.when(F.col(field) != "", F.col("position"))
        row = F.struct(
            F.lit(field).alias("field"), F.col(field).alias("value"), F.lit(source).alias("source"),
            F.lit(0.98).alias("confidence"), named.alias("source_id"),
        )
        return F.min_by(row, hit).alias(f"_{field}")

    best = found.groupBy("paper_id").agg(first("doi", "regex.doi"), first("arxiv_id", "regex.arxiv"))
    return best.select("paper_id", F.inline(F.array_compact(F.array("_doi", "_arxiv_id"))))


def first_title(elements: DataFrame) -> DataFrame:
    """First title element of each paper; the first two page numbers are preferred."""
    page = F.coalesce("page_number", F.lit(0))
    titles = elements.filter("element_type = 'title'").select(
        "paper_id", "id", page.alias("page"), F.coalesce("element_index", F.lit(0)).alias("index"),
        meta.clean_title(F.col("text")).alias("value"),
    ).filter("value <> ''")
    order = [~F.col("page").isin(0, 1), F.col("page"), F.col("index")]
    best = first_per_key(titles, ["paper_id"], order)
    return best.select(*_candidate("title", F.col("value"), "document.title", 0.75, F.col("id")))


def first_abstract(passages: DataFrame) -> DataFrame:
    """First passage of each paper labelled as its abstract."""
    labels = F.concat(
        F.array("section", "passage_type", F.array_join("heading_path", " ")), F.col("heading_path")
    )
    labelled = F.exists(labels, lambda v: F.lower(tx.normalize_ws(v)) == "abstract")
    rows = passages.filter(labelled).select(
        "paper_id", "id", "page_number", "paragraph_index",
        meta.clean_abstract(F.col("original_text")).alias("value"),
    ).filter("value <> ''")
    best = first_per_key(rows, ["paper_id"], [F.col("page_number"), F.col("paragraph_index"), F.col("id")])
    return best.select(*_candidate("abstract", F.col("value"), "document.abstract", 0.75, F.col("id")))


def filename_candidates(papers: DataFrame) -> DataFrame:
    titled = papers.select(F.col("id").alias("paper_id"), meta.filename_title(F.col("file_path")).alias("value"))
    return titled.filter("value <> ''").select(
        *_candidate("title", F.col("value"), "filename.fallback", 0.1, F.lit(""))
    )


def extract_metadata_candidates(
    passages: DataFrame, elements: DataFrame, papers: DataFrame
) -> DataFrame:
    """Deterministic candidates of all papers."""
    texts = source_texts(passages, elements)
    parts = [
        first_title(elements), first_identifiers(texts), first_abstract(passages),
        filename_candidates(papers),
    ]
    return reduce(DataFrame.unionByName, parts)


def ai_metadata_candidates(extractions: DataFrame) -> DataFrame:
    """Candidates of an extractor's output: one row per filled field.

    ``extractions``: paper_id, title, authors (array), year, doi, arxiv_id, venue,
    abstract, confidence.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    values = {
        "title": meta.clean_title(text("title")),
        "authors": F.array_join(tx.ordered_distinct(F.transform("authors", lambda a: tx.normalize_ws(a))), LIST_SEPARATOR),
        "year": meta.extract_year(text("year")).cast("string"),
        "doi": meta.normalize_doi(text("doi")),
        "arxiv_id": meta.normalize_arxiv(text("arxiv_id")),
        "venue": tx.normalize_ws(text("venue")),
        "abstract": meta.clean_abstract(text("abstract")),
    }
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in values.items()
    ])
    level = F.coalesce("confidence", F.lit(0.6))
    return extractions.select("paper_id", level.alias("confidence"), F.inline(fields)).filter(
        F.coalesce(F.trim("value"), F.lit("")) != ""
    ).select(
        "paper_id", "field", "value", F.lit("llm.metadata").alias("source"), "confidence",
        F.lit("").alias("source_id"),
    )


def _best(order: Column) -> Column:
    return F.max_by(F.struct("value", "source", "confidence", "source_id"), order)


def merge_metadata_candidates(*groups: DataFrame) -> DataFrame:
    """Highest source priority per paper and field; the earlier group wins ties."""
    parts = [g.withColumn("_group", F.lit(i)) for i, g in enumerate(groups)]
    merged = reduce(DataFrame.unionByName, parts).filter(F.trim("value") != "")
    order = F.struct(meta.source_priority(F.col("source")), -F.col("_group"))
    best = merged.groupBy("paper_id", "field").agg(_best(order).alias("_c"))
    return best.select("paper_id", "field", "_c.*")


def promote_metadata(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fill paper fields from candidates of strictly higher source priority.

    Fields a user edited are frozen; a filled field without a source counts as a
    user edit. One aggregation picks the best candidate of each field and turns
    them into columns.
    """
    priority = meta.source_priority(F.col("source"))
    filled = candidates.filter(F.trim("value") != "")
    wide = filled.groupBy("paper_id").agg(*[
        _best(F.when(F.col("field") == name, F.struct(priority))).alias(f"_{name}")
        for name in CORE_METADATA_FIELDS
    ])
    joined = papers.join(wide.withColumnRenamed("paper_id", "id"), "id", "left")
    takes, updates = {}, {}
    for name in CORE_METADATA_FIELDS:
        candidate = F.col(f"_{name}")
        present = F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) != ""
        source = F.coalesce(F.try_element_at("metadata_sources", F.lit(name)), F.lit(""))
        source = F.when(present & (source == ""), "user.edit").otherwise(source)
        take = (
            candidate.isNotNull() & ~F.array_contains("user_edited_fields", name)
            & (~present | (meta.source_priority(source) < meta.source_priority(candidate["source"])))
        )
        takes[name] = take
    marked = joined.withColumns({f"_take_{name}": take for name, take in takes.items()})

    def entries(field: str) -> Column:
        return F.array(*[
            F.when(F.col(f"_take_{n}"), F.struct(F.lit(n).alias("key"), F.col(f"_{n}.{field}").alias("value")))
            for n in CORE_METADATA_FIELDS
        ])

    for name in CORE_METADATA_FIELDS:
        kind = papers.schema[name].dataType
        updates[name] = F.when(F.col(f"_take_{name}"), F.col(f"_{name}.value").cast(kind)).otherwise(F.col(name))
    promoted = [F.when(F.col(f"_take_{name}"), F.lit(name)) for name in CORE_METADATA_FIELDS]
    staged = marked.select(
        *[c for c in papers.columns if c not in (*CORE_METADATA_FIELDS, "metadata_sources", "metadata_confidence", "metadata_status")],
        *[value.alias(name) for name, value in updates.items()],
        meta.put_many(F.col("metadata_sources"), entries("source")).alias("metadata_sources"),
        meta.put_many(F.col("metadata_confidence"), entries("confidence")).alias("metadata_confidence"),
        F.filter(F.array(*promoted), lambda f: f.isNotNull()).alias("promoted"),
    )
    return staged.withColumn(
        "metadata_status",
        meta.infer_metadata_status(F.col("metadata_sources"), F.col("user_edited_fields")),
    )


def metadata_from_parse(
    papers: DataFrame, passages: DataFrame, elements: DataFrame, runs: DataFrame
) -> DataFrame:
    """Promote from the outputs of given parse runs (paper_id, parse_run_id) only."""
    keys = ["paper_id", "parse_run_id"]
    mine = passages.join(runs, keys, "left_semi")
    parts = elements.join(runs, keys, "left_semi")
    scoped = papers.join(runs.select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi")
    return promote_metadata(scoped, extract_metadata_candidates(mine, parts, scoped))
