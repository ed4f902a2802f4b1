"""Space scoping, filtered listings, edits of papers and spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.functions import meta
from leafgrain.operators.keyed import top_k
from leafgrain.schemas import CORE_METADATA_FIELDS, RELATION_VALUES

EDITABLE = (
    "title", "authors", "year", "doi", "arxiv_id", "pubmed_id", "venue", "abstract", "citation",
    "relation_to_idea",
)


def scope_to_space(
    df: DataFrame, spaces: DataFrame, active: DataFrame, requested: str | None = None
) -> DataFrame:
    """Rows of the active space, empty when it is not active or another one is requested.

    ``active``: app-state rows (key, value) with key ``active_space``.
    """
    current = active.filter("key = 'active_space'").select(F.col("value").alias("id"))
    allowed = spaces.filter("status = 'active'").join(current, "id", "left_semi").select(
        F.col("id").alias("space_id")
    )
    if requested is not None:
        allowed = allowed.filter(F.col("space_id") == requested)
        df = df.filter(F.col("space_id") == requested)
    return df.join(allowed, "space_id", "left_semi")


def list_spaces(spaces: DataFrame) -> DataFrame:
    return spaces.filter("status <> 'deleted'").orderBy(F.desc("updated_at"), "id")


def list_papers(papers: DataFrame, space_id: str | None = None) -> DataFrame:
    rows = papers if space_id is None else papers.filter(F.col("space_id") == space_id)
    return rows.orderBy(F.desc("imported_at"), "id")


def list_elements(
    elements: DataFrame, limit: int = 100, element_type: str | None = None, page: int | None = None
) -> DataFrame:
    """First elements of each paper in reading order (limit 1..1000)."""
    rows = elements
    if element_type is not None:
        rows = rows.filter(F.col("element_type") == element_type)
    if page is not None:
        rows = rows.filter(F.col("page_number") == page)
    return top_k(rows, ["paper_id", "space_id"], [F.asc("element_index")], min(1000, max(1, limit)), "place")


def list_tables(tables: DataFrame) -> DataFrame:
    return tables.orderBy("paper_id", "page_number", "table_index")


def list_passages(passages: DataFrame) -> DataFrame:
    return passages.orderBy("paper_id", "page_number", "paragraph_index")


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("paper_id", F.desc("started_at"), F.desc("id"))


def apply_paper_edits(papers: DataFrame, edits: DataFrame, by_user: bool = True) -> DataFrame:
    """Overwrite fields with non-null edits (id, space_id, fields).

    User edits of core fields also record source, confidence and the frozen
    field list; agent edits do not. An edit with an unknown relation is ignored.
    """
    known = [f for f in EDITABLE if f in edits.columns]
    if "relation_to_idea" in known:
        relation = F.col("relation_to_idea")
        edits = edits.filter(relation.isNull() | relation.isin(*RELATION_VALUES))
    new = edits.select("id", "space_id", *[F.col(f).alias(f"_{f}") for f in known])
    joined = papers.join(new, ["id", "space_id"], "left")
    updates: dict[str, Column] = {f: F.coalesce(f"_{f}", f) for f in known}
    if by_user:
        core = [f for f in CORE_METADATA_FIELDS if f in known]

        def entries(value) -> Column:
            return F.array(*[
                F.when(F.col(f"_{n}").isNotNull(), F.struct(F.lit(n).alias("key"), F.lit(value).alias("value")))
                for n in core
            ])

        fields = F.filter(
            F.array(*[F.when(F.col(f"_{f}").isNotNull(), F.lit(f)) for f in core]), lambda f: f.isNotNull()
        )
        touched = F.size(fields) > 0
        updates |= {
            "metadata_sources": meta.put_many(F.col("metadata_sources"), entries("user.edit")),
            "metadata_confidence": meta.put_many(F.col("metadata_confidence"), entries(1.0)),
            "user_edited_fields": F.when(
                touched, F.array_sort(F.array_union("user_edited_fields", fields))
            ).otherwise(F.col("user_edited_fields")),
            "metadata_status": F.when(touched, "user_edited").otherwise(F.col("metadata_status")),
        }
    return joined.withColumns(updates).drop(*[f"_{f}" for f in known])


def apply_space_status(
    spaces: DataFrame, state: DataFrame, changes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Archive or soft-delete spaces (id, status); deleted ones cannot change again.

    An active-space pointer to a changed space is cleared.
    """
    valid = changes.filter(F.col("status").isin("archived", "deleted")).select(
        "id", F.col("status").alias("_next")
    )
    alive = spaces.filter("status <> 'deleted'").select("id")
    valid = valid.join(alive, "id", "left_semi")
    updated = spaces.join(valid, "id", "left").withColumns({
        "status": F.coalesce("_next", "status"),
        "updated_at": F.when(F.col("_next").isNotNull(), now).otherwise(F.col("updated_at")),
    }).drop("_next")
    gone = valid.select(F.lit("active_space").alias("key"), F.col("id").alias("value"))
    return updated, state.join(gone, ["key", "value"], "left_anti")
