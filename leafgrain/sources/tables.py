"""Typed scans, registration of files, and writers of parse outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrain.functions import meta
from leafgrain.functions import text as tx
from leafgrain.schemas import (
    CORE_METADATA_FIELDS, MAX_FILE_BYTES, TABLE_SCHEMAS,
)


def load_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Declared-schema scans of stored tables, one folder each (no inference)."""
    return {
        name: spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root}/{name}")
        for name in names or TABLE_SCHEMAS
    }


def save_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write a table, partitioned by space where it has one.

    Rows are spread by (space, paper) before the write: a hot space becomes many
    files instead of one task, and files stay sorted by paper for pruning.
    """
    columns = df.columns
    if "space_id" not in columns or name == "spaces":
        df.write.mode(mode).parquet(f"{root}/{name}")
        return
    keys = ["space_id"] + (["paper_id"] if "paper_id" in columns else ["id"])
    (
        df.repartition(*keys).sortWithinPartitions(*keys).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").partitionBy("space_id")
        .parquet(f"{root}/{name}")
    )


def read_files(spark: SparkSession, path: str, space_id: str) -> DataFrame:
    """Files of a folder as rows to register."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file_id"), F.lit(space_id).alias("space_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"), "content",
        F.col("length").alias("size"), F.col("modificationTime").alias("arrived"),
    )


def register_documents(
    files: DataFrame, existing: DataFrame, max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """Assign every file a paper: equal content in a space is the same paper.

    ``files``: file_id, space_id, filename, content, arrived. The first file of a
    content owns the new paper; both firsts and known papers are found by
    map-side combined minima, so many copies of one content cost one row. A file
    over ``max_bytes`` keeps its row with the status ``rejected``; where the
    listing has a ``size``, that is tested before the content is read.
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    fits = F.coalesce(size, F.lit(0)) <= max_bytes
    columns = ["file_id", "space_id", "filename", "arrived"]
    hashed = files.filter(fits).select(*columns, F.sha2("content", 256).alias("file_hash"))
    rejected = files.filter(~fits).select(*columns)
    keys = ["space_id", "file_hash"]
    firsts = hashed.groupBy(*keys).agg(
        F.min_by("file_id", F.struct("arrived", "file_id")).alias("_first")
    )
    known = existing.groupBy(*keys).agg(F.min("id").alias("_known"))
    owners = firsts.join(known, keys, "left")
    title = meta.filename_title(F.col("filename"))
    is_new = F.col("_known").isNull() & (F.col("file_id") == F.col("_first"))
    registered = hashed.join(owners, keys).select(
        "file_id", *keys,
        F.coalesce("_known", F.concat(F.lit("paper-"), F.col("_first").cast("string")))
        .alias("paper_id"),
        is_new.alias("is_new"), (~is_new).alias("reparse"),
        F.when(is_new, title).otherwise("").alias("title"),
        F.when(is_new & (title != ""), "filename.fallback").otherwise("").alias("title_source"),
        F.when(is_new & (title != ""), 0.1).otherwise(0.0).alias("title_confidence"),
        F.lit("registered").alias("status"),
    )
    kinds = dict(registered.dtypes)
    blank = {"is_new": F.lit(False), "reparse": F.lit(False), "title": F.lit(""), "title_source": F.lit(""),
             "title_confidence": F.lit(0.0), "status": F.lit("rejected")}
    return registered.unionByName(rejected.select(*[
        F.col(c) if c in ("file_id", "space_id") else blank.get(c, F.lit(None)).cast(kinds[c]).alias(c)
        for c in registered.columns
    ]))


def ingest_status(
    files: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_files: int | None = None
) -> DataFrame:
    """Outcome of each uploaded file (batch_id, file_id, filename, size).

    ``max_files`` is a limit of the upload channel; without it a batch may have any number of files.
    """
    sizes = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_files"))
    error = (
        F.when(F.lit(max_files is not None) & (F.col("_files") > (max_files or 0)), f"Batch upload accepts at most {max_files} files.")
        .when(~F.lower("filename").endswith(".pdf"), "Only PDF files are accepted")
        .when(
            F.col("size") > max_bytes,
            f"PDF file is too large. Maximum allowed size is {max_bytes} bytes.",
        )
        .otherwise("")
    )
    return files.join(sizes, "batch_id").select(
        "batch_id", "file_id", "filename",
        F.when(error == "", "success").otherwise("failed").alias("status"), error.alias("error"),
    )


def ingest_report(
    files: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_files: int | None = None
) -> DataFrame:
    """Totals of each upload batch."""
    return ingest_status(files, max_bytes, max_files).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def json_list(value: Column) -> Column:
    """Tolerant JSON array of strings: bad input is empty, items trimmed, blanks dropped."""
    decoded = F.from_json(F.when(value.rlike(r"^\s*\["), value), "array<string>")
    kept = F.filter(F.transform(decoded, tx.strip), lambda v: v != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def json_object(value: Column) -> Column:
    """Tolerant JSON object of strings: bad input is an empty map."""
    decoded = F.from_json(F.when(value.rlike(r"^\s*\{"), value), "map<string,string>")
    return F.coalesce(decoded, F.create_map().cast("map<string,string>"))


def decode_json_columns(df: DataFrame, lists: list[str], objects: list[str]) -> DataFrame:
    decoded = {name: json_list(F.col(name)) for name in lists}
    decoded.update({name: json_object(F.col(name)) for name in objects})
    return df.withColumns(decoded)


def replace_parse_outputs(
    old: dict[str, DataFrame], new: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """Swap in a new parse of some papers.

    ``new`` holds passages, document_elements, document_tables and document_assets
    of the parsed papers, with source ids and their ``parse_run_id``. Earlier
    generated rows of those papers go; hand-made passages (no run) and other
    papers stay. New ids are namespaced by the run, also inside references.
    """
    parsed = new["document_elements"].select("paper_id", "space_id").distinct()
    result = {}
    for name, fresh in new.items():
        kept = old[name]
        generated = kept.filter("parse_run_id is not null")
        others = generated.join(parsed, ["paper_id", "space_id"], "left_anti")
        kept = others.unionByName(kept.filter("parse_run_id is null"))
        run = F.col("parse_run_id")
        fresh = fresh.withColumn("id", tx.storage_id(run, F.col("id")))
        if "element_ids" in fresh.columns:
            fresh = fresh.withColumn(
                "element_ids", F.transform("element_ids", lambda e: tx.storage_id(run, e))
            )
        if "element_id" in fresh.columns:
            renamed = F.when(F.col("element_id").isNotNull(), tx.storage_id(run, F.col("element_id")))
            fresh = fresh.withColumn("element_id", renamed)
        result[name] = kept.unionByName(fresh, allowMissingColumns=True)
    return result


def delete_parse_run(tables: dict[str, DataFrame], run_ids: DataFrame) -> dict[str, DataFrame]:
    """Drop everything some parse runs produced, index rows included; run rows stay.

    ``run_ids``: parse_run_id. Tables without that column lose the rows of the
    deleted passages.
    """
    gone = tables["passages"].join(run_ids, "parse_run_id", "left_semi").select(
        F.col("id").alias("passage_id")
    )
    result = {}
    for name, df in tables.items():
        if "parse_run_id" in df.columns:
            # null-safe: rows without a run never match and stay
            result[name] = df.join(run_ids, "parse_run_id", "left_anti")
        else:
            result[name] = df.join(gone, "passage_id", "left_anti")
    return result


def cascade_delete_papers(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove papers (paper_id, space_id) and every dependent row."""
    doomed = ids.select("paper_id", "space_id")
    return {
        name: df.join(doomed.withColumnRenamed("paper_id", "id"), ["id", "space_id"], "left_anti")
        if name == "papers" else df.join(doomed, ["paper_id", "space_id"], "left_anti")
        for name, df in tables.items()
    }


def backfill_card_origin(cards: DataFrame) -> DataFrame:
    edited = F.coalesce(F.col("user_edited"), F.lit(False))
    return cards.withColumn("created_by", F.when(edited, "user").otherwise("heuristic"))


def backfill_metadata_provenance(papers: DataFrame) -> DataFrame:
    """Treat every filled core field without provenance as a user edit."""
    filled = F.filter(
        F.array(*[
            F.when(F.trim(F.col(f).cast("string")) != "", F.lit(f)) for f in CORE_METADATA_FIELDS
        ]),
        lambda f: f.isNotNull(),
    )
    fields = F.array_sort(F.array_union("user_edited_fields", filled))

    def complete(column: str, default) -> Column:
        missing = F.filter(filled, lambda f: ~F.map_contains_key(F.col(column), f))
        entries = F.transform(missing, lambda f: F.struct(f, F.lit(default)))
        return F.map_concat(F.col(column), F.map_from_entries(entries))

    touched = F.size(fields) > 0
    return papers.withColumns({
        "user_edited_fields": fields,
        "metadata_sources": complete("metadata_sources", "user.edit"),
        "metadata_confidence": complete("metadata_confidence", 1.0),
        "metadata_status": F.when(touched, "user_edited").otherwise(F.col("metadata_status")),
    })


def backfill_embedding_status(
    papers: DataFrame, passages: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """Parsed papers are completed when any passage has a vector, else pending."""
    embedded = (
        passages.join(embeddings.select(F.col("passage_id").alias("id")), "id", "left_semi")
        .select(F.col("paper_id").alias("id"), "space_id").distinct()
        .withColumn("_embedded", F.lit(True))
    )
    status = F.when(F.col("_embedded"), "completed").otherwise("pending")
    return (
        papers.join(embedded, ["id", "space_id"], "left")
        .withColumn(
            "embedding_status",
            F.when(F.col("parse_status") == "parsed", status).otherwise(F.col("embedding_status")),
        )
        .drop("_embedded")
    )
