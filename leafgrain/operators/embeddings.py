"""Incremental embedding: plan, reuse, encode, store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.functions.numeric import format_embedding_text
from leafgrain.operators.keyed import number_rows
from leafgrain.schemas import EMBED_BATCH

Encoder = Callable[[list[str]], list[list[float]]]
#: Vectors that leave an encoding task at once, about.
WRITE_ROWS = 1024


def vector_row_key() -> Column:
    """Stable identity of a vector row (the value itself is not public)."""
    return F.xxhash64("passage_id", "provider", "model")


def latest_vector_by_hash(embeddings: DataFrame) -> DataFrame:
    """Newest vector of each content hash, as a map-side combined aggregate."""
    kept = embeddings.filter(F.trim("content_hash") != "")
    newest = F.max_by(
        F.struct("dimension", "embedding", "passage_id", "created_at"),
        F.struct("created_at", "passage_id"),
    )
    return (
        kept.groupBy("provider", "model", "content_hash")
        .agg(newest.alias("_v"))
        .select("provider", "model", "content_hash", "_v.*")
    )


def embedding_actions(passages: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """What to do with each passage: skip, reuse (with the vector) or embed."""
    mine = embeddings.filter((F.col("provider") == provider) & (F.col("model") == model))
    done = mine.select(F.col("passage_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    vectors = latest_vector_by_hash(mine).select(
        "content_hash", F.col("embedding").alias("_vector"), F.col("dimension").alias("_dimension"),
        F.col("passage_id").alias("reused_from"),
    )
    action = (
        F.when(F.col("_done"), "skip").when(F.col("_vector").isNotNull(), "reuse").otherwise("embed")
    )
    return (
        passages.join(done, "id", "left")
        .join(vectors, "content_hash", "left")
        .withColumn("action", action)
        .withColumn("embedding", F.when(F.col("action") == "reuse", F.col("_vector")))
        .withColumn("dimension", F.when(F.col("action") == "reuse", F.col("_dimension")))
        .withColumn("reused_from", F.when(F.col("action") == "reuse", F.col("reused_from")))
        .drop("_done", "_vector", "_dimension")
    )


def embedding_plan(
    passages: DataFrame, embeddings: DataFrame, provider: str, model: str,
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """What to do with each passage: skip, reuse (with the vector) or embed.

    Passages to embed get a batch number per parse run in reading order. A run
    is numbered page by page, so a long run does not land in one task.
    """
    planned = embedding_actions(passages, embeddings, provider, model)
    pending = planned.filter("action = 'embed'").select(
        "id", "parse_run_id", "page_number", "paragraph_index"
    )
    numbered = number_rows(
        pending, ["parse_run_id"], "page_number", [F.col("paragraph_index"), F.col("id")], "_n"
    ).select("id", F.floor(F.col("_n") / batch_size).cast("int").alias("batch"))
    return planned.join(numbered, "id", "left")


def apply_reuse(plan: DataFrame, provider: str, model: str, now: Column) -> DataFrame:
    """New vector rows copied from the newest vector of the same content."""
    return plan.filter("action = 'reuse'").select(
        F.col("id").alias("passage_id"), F.lit(provider).alias("provider"),
        F.lit(model).alias("model"), "dimension", "embedding", "content_hash",
        now.alias("created_at"),
    )


class VectorCountMismatch(ValueError):
    """The encoder returned another number of vectors than texts, or an empty one."""


def embed_passages(
    plan: DataFrame, encoder: Encoder, provider: str, model: str, now: Column,
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """Encode the passages a plan marks ``embed``, in Arrow batches on the workers.

    The batch numbers of a plan are not read: ``embedding_actions`` suffices. The encoder gets ``batch_size`` texts a
    call; vectors leave a task some ``WRITE_ROWS`` at a time.
    """
    texts = plan.filter("action = 'embed'").select(
        "id", "content_hash",
        format_embedding_text(F.col("original_text"), F.lit(model), "passage").alias("text"),
    )
    rows = max(1, WRITE_ROWS // batch_size) * batch_size

    def vectors_of(texts: list[str]) -> Iterator[np.ndarray]:
        for start in range(0, len(texts), batch_size):
            asked = texts[start : start + batch_size]
            vectors = encoder(asked)
            if len(vectors) != len(asked) or any(len(v) == 0 for v in vectors):
                raise VectorCountMismatch(f"encoder gave {len(vectors)} vectors for {len(asked)} passages")
            yield from (np.asarray(v, dtype=np.float32) for v in vectors)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), rows):
                part = frame.iloc[start : start + rows]
                vectors = list(vectors_of(part["text"].tolist()))
                yield pd.DataFrame({
                    "passage_id": part["id"].to_numpy(),
                    "dimension": [len(v) for v in vectors],
                    "embedding": vectors,
                    "content_hash": part["content_hash"].to_numpy(),
                })

    schema = "passage_id string, dimension int, embedding array<float>, content_hash string"
    return texts.mapInPandas(encode, schema).select(
        "passage_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        "dimension", "embedding", "content_hash", now.alias("created_at"),
    )


def hashing_encoder(dimension: int = 64) -> Encoder:
    """Deterministic bag-of-words encoder for tests and dry runs."""

    def encode(texts: list[str]) -> list[list[float]]:
        import zlib

        rows = []
        for text in texts:
            row = [0.0] * dimension
            for word in text.lower().split():
                row[zlib.crc32(word.encode()) % dimension] += 1.0
            norm = sum(v * v for v in row) ** 0.5 or 1.0
            rows.append([v / norm for v in row] if any(row) else [1.0] + row[1:])
        return rows

    return encode


def embedding_run_stats(plan: DataFrame, batch_size: int = EMBED_BATCH) -> DataFrame:
    """Counts of one plan per parse run."""
    embedded = F.count_if(F.col("action") == "embed")
    return plan.groupBy("parse_run_id").agg(
        F.count(F.lit(1)).alias("passage_count"),
        embedded.alias("embedded_count"),
        F.count_if(F.col("action") == "reuse").alias("reused_count"),
        F.count_if(F.col("action") == "skip").alias("skipped_count"),
        F.ceil(embedded / batch_size).cast("int").alias("batch_count"),
    )


def sync_vector_table(
    stored: DataFrame, incoming: DataFrame, deleted_passages: DataFrame
) -> DataFrame:
    """Upsert by (passage, provider, model), newest wins; drop deleted passages.

    Rows whose vector length is not the declared dimension are left out. Write
    the result partitioned by ``dimension``.
    """
    keys = ["passage_id", "provider", "model"]
    columns = ["dimension", "embedding", "created_at"]
    ranked = stored.select(*keys, *columns, F.lit(0).alias("_new")).unionByName(
        incoming.select(*keys, *columns, F.lit(1).alias("_new"))
    )
    valid = ranked.filter((F.size("embedding") == F.col("dimension")) & (F.col("dimension") > 0))
    newest = F.max_by(F.struct(*columns), F.struct("_new", "created_at"))
    return (
        valid.join(deleted_passages.select("passage_id"), "passage_id", "left_anti")
        .groupBy(*keys)
        .agg(newest.alias("_v"))
        .select(*keys, "_v.*")
    )
