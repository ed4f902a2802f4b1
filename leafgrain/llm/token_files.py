"""Flat files of token ids with 64-bit document offsets, memory-mapped when read."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrain.llm.common import posix_path, small_batches, texts_of
from leafgrain.llm.tokens import word_encoder

END_ID = 1
NO_ID = np.iinfo(np.int64).min


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_bytes: int = 2) -> DataFrame:
    """Writes all documents in ascending doc_id order and returns the manifest.

    A range of ids becomes three flat little-endian files: ``<n>.tok`` (unsigned ids of ``id_bytes`` bytes, the
    documents back to back, each with ``end_id``), ``<n>.off`` (signed 64-bit offsets in ids, one more than documents)
    and ``<n>.doc`` (64-bit document ids). The manifest has (part, docs, tokens, base): ``base``, the ids in all
    earlier files, is a prefix sum, so a document's place in the whole corpus is base plus offset.

    Null ids come first (written as the least 64-bit number); rows of equal id follow by text; null text is the empty
    text. Files are written under another name and renamed, and depend on the range alone, so a task that runs again
    replaces its own. A text larger than the memory of one task is the only limit. ``folder`` must be mounted on
    driver and executors. An empty table gives an empty manifest.
    """
    place = posix_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), np.uint32(end_id).tobytes()
        part, made = TaskContext.get().partitionId(), None
        os.makedirs(place, exist_ok=True)
        names = [os.path.join(place, f"{part:05d}.{x}") for x in ("tok", "off", "doc")]
        drafts = [f"{n}.{uuid.uuid4().hex}" for n in names]
        for batch in small_batches(batches, "text"):
            if made is None:
                files, made, tokens = [open(d, "wb") for d in drafts], 0, 0
                files[1].write(np.int64(0).tobytes())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1)))):
                values = np.frombuffer(ids + end, "<u4")
                if id_bytes == 2 and values.max() > 0xFFFF:
                    raise ValueError("an id needs more than two bytes")
                files[0].write(values.astype(f"<u{id_bytes}").tobytes())
                tokens, made = tokens + len(values), made + 1
                files[1].write(np.int64(tokens).tobytes())
                files[2].write(np.int64(NO_ID if doc_id is None else doc_id).tobytes())
        if made is not None:
            for f, draft, name in zip(files, drafts, names):
                f.close()
                os.replace(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int64()), pa.array([tokens], pa.int64())], ["part", "docs", "tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(write, "part int, docs bigint, tokens bigint")
    written.write.parquet(f"{folder}/written")
    files = docs.sparkSession.read.schema(written.schema).parquet(f"{folder}/written")
    # One small row for each file.
    files = files.withColumn("base", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens"))
    files.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(files.schema).parquet(f"{folder}/manifest")


def open_part(folder: str, part: int, id_bytes: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of one file, memory-mapped."""
    name = os.path.join(posix_path(folder), f"{part:05d}")
    return tuple(np.memmap(f"{name}.{x}", kind, "r") for x, kind in (("tok", f"<u{id_bytes}"), ("off", "<i8"), ("doc", "<i8")))


def read_token_files(spark: SparkSession, folder: str, id_bytes: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of every document in the files.

    A task maps one file at a time and touches one document's ids at a time.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(*(c.to_pylist() for c in batch.columns)):
                ids, offsets, docs = open_part(folder, part, id_bytes)
                for at in range(0, len(docs), 2000):
                    ends = offsets[at:at + 2001]
                    each = [np.asarray(ids[a:b], "<u4") for a, b in zip(ends[:-1], ends[1:])]
                    columns = [
                        pa.array([None if d == NO_ID else d for d in docs[at:at + 2000].tolist()], pa.int64()), pa.array(ends[:-1] + base, pa.int64()),
                        pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([x.astype("<i4") for x in each], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.schema("part int, docs bigint, tokens bigint, base bigint").parquet(f"{folder}/manifest")
    many = spark.sparkContext.defaultParallelism * 4
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return files.select("part", "base").repartition(many, "part").mapInArrow(read, schema)
