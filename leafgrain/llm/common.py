"""What the operators of this folder share: folders, document columns, folds and Arrow output."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ``labels`` that a classifier may learn from; more are thinned by a hash of the document id.
FIT_ROWS = 20_000
#: Documents of this remainder are held out of every fit.
FOLDS, HELD_OUT = 4, 2


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting (tests): it gets a folder of its own. Every run writes below a
    folder named after the application, so one delete clears it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "leafgrain-local")
    return f"{base.rstrip('/')}/leafgrain-{spark.sparkContext.applicationId}"


def posix_path(folder: str) -> str:
    """A shared folder as a mounted path, for files that are memory-mapped."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {parts.scheme}://")
    return parts.path


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: work is done once and lineage ends here."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(remainder(doc_id) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out.

    The rows are those with the smallest hash of their id, so the choice does not depend on partitions. Their ids are
    the only thing broadcast, and ``rows`` bounds them.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .select("doc_id", F.col(label).cast("double").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_label")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of one hold about ``limit`` bytes; one text is never cut."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = text_bytes(batch.column(column))
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
