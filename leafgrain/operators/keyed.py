"""Per-key ordering helpers that hold up when one key owns much of the data.

A plain ``row_number() over (partition by key)`` sends a whole key to one task.
These helpers split a key into blocks (a column such as the page number that
is non-decreasing in the order), work inside the blocks, and carry only one
small row per block across the key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

Keys = Sequence[str]


def top_k(df: DataFrame, keys: Keys, order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """Best ``k`` rows of each key.

    The rank filter lets the optimizer keep at most ``k`` rows of a key per
    task before the shuffle, so a hot key costs no more than a cold one.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """First row of each key as a map-side combined aggregate (ascending order)."""
    row = F.struct(*[c for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left join on keys of which any may be null; the right side's keys are dropped."""
    named = right.select(*[F.col(k).alias(f"_k{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    match = [left[k].eqNullSafe(named[f"_k{right.columns.index(k)}"]) for k in keys]
    return left.join(named, match, "left").drop(*[f"_k{right.columns.index(k)}" for k in keys])


def number_rows(
    df: DataFrame, keys: Keys, block: str, order: Sequence[Column], out: str
) -> DataFrame:
    """0-based position inside each key, computed block by block; a null block comes first."""
    inside = W.partitionBy(*keys, block).orderBy(*order)
    local = df.withColumn("_pos", F.row_number().over(inside) - 1)
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        join_null_safe(local, offsets, [*keys, block])
        .withColumn(out, (F.col("_pos") + F.col("_offset")).cast("int"))
        .drop("_pos", "_offset")
    )


def carry_last(
    df: DataFrame, keys: Keys, block: str, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row of the key, block by block."""
    marked = df.withColumn("_value", value)
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    last_of_block = F.max_by(
        F.col("_value"), F.when(F.col("_value").isNotNull(), F.struct(*order))
    )
    carried = (
        marked.groupBy(*keys, block)
        .agg(last_of_block.alias("_end"))
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
        .drop("_end")
    )
    return (
        join_null_safe(local, carried, [*keys, block])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_value", "_local", "_carry")
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative result.

    Uses the folder the session names in ``spark.checkpoint.dir`` (shared by the
    cluster, so it outlives executors).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(work_dir(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def store_rows(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once under the shared checkpoint folder and read back.

    Unlike a checkpoint's, their size is then known, so Spark itself decides whether a join broadcasts them.
    """
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def work_dir(spark, name: str) -> str:
    """Folder for written intermediate tables, under the shared checkpoint folder.

    Only a local master, where driver and executor are one process, may leave ``spark.checkpoint.dir`` unset. All
    folders of an application lie under one that bears its id, so they can be removed together.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/leafgrain-local"
    return f"{base.rstrip('/')}/leafgrain-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
