"""Stored inverted lists of vectors, and search that opens the lists which can hold a hit.

Vectors of one provider, model and dimension share centres; a vector lies in the list of the nearest centre by angle,
in the space of its passage. Each list of a space knows its reach, the widest angle from the centre, so the best cosine
that it can hold is known before it is opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrain.operators import retrieval as rt
from leafgrain.operators.keyed import cut_lineage, top_k, work_dir

#: Vectors that centres are fitted on, at most (those with the smallest hash of their passage id), and lists of a model.
FIT_VECTORS, LISTS, ROUNDS = 16_384, 1024, 8
#: Lists that a query opens first.
PROBES = 8
#: What rounding may add to a cosine, of which hits keep six digits.
SLACK = 2e-6
MODEL = ["provider", "model", "dimension"]
KEYS = ["space_id", *MODEL, "list"]
IDENTITY = ["passage_id", "provider", "model"]
Centres = dict[tuple[str, str, int], np.ndarray]


@dataclass
class VectorIndex:
    """rows (passage_id, provider, model, space_id, created_at, embedding, angle, dimension, list) by dimension and list,
    and the centres (provider, model, dimension, list, centre)."""

    folder: str
    rows: DataFrame
    centres: Centres

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        found: dict = {}
        # At most FIT_VECTORS rows, as centres are fitted on no more vectors.
        for r in spark.read.parquet(f"{folder}/centres").orderBy("list").toLocalIterator():
            found.setdefault((r.provider, r.model, r.dimension), []).append(r.centre)
        rows = spark.read.parquet(f"{folder}/rows").filter("passage_id is not null")
        return cls(folder, rows, {k: np.array(v, float) for k, v in found.items()})

    def lists(self) -> DataFrame:
        """(keys, n, reach) of every list of every space."""
        return self.rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_centres(vectors: DataFrame, rows: int = FIT_VECTORS) -> Centres:
    """Spherical k-means for each provider, model and dimension, on a bounded sample; as many lists as the root of the
    vectors, at most ``LISTS`` and one for four sampled vectors."""
    counts = {tuple(r)[:3]: r[3] for r in vectors.groupBy(*MODEL).count().limit(rows).toLocalIterator()}
    sample = vectors.orderBy(F.xxhash64("passage_id"), "passage_id").select(*MODEL, "embedding").limit(rows)
    groups: dict = {}
    for r in sample.toLocalIterator():
        groups.setdefault((r.provider, r.model, r.dimension), []).append(r.embedding)
    out: Centres = {}
    for key, found in groups.items():
        x = unit(np.array(found, float))
        x = x[np.isfinite(x).all(1) & x.any(1)]
        k = max(1, min(LISTS, int(counts.get(key, len(x)) ** 0.5), len(x) // 4))
        if not len(x):
            continue
        centres = x[np.random.default_rng(3).choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            home = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, x)
            centres = np.where(sums.any(1, keepdims=True), unit(sums), centres)
        out[key] = centres
    return out


def angles(vectors: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    """Angle between each vector and each centre; 0 to the one list of a model without centres."""
    if centres is None:
        return np.zeros((len(vectors), 1))
    return np.arccos(np.clip(unit(vectors) @ centres.T, -1, 1))


def valid(vectors: DataFrame) -> DataFrame:
    """Vectors of the declared dimension; others are no vectors of the table."""
    return vectors.filter((F.size("embedding") == F.col("dimension")) & (F.col("dimension") > 0))


def assign(vectors: DataFrame, passages: DataFrame, centres: Centres) -> DataFrame:
    """Rows of the index: each vector with its space, its list and its angle from the list's centre."""
    homes = passages.select(F.col("id").alias("passage_id"), "space_id")
    rows = valid(vectors).join(homes, "passage_id").select(*IDENTITY, "space_id", "created_at", "embedding", "dimension")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, group in frame.groupby(MODEL, sort=False):
                known = centres.get((key[0], key[1], int(key[2])))
                found = angles(np.array(group["embedding"].tolist(), float), known)
                best = np.where(np.isfinite(found), found, np.pi).argmin(1)
                angle = found[np.arange(len(group)), best] if known is not None else np.full(len(group), np.pi)
                yield group.assign(angle=np.where(np.isfinite(angle), angle, np.pi), list=best.astype(np.int32))

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", angle double, list int"
    return rows.mapInPandas(place, schema)


def store(rows: DataFrame, folder: str) -> None:
    """Replaces the lists that ``rows`` has rows of, and no others. A hot list is spread over tasks and files."""
    (
        rows.repartitionByRange("dimension", "list", "space_id", "passage_id").sortWithinPartitions("dimension", "list", "space_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dimension", "list").parquet(f"{folder}/rows")
    )


def write_vector_index(embeddings: DataFrame, passages: DataFrame, folder: str, centres: Centres | None = None) -> VectorIndex:
    """Fits centres, deals the vectors into lists under ``folder`` and opens the index.

    Vectors that are not of their declared dimension, or whose passage is unknown, are left out. Zero vectors are
    stored but found by no query. An empty table gives an empty index.
    """
    spark = embeddings.sparkSession
    centres = fit_centres(valid(embeddings)) if centres is None else centres
    flat = [(*key, i, c.tolist()) for key, many in centres.items() for i, c in enumerate(many)]
    kinds = "provider string, model string, dimension int, list int, centre array<double>"
    spark.createDataFrame(flat, kinds).write.mode("overwrite").parquet(f"{folder}/centres")
    rows = assign(embeddings, passages, centres)
    rows = rows.unionByName(spark.createDataFrame([(0, -1)], "dimension int, list int"), allowMissingColumns=True)
    store(rows, folder)
    return VectorIndex.open(spark, folder)


def sync_vector_index(index: VectorIndex, incoming: DataFrame, passages: DataFrame, deleted: DataFrame) -> VectorIndex:
    """Upserts by (passage, provider, model), newest of the incoming wins; drops deleted passages (passage_id).

    Only lists that gain or lose a vector are written again. Incoming vectors that are not of their dimension change
    nothing.
    """
    spark = index.rows.sparkSession
    gone = deleted.select("passage_id").distinct()
    newest = F.max_by(F.struct("dimension", "embedding", "created_at"), F.struct("created_at", "dimension"))
    fresh = valid(incoming).join(gone, "passage_id", "left_anti").groupBy(*IDENTITY).agg(newest.alias("_v")).select(*IDENTITY, "_v.*")
    fresh = cut_lineage(assign(fresh, passages, index.centres))
    replaced = index.rows.select(*IDENTITY, "dimension", "list").join(fresh.select(*IDENTITY), IDENTITY, "left_semi")
    removed = index.rows.select(*IDENTITY, "dimension", "list").join(gone, "passage_id", "left_semi")
    touched = cut_lineage(
        replaced.select("dimension", "list").union(removed.select("dimension", "list")).union(fresh.select("dimension", "list")).distinct()
    )
    kept = (
        index.rows.join(touched, ["dimension", "list"], "left_semi")
        .join(fresh.select(*IDENTITY), IDENTITY, "left_anti").join(gone, "passage_id", "left_anti")
    )
    # A list that has lost all its vectors keeps one empty row, so that it is written, too.
    content = kept.unionByName(fresh).unionByName(touched, allowMissingColumns=True)
    path = work_dir(spark, "lists")
    content.write.parquet(path)  # before the lists it is read from are replaced
    store(spark.read.schema(content.schema).parquet(path), index.folder)
    return VectorIndex.open(spark, index.folder)


def probe_order(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """(query_id, keys, vector, bound, turn): every list of a query's space, the nearest centre first, with the best
    cosine that a vector in it can have."""
    known = index.centres

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, group in frame.groupby(MODEL, sort=False):
                found = angles(np.array(group["vector"].tolist(), float), known.get((key[0], key[1], int(key[2]))))
                yield group[["query_id", *MODEL, "space_id"]].assign(angles=list(found))

    query_id = asked.schema["query_id"].dataType.simpleString()
    rows = asked.select("query_id", *MODEL, "space_id", "vector").mapInPandas(
        measure, f"query_id {query_id}, provider string, model string, dimension int, space_id string, angles array<double>"
    )
    rows = rows.select("query_id", *MODEL, "space_id", F.posexplode("angles").alias("list", "angle"))
    rows = rows.filter(~F.isnan("angle")).join(index.lists(), KEYS)
    turn = F.row_number().over(rt.W.partitionBy("query_id").orderBy("angle", *KEYS))
    return rows.select("query_id", *KEYS, F.cos(F.greatest(F.col("angle") - F.col("reach"), F.lit(0.0))).alias("bound"), turn.alias("turn"))


def open_lists(index: VectorIndex, asked: DataFrame, chosen: DataFrame, limit: int) -> DataFrame:
    """(query_id, passage_id, semantic_score) of the best ``limit`` in each block of vectors of the chosen lists."""
    lists = chosen.select(*KEYS).distinct()
    stored = index.rows.join(lists, KEYS, "left_semi")
    queries = chosen.select("query_id", *KEYS).join(asked.select("query_id", *MODEL, "space_id", "vector"), ["query_id", *MODEL, "space_id"])
    return rt.score_blocks(stored, queries, KEYS, asked.schema["query_id"].dataType.simpleString(), limit)


def search(index: VectorIndex, query_vectors: DataFrame, limit: int = 50, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """Cosine ranks as ``retrieval.vector_rank`` gives them: query_id, passage_id, semantic_score, semantic_rank.

    Each query opens its ``probes`` nearest lists. With ``exact`` it then opens every list whose bound reaches its
    ``limit``-th best cosine, so nothing is missed; without, the first lists decide.
    """
    asked = query_vectors.withColumn("dimension", F.size("vector")).filter("dimension > 0")
    order = cut_lineage(probe_order(index, asked))
    best = [F.desc("semantic_score"), F.asc("passage_id")]
    found = top_k(open_lists(index, asked, order.filter(F.col("turn") <= probes), limit), ["query_id"], best, limit, "semantic_rank")
    if not exact:
        return found
    found = cut_lineage(found)
    bars = found.filter(F.col("semantic_rank") == limit).select("query_id", F.col("semantic_score").alias("bar"))
    more = order.filter(F.col("turn") > probes).join(bars, "query_id", "left")
    more = cut_lineage(more.filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - SLACK)).select("query_id", *KEYS))
    rest = open_lists(index, asked, more, limit)
    return top_k(found.drop("semantic_rank").unionByName(rest), ["query_id"], best, limit, "semantic_rank")
