"""A cleaning pipeline over ``documents``: rules, toxicity, repeated lines, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Columns it does not change
pass through. Rows with null or empty text fail the rules; a null doc_id is a document like any other; an empty table
passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrain.llm import line_dedup, near_dup, packing, quality, toxicity
from leafgrain.llm.common import materialize, table
from leafgrain.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules and trees keep; the trees learn from labelled documents of ``docs``."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later repeats of runs of lines from the texts and counts ``n_chars`` anew, if there. A document may become empty."""
    clean = line_dedup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: five-word shingles, similarity 0.8.

    What is dropped are texts of an id, not ids: where one id has several texts, each is judged on its own. Rows equal
    in id and text stay or go together.
    """
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("text"))  # a null id is least of none
    found = near_dup.near_duplicates(docs.select(own.alias("doc_id"), "text"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id.doc_id").alias("_gone"), F.col("doc_id.text").alias("_text")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_text"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("toxicity", toxic_documents), ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates), ("packing", packed),
]
#: Trees, calibration and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
