"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrain.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every end of a link (a, b); root is the same for all that links join.

    Each round every vertex goes over to its least neighbour and the links are drawn between what is left, so a star
    of any size is gone in two rounds and a chain of random ids in a logarithm of its length. A vertex's neighbours
    are only ever reduced to their minimum, never listed.
    """
    found: DataFrame | None = None
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to")), "hops")
        far = hop.select(F.col("v").alias("_mid"), F.col("to").alias("_end"))
        hop = materialize(hop.join(far, F.col("to") == F.col("_mid"), "left").select("v", F.coalesce("_end", "to").alias("to")), "hops")
        if found is None:
            found = hop.select("v", F.col("to").alias("root"))
        else:
            found = found.join(hop.withColumnRenamed("v", "_v"), F.col("root") == F.col("_v"), "left").select("v", F.coalesce("to", "root").alias("root"))
        found = materialize(found, "roots")
        left, right = (hop.select(F.col("v").alias(x), F.col("to").alias(f"_{x}")) for x in "ab")
        edges = materialize(edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
