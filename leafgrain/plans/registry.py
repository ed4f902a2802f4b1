"""Registry of runnable queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrain.plans.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Session settings that make the registered queries faster; none changes a result. Queries never set them: a session
# is its user's. ``bench.py`` and the tests ask for them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles methods over 8000 bytes; longer fused stages would be interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The rule adds "size(array) > 0" below every explode; for computed arrays (tokens,
    # packed groups) that evaluates the whole array expression a second time.
    "spark.sql.optimizer.excludedRules":
        "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def configure(spark: SparkSession) -> None:
    """Apply the settings to a session of your own; rules that it already excludes stay excluded."""
    for key, value in SETTINGS.items():
        if key.endswith("excludedRules") and (known := spark.conf.get(key, "") or ""):
            value = ",".join(dict.fromkeys([*known.split(","), value]))
        spark.conf.set(key, value)


def widen(df: DataFrame) -> DataFrame:
    """64-bit numbers only, so results compare by value across engines."""
    wide = {
        T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint",
        T.FloatType: "double",
    }
    return df.select(*[
        F.col(f.name).cast(wide[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in wide else F.col(f.name)
        for f in df.schema.fields
    ])


SETUP: list[Callable[[], None]] = []


def setup(fn: Callable[[], None]) -> Callable[[], None]:
    """Register a function that makes a module's shared columns (they need a session)."""
    SETUP.append(fn)
    return fn


def query(name: str, oracle: str | None = None):
    """Register a function of the corpus, with its SQL twin when SQL can say it."""

    def register(fn: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            for make_columns in SETUP:
                make_columns()
            return widen(fn(Corpus(spark, root)))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def stamp(column) -> object:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
