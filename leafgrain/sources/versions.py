"""Outputs that are replaced paper by paper: a manifest of versions, tombstones, merge on read, compaction.

Below one root folder every version has its own folder of each table, and a folder of the manifest that is written last:
it names the papers of the version and makes the version valid. Nothing is rewritten when a paper is parsed again;
readers leave out what a later version replaced or a tombstone took away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEYS = ["paper_id", "space_id"]


@dataclass(frozen=True)
class Versions:
    """Versioned tables below ``root``; versions are growing numbers, such as the batch ids of a stream."""

    spark: SparkSession
    root: str

    def put(self, version: int, papers: DataFrame, **tables: DataFrame) -> None:
        """Write one version: the rows of some papers, which replace all earlier ones of these papers.

        ``papers``: paper_id, space_id, deleted. A paper without rows in a table has none from now on; one that is
        deleted (in any of its rows here) loses the rows of this version too. Each table has the two keys. Rows with a
        null key belong to no paper and are never replaced. A version written twice replaces itself.
        """
        if version < 0:
            raise ValueError("versions start at 0")
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        named = papers.groupBy(*KEYS).agg(F.bool_or(F.coalesce("deleted", F.lit(False))).alias("deleted"))
        named.write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")

    def current(self, name: str, upto: int | None = None) -> DataFrame:
        """Rows of a table as the last version (or ``upto``) left them, with their ``version``.

        Only (paper, version) pairs that were replaced or deleted meet the rows, in one anti-join; after a compaction
        there are none until a paper changes again.
        """
        base, versions = self._state(upto)
        parts = [self._rows(name, v) for v in versions]
        if base is not None:
            parts.insert(0, self.spark.read.parquet(f"{self._base(base)}/{name}").withColumn("version", F.lit(base).cast("bigint")))
        if not parts:
            raise ValueError(f"no version of {name} in {self.root}")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.join(self._dead(base, versions), [*KEYS, "version"], "left_anti") if versions else rows

    def written(self, name: str, version: int) -> DataFrame:
        """Rows that a version brought, but for those of papers it deleted."""
        gone = self._manifest([version]).filter("deleted").select(*KEYS)
        return self._rows(name, version).join(gone, KEYS, "left_anti")

    def replaced(self, name: str, version: int) -> DataFrame:
        """Rows that were current before a version and that it replaced or deleted."""
        base, versions = self._state(version - 1)
        if base is None and not versions:
            return self._rows(name, version).limit(0)
        return self.current(name, version - 1).join(self._manifest([version]).select(*KEYS), KEYS, "left_semi")

    def compact(self, *names: str) -> int:
        """Write what is current of all tables as one base and return its version.

        The base counts once its mark is written; a job that dies before leaves the versions as they are.
        """
        base, versions = self._state(None)
        last = versions[-1] if versions else base
        if last is None:
            raise ValueError(f"no version in {self.root}")
        if versions:
            for name in names:
                self.current(name).drop("version").write.mode("overwrite").parquet(f"{self._base(last)}/{name}")
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self._base(last)}/mark")
        return last

    def vacuum(self, *names: str) -> None:
        """Delete the folders that the newest base replaces. Frames read before are void afterwards."""
        base, _ = self._state(None)
        if base is None:
            return
        for name in (*names, "manifest"):
            for version in self._numbers(f"{self.root}/{name}", "version"):
                if version <= base:
                    self._files(f"{self.root}/{name}/version={version}", delete=True)
        for older in self._numbers(f"{self.root}/base", "upto"):
            if older < base:
                self._files(self._base(older), delete=True)

    def _state(self, upto: int | None) -> tuple[int | None, list[int]]:
        """The newest complete base and the valid versions after it; folder names only."""
        limit = float("inf") if upto is None else upto
        bases = [b for b in self._numbers(f"{self.root}/base", "upto") if self._files(f"{self._base(b)}/mark/_SUCCESS") and b <= limit]
        base = max(bases, default=None)
        versions = [
            v for v in self._numbers(f"{self.root}/manifest", "version")
            if v <= limit and v > (-1 if base is None else base) and self._files(f"{self.root}/manifest/version={v}/_SUCCESS")
        ]
        return base, sorted(versions)

    def _dead(self, base: int | None, versions: list[int]) -> DataFrame:
        entries = self._manifest(versions)
        paper = W.partitionBy(*KEYS)
        marked = entries.withColumns({"_newest": F.max("version").over(paper), "_gone": F.max_by("deleted", "version").over(paper)})
        dead = marked.filter("version < _newest or _gone").select(*KEYS, "version")
        if base is not None:
            dead = dead.unionByName(entries.select(*KEYS, F.lit(base).cast("bigint").alias("version")).distinct())
        return dead

    def _manifest(self, versions: list[int]) -> DataFrame:
        paths = [f"{self.root}/manifest/version={v}" for v in versions]
        rows = self.spark.read.option("basePath", f"{self.root}/manifest").parquet(*paths)
        return rows.withColumn("version", F.col("version").cast("bigint"))

    def _rows(self, name: str, version: int) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/{name}/version={version}")
        return rows.withColumn("version", F.lit(version).cast("bigint"))

    def _base(self, version: int) -> str:
        return f"{self.root}/base/upto={version}"

    def _files(self, path: str, delete: bool = False) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.delete(hadoop, True) if delete else system.exists(hadoop)

    def _numbers(self, path: str, name: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in system.listStatus(hadoop)] if system.exists(hadoop) else []
        return [int(x.split("=")[1]) for x in found if x.startswith(f"{name}=")]
