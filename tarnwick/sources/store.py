"""The store: Parquet tables of the engine's relations, and what an index pass changes in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import schema
from tarnwick.functions.vectors import large

RELATIONS = {"files": schema.FILES, "chunks": schema.CHUNKS, "symbols": schema.SYMBOLS, "edges": schema.EDGES, "flows": schema.FLOWS, "meta": schema.META}


def changes(old: DataFrame, now: DataFrame) -> DataFrame:
    """old and now (path, sha) -> (path, change): new, changed, same or orphan."""
    both = old.select("path", F.col("sha").alias("was")).join(now.select("path", F.col("sha").alias("sha")), "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("sha").isNull(), "orphan").when(F.col("was") == F.col("sha"), "same").otherwise("changed")
    return both.select("path", change.alias("change"))


def replace_rows(old: DataFrame, new: DataFrame, paths: DataFrame, key: str = "file") -> DataFrame:
    """Rows of the paths in question go, the new ones come."""
    return old.join(large(paths.select(F.col("path").alias(key)).distinct()), key, "left_anti").unionByName(new)


def replace_edges(old: DataFrame, new: DataFrame, reindexed: DataFrame, orphans: DataFrame) -> DataFrame:
    """Outgoing edges of re-indexed files are replaced; incoming ones stay, but for those of orphans."""
    kept = old.join(large(reindexed.union(orphans).select(F.col("path").alias("src")).distinct()), "src", "left_anti")
    kept = kept.join(large(orphans.select(F.col("path").alias("dst")).distinct()), "dst", "left_anti")
    return kept.select("src", "dst", "kind").unionByName(new.select("src", "dst", "kind")).distinct()


class Store:
    """Relations as versioned Parquet folders under one root; a pass writes what it changes and then points to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version that was committed; 0 before the first."""
        fs = self._fs()
        if not fs.exists(self._path("_versions")):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(self._path("_versions"))), default=0)

    def _parts(self, v: int) -> dict[str, int]:
        """Where each relation's rows lie: the version that wrote them last."""
        fs, at = self._fs(), self._path("_versions", str(v))
        return {n: int(k) for s in fs.listStatus(at) for n, _, k in [s.getPath().getName().partition("@")]}

    def read(self, name: str) -> DataFrame:
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], RELATIONS[name])
        return self.spark.read.schema(RELATIONS[name]).parquet(f"{self.root}/{self._parts(v)[name]}/{name}")

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write the relations that changed as a new version, which shows only once its marker is made, so a failed pass changes nothing.

        Relations that aren't given stay where they are.  A version that no later one but the last points to is
        deleted, so readers of the version before can finish.
        """
        old = self.version()
        v, at = old + 1, self._parts(old) if old else {}
        for name in RELATIONS:
            if name in tables or not old:
                df = tables[name] if name in tables else self.read(name)
                df.write.mode("overwrite").parquet(f"{self.root}/{v}/{name}")
                at[name] = v
        fs = self._fs()
        for name, k in at.items():
            fs.mkdirs(self._path("_making", str(v), f"{name}@{k}"))
        fs.mkdirs(self._path("_versions"))
        fs.rename(self._path("_making", str(v)), self._path("_versions", str(v)))
        self._forget(v)
        return v

    def _forget(self, v: int) -> None:
        """Delete markers before the last version but one, and rows that neither of the two has."""
        fs = self._fs()
        for s in fs.listStatus(self._path("_versions")):
            if int(s.getPath().getName()) < v - 1:
                fs.delete(s.getPath(), True)
        kept = {(k, n) for k0 in (v, v - 1) if k0 and fs.exists(self._path("_versions", str(k0))) for n, k in self._parts(k0).items()}
        for s in fs.listStatus(self._path()):
            name = s.getPath().getName()
            if name.isdigit():
                for t in fs.listStatus(s.getPath()):
                    if (int(name), t.getPath().getName()) not in kept:
                        fs.delete(t.getPath(), True)
                if not fs.listStatus(s.getPath()):
                    fs.delete(s.getPath(), True)

    def stats(self) -> DataFrame:
        rows = [self.read(n).agg(F.lit(n).alias("relation"), F.count("*").alias("rows")) for n in RELATIONS]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def set_meta(self, k: str, v: str) -> None:
        meta = self.read("meta").where(F.col("k") != k).unionByName(self.spark.createDataFrame([(k, v)], schema.META))
        self.commit({"meta": meta})

    def get_meta(self, k: str) -> str | None:
        row = self.read("meta").where(F.col("k") == k).first()
        return row["v"] if row else None
