"""Incremental indexing as a stream of changed files: each micro-batch is one pass of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwick.sources.store import Store


def latest(changes: DataFrame) -> DataFrame:
    """changes (path, text, seq): the last of each path; a null text deletes."""
    w = Window.partitionBy("path").orderBy(F.col("seq").desc())
    return changes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def apply_changes(spark: SparkSession, batch: DataFrame, texts_root: str, index_root: str, embedder=None) -> dict:
    """Merge a batch of changes into the texts and bring the index up to date; the same batch again changes nothing."""
    from tarnwick.plans.indexer import index

    new = latest(batch)
    store = _Texts(spark, texts_root)
    merged = store.read().join(new.select("path"), "path", "left_anti").unionByName(new.where("text is not null").select("path", "text"))
    store.write(merged)
    return index(spark, store.read(), index_root, embedder)


class _Texts:
    """Versions of (path, text) under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.inner = spark, Store(spark, root)

    def read(self) -> DataFrame:
        v = self.inner.version()
        if not v:
            return self.spark.createDataFrame([], "path string, text string")
        return self.spark.read.schema("path string, text string").parquet(f"{self.inner.root}/{v}/texts")

    def write(self, df: DataFrame) -> None:
        v = self.inner.version() + 1
        df.write.mode("overwrite").parquet(f"{self.inner.root}/{v}/texts")
        self.inner._fs().mkdirs(self.inner._path("_versions", str(v)))


def follow(spark: SparkSession, source: str, texts_root: str, index_root: str, checkpoint: str, embedder=None) -> StreamingQuery:
    """Index all files of changes that are there, then stop; run it again for what came since."""
    changes = spark.readStream.schema("path string, text string, seq long").parquet(source)
    return (changes.writeStream.foreachBatch(lambda df, _: apply_changes(spark, df.persist(), texts_root, index_root, embedder) and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
