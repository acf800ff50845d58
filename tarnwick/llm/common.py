"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast as a filter, after they were counted (8 bytes each).
BROADCAST_ROWS = 200_000
#: Rows of a stored table that are worth a task and a file of their own.
FILE_ROWS = 100_000
#: Rows up to which a table is dealt again for that.
FEW_ROWS = 2_000_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's own checkpoint folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwick-"))  # one machine, so its temporary folder is shared
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    Where df is known to have at most so many rows, and they are few, they are dealt to no more tasks than
    FILE_ROWS asks for (and as many as run at once), so that a small table isn't hundreds of small files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnwick-{uuid.uuid4().hex}"
    _written.append(path)
    if rows is not None and rows <= FEW_ROWS:
        df = df.repartition(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Delete every table that stored() wrote in this process.  Only once results that read them are written."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these frames."""
    for df in frames:
        spark = df.sparkSession
        for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
            if "/tarnwick-" in path:
                _delete(spark, path)


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if df has at most limit rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def only_in(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join on key; ids is broadcast only after its count proved small, else it is shuffled."""
    return df.join(F.broadcast(ids) if few(ids, limit) else ids, key, how)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % m


#: Links that one task contracts at once.
LOCAL_LINKS = 500_000


def contracted(links: DataFrame, tasks: int) -> DataFrame:
    """links (u, v) as stars: each task joins every id of its share to the smallest id that the share's links reach."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            ids, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            low = smallest(len(ids), *at.reshape(2, -1))
            off = np.flatnonzero(low != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[low[off]])], ["u", "v"])

        for batch in it:
            if batch.num_rows:
                held.append(np.stack([batch.column(c).to_numpy() for c in ("u", "v")]))
                if sum(x.shape[1] for x in held) > 2 * LOCAL_LINKS:
                    yield done()
                    held.clear()
        if held:
            yield done()

    return links.coalesce(tasks).mapInArrow(run, "u long, v long")


def smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For places 0 to n - 1, the smallest place that each reaches by the links i - j."""
    own = np.arange(n)
    while True:
        low = np.minimum(own[i], own[j])
        new = own.copy()
        np.minimum.at(new, own[i], low)
        np.minimum.at(new, own[j], low)
        new = new[new]
        if (new == own).all():
            return own
        own = new


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Connected components of undirected links: rows (id, component) with the smallest id that links reach.

    Each task first contracts its share of the links to stars.  If there was one share, that is the
    result.  Otherwise large-star and small-star steps alternate with contraction (Kiveris et
    al., 2014): grouped minima and joins over links only, written to the shared folder after each
    round, so that nothing is collected and a lost executor costs one round.  Ids without a link are not
    returned.  rows bounds the number of links where the caller knows it.
    """
    links = stored(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"), rows)
    n = links.count()
    before = None
    while True:
        tasks = -(-n // LOCAL_LINKS) or 1
        new = stored(contracted(links, tasks))
        forget(links)
        links = new
        if tasks == 1:
            break
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stored(small, 2 * n)
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        forget(links)
        links, n = new, mark["n"]
        if mark == before or not n:
            break
        before = mark
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
