"""The corpus pipeline: documents in, a deduplicated, cleaned, mixed and sharded corpus out.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each
stage's rows as Parquet in the shared folder and reads them again for the next.  Extra
columns are carried along, whatever their names; rows with null text count as empty
texts, which no stage rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import decontaminate, jaccard, mixing, sharding, toxicity
from tarnwick.llm.common import stored, table

USED = ("doc_id", "text", "source")


def carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with docs' columns alone; columns a stage doesn't use get other names meanwhile, so none clashes."""
    away = {c: c if c in USED else f"_tw_c{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in away.items()]))
    return out.select(*[F.col(a).alias(c) for c, a in away.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those the classifier rejects; equal texts share their fate, empty and null ones stay."""
    net = toxicity.model_of(spark, sf_dir)
    return carried(docs, lambda df: toxicity.scored(df, net).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; rows without id or words stay."""
    return carried(docs, jaccard.deduplicated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose text leaks a part of the benchmark, whatever its share of the text."""
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return carried(docs, lambda df: decontaminate.decontaminated(df, benchmark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of docs 0, 1 or 2 times, so that sources come near their targets; rows without words may go or stay."""
    return carried(docs, mixing.mix)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs with size, text_crc32, law, shard, slot and grown_shard; a column of docs with one of these names is carried as in_ and its name."""
    return sharding.shard(docs, kept="in_")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_corpus),
]

#: No SQL can express the classifier and the random rounding; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
