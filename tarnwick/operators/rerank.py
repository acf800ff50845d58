"""Reranking: the judge is pluggable; merging, rescue and set-aside are plain relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T

BATCH = 8
#: A judge takes (query, [chunk]) and returns the ids it keeps, best first.
Judge = Callable[[str, list[dict]], list[int]]


def batched(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """chunks (qid, id, rank) with their batch."""
    return chunks.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int"))


def merge_round_robin(verdict: DataFrame, ranked: DataFrame) -> DataFrame:
    """verdict (qid, batch, place, id) -> (qid, id, order, rescued): every batch's first, then every second, and so on.

    Unknown ids go, repeated ones count once; the deterministic first is put last if no batch kept it.
    """
    known = verdict.join(ranked.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid", "id").agg(F.min(F.struct("place", "batch")).alias("m")).select("qid", "id", "m.place", "m.batch", F.lit(False).alias("rescued"))
    first = ranked.where("rank = 1").select("qid", "id").join(known, ["qid", "id"], "left_anti").select("qid", "id", F.lit(1_000_000).alias("place"), F.lit(0).alias("batch"), F.lit(True).alias("rescued"))
    return known.unionByName(first).withColumn("order", F.row_number().over(Window.partitionBy("qid").orderBy("place", "batch"))).select("qid", "id", "order", "rescued")


def set_aside(ranked: DataFrame, kept: DataFrame, most: int = 8) -> DataFrame:
    """Dropped chunks worth a look: near the top score or among the first ten, not demonstrations, tests apart."""
    w = Window.partitionBy("qid")
    rows = ranked.withColumn("top", F.max("score").over(w)).join(kept.select("qid", "id"), ["qid", "id"], "left_anti")
    rows = rows.where(((F.col("score") >= 0.85 * F.col("top")) | (F.col("rank") <= 10)) & ~T.is_demo_path("file") & ~T.is_test_path("file"))
    return rows.withColumn("r", F.row_number().over(w.orderBy("rank"))).where(F.col("r") <= most).select("qid", "id", "file", "score")


def judged(chunks: list[dict], query: str, judge: Judge) -> list[dict]:
    """One query on the driver: batches are judged, merged and the first rescued.  Fails open: any error leaves the order as it was."""
    try:
        kept: list[list[int]] = []
        for at in range(0, len(chunks), BATCH):
            own = {x["id"] for x in chunks[at : at + BATCH]}
            kept.append([i for i in judge(query, chunks[at : at + BATCH]) if i in own])
    except Exception:
        return chunks
    order: list[int] = []
    for k in range(max(map(len, kept), default=0)):
        order += [b[k] for b in kept if k < len(b) and b[k] not in order]
    if not order:
        return chunks
    if chunks and chunks[0]["id"] not in order:
        order.append(chunks[0]["id"])
    by = {x["id"]: x for x in chunks}
    return [by[i] for i in order]


def line_score(line: Column, query: Column) -> Column:
    """Total length of the identifier parts that a line shares with the query."""
    return F.aggregate(F.array_intersect(T.ident_tokens(line), T.ident_tokens(query)), F.lit(0), lambda n, t: n + F.length(t))


def hint(text: Column, query: Column) -> Column:
    """A chunk's line with the highest score, the first of equals; null if no line shares anything."""
    scored = F.transform(T.lines(text), lambda line, k: F.struct(line_score(line, query).alias("s"), (-k).alias("k"), line.alias("line")))
    best = F.array_max(scored)
    return F.when(best["s"] > 0, F.trim(best["line"]))


def is_reexport(text: Column) -> Column:
    """At least five lines, of which 70 % import or export."""
    lines = F.filter(T.lines(text), lambda x: F.trim(x) != "")
    hits = F.filter(lines, lambda x: x.rlike(r"^\s*(import|from|export)\b"))
    return (F.size(lines) >= 5) & (F.size(hits) >= 0.7 * F.size(lines))
