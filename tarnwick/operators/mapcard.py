"""The task map: which files, what they hold, what ties them, and where the query's names live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.vectors import large, small

HEAD, TAIL, DEMOS = 8, 8, 2


def head_and_tail(pruned: DataFrame) -> DataFrame:
    """pruned (qid, file, score) -> (qid, file, score, part, place): the first files without demonstrations, then others without tests, then demonstrations."""
    by = pruned.groupBy("qid", "file").agg(F.max("score").alias("score"))
    kind = F.when(T.is_demo_path("file"), "demo").when(T.is_test_path("file"), "test").otherwise("code")
    w = Window.partitionBy("qid", "group").orderBy(F.col("score").desc(), "file")
    rows = by.withColumn("kind", kind).withColumn("group", F.when(F.col("kind") == "demo", "demo").otherwise("main")).withColumn("r", F.row_number().over(w))
    head = rows.where(f"group = 'main' and r <= {HEAD}").withColumn("part", F.lit("head"))
    tail = rows.where(f"group = 'main' and r > {HEAD} and kind <> 'test'").withColumn("r", F.row_number().over(w)).where(f"r <= {TAIL}").withColumn("part", F.lit("tail"))
    demo = rows.where(f"group = 'demo' and r <= {DEMOS}").withColumn("part", F.lit("demo"))
    return head.unionByName(tail).unionByName(demo).select("qid", "file", "score", "part", F.col("r").cast("long").alias("place"))


def outline(spans: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """spans (qid, file, lo, hi) -> the symbols that overlap most lines: (qid, file, name, line, overlap)."""
    both = spans.join(large(symbols.select("file", "name", "line", "end_line")), "file").where("line <= hi and end_line >= lo")
    cut = F.least("hi", "end_line") - F.greatest("lo", "line") + 1
    sums = both.groupBy("qid", "file", "name", "line").agg(F.sum(cut).alias("overlap"))
    return sums.withColumn("r", F.row_number().over(Window.partitionBy("qid", "file").orderBy(F.col("overlap").desc(), "line"))).where(F.col("r") <= most).drop("r")


def links(edges: DataFrame, files: DataFrame, most: int = 4) -> DataFrame:
    """files (file) with a few sources and targets by name: (file, way, other)."""
    f = small(files.select("file").distinct())
    rows = edges.select(F.col("dst").alias("file"), F.lit("reached_from").alias("way"), F.col("src").alias("other")).unionByName(edges.select(F.col("src").alias("file"), F.lit("reaches").alias("way"), F.col("dst").alias("other")))
    return rows.join(f, "file", "left_semi").distinct().withColumn("r", F.row_number().over(Window.partitionBy("file", "way").orderBy("other"))).where(F.col("r") <= most).drop("r")


def defines(queries: DataFrame, symbols: DataFrame, most: int = 4) -> DataFrame:
    """Where the identifiers of a query are defined, if in one or two places outside tests: (qid, said, file, line).

    Longer names count first, and a name within another is dropped.
    """
    said = queries.select("qid", F.explode(F.array_distinct(F.filter(F.regexp_extract_all("query", F.lit("[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0)), lambda s: F.length(s) >= 4))).alias("said"))
    said = small(said)
    leaf = F.element_at(F.split("name", "[.]"), -1)
    hit = symbols.where(~T.is_test_path("file")).select("file", "line", F.explode(F.array_distinct(F.array(F.col("name"), leaf))).alias("said")).join(said, "said")
    n = Window.partitionBy("qid", "said")
    few = hit.withColumn("n", F.count("*").over(n)).where("n <= 2").drop("n")
    kept = few.withColumn("all", F.collect_set("said").over(Window.partitionBy("qid"))).where(~F.exists("all", lambda o: (o != F.col("said")) & o.contains(F.col("said")))).drop("all")
    w = Window.partitionBy("qid").orderBy(F.length("said").desc(), "said", "file", "line")
    return kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def trail(names: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """names (qid, said), lines (file, line, text) -> counts by name and kind: define sites, readers, tests.  All names meet the lines in one join on words."""
    words = lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("said")).join(small(names), "said")
    at = symbols.select("file", "line", F.element_at(F.split("name", "[.]"), -1).alias("said"), F.lit(True).alias("here"))
    kind = F.when(T.is_test_path("file"), "tests").when(F.col("here"), "defines").otherwise("reads")
    return words.join(large(at), ["file", "line", "said"], "left").withColumn("kind", kind)


def expand_pool(pool: DataFrame, query: str, terms: Callable[[str], list[str]] | None, search: Callable[[str], DataFrame]) -> DataFrame:
    """pool and what a second search finds with up to five terms that a model names; fails open."""
    try:
        more = [t for t in (terms(query) if terms else []) if 3 <= len(t) <= 60][:5]
    except Exception:
        more = []
    if not more:
        return pool
    found = search(query + " " + " ".join(more))
    return pool.unionByName(found.join(pool.select("id"), "id", "left_anti"))
