"""Literal search that knows what a line is: definition, read, test, documentation or configuration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.vectors import large, small

DOCS, CONFIG = ("md", "rst", "txt"), ("json", "yaml", "yml", "toml", "xml")
ORDER = ("defines", "reads", "tests", "docs", "config")


def grep(chunks: DataFrame, symbols: DataFrame, edges: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, scope: str | None = None) -> DataFrame:
    """chunks (file, start_line, text) -> (file, line, text, symbol, role, in_degree).

    Chunks without a match go before lines are exploded.  The scope filters strictly.
    """
    expr = ("(?i)" if ignore_case else "") + (pattern if regex else re.escape(pattern))
    test = (lambda c: c.contains(pattern)) if not regex and not ignore_case else (lambda c: c.rlike(expr))
    own = chunks if scope is None else chunks.where(T.under_path("file", scope))
    hits = own.where(test(F.col("text"))).select("file", F.posexplode(T.lines("text")).alias("k", "text"), "start_line").where(test(F.col("text")))
    hits = hits.select("file", (F.col("start_line") + F.col("k")).cast("int").alias("line"), "text")
    around = hits.join(large(symbols.select("file", F.col("name").alias("symbol"), F.col("line").alias("lo"), "end_line")), "file").where("line between lo and end_line")
    inner = around.groupBy("file", "line").agg(F.max_by(F.struct("symbol", "lo"), F.struct("lo", "symbol")).alias("s"))
    degree = edges.groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("in_degree"))
    rows = hits.join(large(inner), ["file", "line"], "left").join(small(degree), "file", "left")
    ext, bare = T.extension("file"), F.element_at(F.split("s.symbol", "[.]"), -1)
    defines = (F.col("s.lo") == F.col("line")) & bare.contains(pattern) if not regex else F.lit(False)
    role = (F.when(T.is_test_path("file"), "tests").when(ext.isin(*DOCS), "docs").when(ext.isin(*CONFIG) | F.col("s").isNull(), "config").when(defines, "defines").otherwise("reads"))
    return rows.select("file", F.col("line").cast("long").alias("line"), "text", F.col("s.symbol").alias("symbol"), role.alias("role"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def sections(hits: DataFrame, cap: int = 200) -> DataFrame:
    """Hits ranked within their role (reads by in-degree), at most cap each, with the true count."""
    w = Window.partitionBy("role")
    order = w.orderBy(F.when(F.col("role") == "reads", -F.col("in_degree")).otherwise(F.lit(0)), "file", "line")
    first = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)  # each task keeps its own first ones only
    totals = hits.groupBy("role").agg(F.count("*").alias("total"))  # a row a role
    return first.join(F.broadcast(totals), "role").withColumn("place", F.col("place").cast("long"))


def reached_from(edges: DataFrame, files: DataFrame, most: int = 4) -> DataFrame:
    """files (file) -> (file, reached_from): the first distinct sources by name."""
    hit = edges.select(F.col("dst").alias("file"), "src").join(small(files.select("file").distinct()), "file", "left_semi").distinct()
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("src"))).where(F.col("r") <= most)
    return ranked.groupBy("file").agg(F.array_sort(F.collect_list("src")).alias("reached_from"))


def find_symbols(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols whose full name, or its last part, is name."""
    return symbols.where((F.col("name") == name) | (F.element_at(F.split("name", "[.]"), -1) == name))


def symbol_names(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(F.element_at(F.split("name", "[.]"), -1).alias("bare")).agg(F.count("*").alias("n"))
