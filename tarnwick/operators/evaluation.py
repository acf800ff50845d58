"""Evaluation: recall, bundle completeness, spans, gates."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.chunkers import UNPARSED


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """ranked (qid, file, rank), gold (qid, file) -> one row with r_at_k: the share of queries with a gold file among the first k."""
    best = gold.join(ranked, ["qid", "file"], "left").groupBy("qid").agg(F.min("rank").alias("best"))
    return best.agg(*[F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))).alias(f"r_at_{k}") for k in ks], F.count("*").alias("queries"))


def bundle_full(bundle: DataFrame, gold: DataFrame) -> DataFrame:
    """The share of queries whose gold files are all in the bundle."""
    hit = gold.join(bundle.select("qid", "file", F.lit(1).alias("hit")).distinct(), ["qid", "file"], "left").groupBy("qid").agg(F.min(F.coalesce("hit", F.lit(0))).alias("full"))
    return hit.agg(F.avg(F.col("full").cast("double")).alias("bundle_full"), F.count("*").alias("queries"))


def block_probes(lines: DataFrame, most: int = 60) -> DataFrame:
    """Blank-line blocks of each file as probes (path, lo, hi), at most `most` by an even stride: gaps and islands."""
    rows = lines.withColumn("blank", F.trim("text") == "")
    w = Window.partitionBy("path").orderBy("line")
    isle = rows.withColumn("isle", F.sum(F.col("blank").cast("int")).over(w)).where("not blank")
    blocks = isle.groupBy("path", "isle").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    b = Window.partitionBy("path")
    ranked = blocks.withColumns({"k": F.row_number().over(b.orderBy("lo")) - 1, "n": F.count("*").over(b)})
    stride = F.greatest(F.ceil(F.col("n") / most), F.lit(1))
    return ranked.where(F.col("k") % stride == 0).select("path", "lo", "hi")


# Entries and share of its file's lines beyond which a literal is a table; length of a probe's question.
TABLE_ENTRIES, TABLE_SHARE, QUESTION = 10, 0.3, 120


def largest_table(source: str) -> tuple[list[tuple[ast.expr, ast.expr]], int] | None:
    """Entries (first and last expression) and line span of the literal that takes the most lines of a Python file, if it is a table."""
    try:
        tree = ast.parse(source)
    except UNPARSED:
        return None
    best = None
    for node in ast.walk(tree):
        if isinstance(node, ast.Dict):
            entries = [(k or v, v) for k, v in zip(node.keys, node.values)]
        elif isinstance(node, ast.List):
            entries = [(e, e) for e in node.elts]
        else:
            continue
        span = node.end_lineno - node.lineno
        if len(entries) > TABLE_ENTRIES and (best is None or span > best[1]):
            best = (entries, span)
    return best if best and best[1] > TABLE_SHARE * len(source.splitlines()) else None


def python_targets(source: str) -> list[tuple[str, int, int]]:
    """What a Python file could be asked for (question, lo, hi): the entries of its table by their constants, or else its top-level definitions."""
    if found := largest_table(source):
        words = lambda *nodes: " ".join(str(n.value) for top in dict.fromkeys(nodes) for n in ast.walk(top) if isinstance(n, ast.Constant))
        return [(words(first, last)[:QUESTION], first.lineno, last.end_lineno) for first, last in found[0]]
    try:
        body = ast.parse(source).body
    except UNPARSED:
        return []
    defs = [x for x in body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    return [(f"{x.name} {ast.get_docstring(x) or ''}".strip()[:QUESTION], x.lineno, x.end_lineno) for x in defs]


def python_probes(files: DataFrame, most: int = 60) -> DataFrame:
    """files (path, text) -> probes (path, question, lo, hi) of Python files, at most `most` a file by an even stride.

    Files that don't parse, and null or empty texts, give no rows; block_probes() takes those.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                found = python_targets(text or "")
                n = min(most, len(found))
                rows += [(path, *found[k * len(found) // n]) for k in range(n)]
            yield pd.DataFrame(rows, columns=["path", "question", "lo", "hi"])

    return files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, "path string, question string, lo long, hi long")


def measure(probes: DataFrame, ranked: DataFrame) -> DataFrame:
    """probes (qid, path, lo, hi), ranked (qid, id, path, start_line, end_line, rank) -> (qid, path, iou, hit1, hit5).

    The overlap is that of the file's best-ranked chunk, over the hull; hits count any overlapping chunk of the file by its global rank (from 1).
    """
    both = probes.join(ranked, ["qid", "path"])
    cut = F.greatest(F.least("hi", "end_line") - F.greatest("lo", "start_line") + 1, F.lit(0))
    hull = F.greatest("hi", "end_line") - F.least("lo", "start_line") + 1
    rows = both.withColumns({"iou": cut / hull, "over": cut > 0})
    agg = rows.groupBy("qid", "path", "lo", "hi").agg(F.min_by("iou", "rank").alias("iou"), F.max((F.col("over") & (F.col("rank") <= 1)).cast("int")).alias("hit1"), F.max((F.col("over") & (F.col("rank") <= 5)).cast("int")).alias("hit5"))
    return probes.join(agg, ["qid", "path", "lo", "hi"], "left").select("qid", "path", F.coalesce("iou", F.lit(0.0)).alias("iou"), F.coalesce("hit1", F.lit(0)).alias("hit1"), F.coalesce("hit5", F.lit(0)).alias("hit5"))


def changed_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose sets of chunk spans differ."""
    spans = lambda df, n: df.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("start_line", "end_line"))).alias(n))
    return spans(a, "a").join(spans(b, "b"), "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def too_fine(chunks: DataFrame, builtin: DataFrame) -> DataFrame:
    """Paths whose median chunk has under 100 characters and under half of the built-in's."""
    med = lambda df, n: df.groupBy("path").agg(F.array_sort(F.collect_list("nws")).alias("l")).select("path", F.element_at("l", (F.size("l") / 2).cast("int") + 1).alias(n))
    return med(chunks, "m").join(med(builtin, "b"), "path").where((F.col("m") < 100) & (F.col("m") < 0.5 * F.col("b"))).select("path")


def ab_gate(a: DataFrame, b: DataFrame, lift: float = 0.01) -> DataFrame:
    """measure() of two chunkers -> one row: pooled overlap, hits, the worst file, and whether b wins."""
    agg = lambda df, n: df.groupBy("path").agg(F.sum("iou").alias(f"iou_{n}"), F.sum("hit1").alias(f"hit_{n}"), F.count("*").alias(f"n_{n}"))
    files = agg(a, "a").join(agg(b, "b"), "path")
    worst = F.min(F.col("iou_b") / F.col("n_b") - F.col("iou_a") / F.col("n_a"))
    row = files.agg((F.sum("iou_a") / F.sum("n_a")).alias("iou_a"), (F.sum("iou_b") / F.sum("n_b")).alias("iou_b"), F.sum("hit_a").alias("hit_a"), F.sum("hit_b").alias("hit_b"), worst.alias("worst"))
    return row.withColumn("win", (F.col("iou_b") - F.col("iou_a") >= lift) & (F.col("hit_b") >= F.col("hit_a")) & (F.col("worst") >= -lift))
