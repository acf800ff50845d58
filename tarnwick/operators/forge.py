"""Strategies from elsewhere: found gaps, checked partitions, trusted files."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import chunkers as C
from tarnwick.operators import corpus, evaluation


def validate(strategy, samples: list[tuple[str, str]]) -> list[str]:
    """Complaints about a strategy on sample files: a chunk list that is no exact partition of the lines, or an error."""
    out = []
    for path, text in samples:
        try:
            r = C.chunk_file(path, text, strategy)
        except Exception as e:
            out.append(f"{path}: {type(e).__name__}: {e}")
            continue
        at = 0
        for c in r["chunks"]:
            if c["start_line"] != at + 1 or c["end_line"] < c["start_line"]:
                out.append(f"{path}: lines {at + 1} to {c['start_line'] - 1} are not covered")
                break
            at = c["end_line"]
        else:
            if at != r["total_lines"]:
                out.append(f"{path}: {r['total_lines'] - at} lines at the end are not covered")
    return out


def forge(ext: str, samples: list[tuple[str, str]], write: Callable[[str, list[tuple[str, str]], list[str]], str], load: Callable[[str], object], tries: int = 3) -> tuple[str | None, list[str]]:
    """Ask a writer for a strategy's source until it passes, handing back the complaints: (source or None, last complaints)."""
    complaints: list[str] = []
    for _ in range(tries + 1):
        source = write(ext, samples, complaints)
        try:
            complaints = validate(load(source), samples)
        except Exception as e:
            complaints = [f"{type(e).__name__}: {e}"]
        if not complaints:
            return source, []
    return None, complaints


class Trust:
    """Which strategy files may run: by the hash of their content, kept by the user and never in the repository."""

    def __init__(self, path: str):
        self.path = path

    def _read(self) -> list[str]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @staticmethod
    def of(path: str) -> str:
        with open(path, "rb") as f:
            return hashlib.sha256(f.read()).hexdigest()

    def add(self, path: str) -> None:
        known = sorted({*self._read(), self.of(path)})
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(known, f)
        os.replace(self.path + ".new", self.path)

    def holds(self, path: str) -> bool:
        return self.of(path) in self._read()


def load_strategies(folder: str, trust: Trust) -> tuple[list, list[str]]:
    """Strategies of the trusted files of a folder (their ``STRATEGY``), and the files that were passed over."""
    found, skipped = [], []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        path = os.path.join(folder, name)
        if not name.endswith(".py"):
            continue
        if not trust.holds(path):
            skipped.append(name)
            continue
        spec = importlib.util.spec_from_file_location(f"strategy_{name[:-3]}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        found.append(module.STRATEGY)
    return found, skipped


def shapes(chunks: DataFrame, least: int = 120, files: DataFrame | None = None) -> DataFrame:
    """Files that may deserve a strategy of their own: (path, shape).

    A table is a Python file of files (path, text) that one literal fills; a blob has one chunk of most of the
    file, a window plain line windows.  The first shape that fits counts.
    """
    size = F.col("end_line") - F.col("start_line") + 1
    rows = chunks.groupBy("path").agg(F.sum(size).alias("lines"), F.max(size).alias("largest"), F.avg((F.col("kind") == "lines").cast("double")).alias("plain"))
    rows = rows.where(F.col("lines") >= least)
    if files is None:
        rows = rows.withColumn("table", F.lit(False))
    else:

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pdf.loc[[evaluation.largest_table(t or "") is not None for t in pdf["text"]], ["path"]]

        tables = files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, "path string")
        rows = rows.join(tables.distinct().withColumn("table", F.lit(True)), "path", "left")
    shape = F.when(F.col("table"), "table").when(F.col("largest") > 0.55 * F.col("lines"), "blob").when(F.col("plain") > 0.5, "window")
    return rows.select("path", shape.alias("shape")).where("shape is not null")


def gate(files: DataFrame, rank: Callable[[DataFrame], DataFrame], own: list, probes: DataFrame) -> DataFrame:
    """Index with and without the strategies, rank both for the probes, and compare: one row with whether the new ones win."""
    def measured(strategies: list | None) -> DataFrame:
        chunks = C.children(C.parsed(files, strategies))[1].withColumnRenamed("file", "path")
        if corpus.partition_violations(chunks, files).count():
            raise ValueError("the strategy's chunks are no partition")
        return evaluation.measure(probes, rank(chunks))

    return evaluation.ab_gate(measured(None), measured(own))
