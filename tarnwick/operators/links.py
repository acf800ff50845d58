"""Where names are used and where they lead: use sites, go-to-definition links, what carries a hop, which way a path points."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.vectors import large
from tarnwick.operators import edges as E
from tarnwick.operators.chunkers import UNPARSED

USES = "src string, line int, name string, target string, place int, said string"


def python_uses(path: str, text: str) -> Iterator[tuple[int, str, str, int, str]]:
    """(line, name, module, place, said): calls and imports whose receiver is an imported name, or a variable built by an imported class."""
    try:
        tree = ast.parse(text)
    except UNPARSED:
        return
    own = E.python_module(path).split(".")
    package = own if path.endswith("__init__.py") else own[:-1]
    alias: dict[str, tuple[list[str], str]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                alias[a.asname or a.name.split(".")[0]] = ([a.name], "")
        elif isinstance(node, ast.ImportFrom):
            base = ".".join([*package[: len(package) - node.level + 1], *([node.module] if node.module else [])]) if node.level else node.module or ""
            for a in node.names:
                alias[a.asname or a.name] = ([f"{base}.{a.name}", base], a.name)
                yield from ((node.lineno, a.name, "m:" + m, k, "import") for k, m in enumerate([f"{base}.{a.name}", base]))
    built = {t.id: (node.value.func.id, alias[node.value.func.id]) for node in ast.walk(tree) if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name) and node.value.func.id in alias for t in node.targets if isinstance(t, ast.Name)}
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        f = node.func
        if isinstance(f, ast.Name) and f.id in alias:
            mods, name = alias[f.id]
            yield from ((node.lineno, name or f.id, "m:" + m, k, "call") for k, m in enumerate(mods))
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            if f.value.id in built:
                cls, (mods, _) = built[f.value.id]
                yield from ((node.lineno, f"{cls}.{f.attr}", "m:" + m, k, "call") for k, m in enumerate(mods))
            elif f.value.id in alias:
                yield from ((node.lineno, f.attr, "m:" + m, k, "call") for k, m in enumerate(alias[f.value.id][0]))


def use_sites(files: DataFrame) -> DataFrame:
    """Files (path, text) -> (src, line, name, dst, said): verified uses, by the receiver; the first module that exists counts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, line, name, target, place, said) for p, t in zip(pdf["path"], pdf["text"]) if p.endswith(".py") for line, name, target, place, said in python_uses(p, t or "")]
            yield pd.DataFrame(rows, columns=["src", "line", "name", "target", "place", "said"])

    said = files.select("path", "text").mapInPandas(run, USES)
    known = E.address_table(files).groupBy("target").agg(F.min("dst").alias("dst"))
    return said.join(large(known), "target").groupBy("src", "line", "name", "said").agg(F.min_by("dst", "place").alias("dst")).where("src <> dst")


def inferred_sites(lines: DataFrame, symbols: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (src, dst) in other languages: lines of src that hold a name which dst defines, as a whole word."""
    names = symbols.select(F.col("file").alias("dst"), F.element_at(F.split("name", "[.]"), -1).alias("name")).distinct().join(large(pairs), "dst")
    words = lines.select(F.col("file").alias("src"), "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    return words.join(large(names), ["src", "name"]).select("src", "line", "name", "dst", F.lit("inferred").alias("said"))


def file_links(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Go to definition: (src, line, name) -> (dst, at)."""
    s = symbols.select(F.col("file").alias("dst"), F.col("name").alias("full"), F.col("line").alias("at"))
    exact = (F.col("full") == F.col("name")) | F.col("full").endswith(F.concat(F.lit("."), F.col("name")))
    return sites.join(large(s), "dst").where(exact).groupBy("src", "line", "name", "dst").agg(F.min("at").alias("at"))


def hop_symbols(sites: DataFrame, most: int = 4) -> DataFrame:
    """What carries each hop (src, dst): names by verified before inferred, then count, then name, with the first line."""
    by = sites.groupBy("src", "dst", "name").agg(F.max((F.col("said") != "inferred").cast("int")).alias("sure"), F.count("*").alias("n"), F.min("line").alias("line"))
    w = Window.partitionBy("src", "dst").orderBy(F.col("sure").desc(), F.col("n").desc(), "name")
    return by.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def snippet(text: str, line: int, height: int = 22) -> tuple[int, str]:
    """A window of lines around a line: its first number and its text."""
    lines = text.splitlines()
    lo = max(0, min(line - 1 - height // 2, len(lines) - height))
    return lo + 1, "\n".join(lines[lo : lo + height])


def oriented(path: list[str], edges: set[tuple[str, str]]) -> dict:
    """How a path's hops point: turned round if all point backwards; of mixed ones, where they meet and whether that is called or calls."""
    ways = [1 if (a, b) in edges else -1 if (b, a) in edges else 0 for a, b in zip(path, path[1:])]
    if any(w < 0 for w in ways) and not any(w > 0 for w in ways):
        return {"path": path[::-1], "chain": True, "meet": None, "kind": None}
    if any(w < 0 for w in ways):
        k = next(i for i in range(1, len(ways)) if ways[i] and ways[i - 1] and ways[i] != ways[i - 1]) if any(ways[i] * ways[i - 1] < 0 for i in range(1, len(ways))) else 1
        return {"path": path, "chain": False, "meet": path[k], "kind": "callee" if ways[k - 1] > 0 else "caller"}
    return {"path": path, "chain": True, "meet": None, "kind": None}


def community_labels(names: dict[int, list[str]], model=None, known: dict[int, str] | None = None) -> dict[int, str]:
    """Labels by a model's 'n: label' lines where it gives them, what was known before, or a number; fails open."""
    out = {k: f"Community {k}" for k in names} | (known or {})
    try:
        reply = model("\n".join(f"{k}: {', '.join(v[:8])}" for k, v in sorted(names.items()))) if model else ""
    except Exception:
        reply = ""
    for m in re.finditer(r"(?m)^\s*(\d+)\s*[:.)-]\s*(.+?)\s*$", reply or ""):
        if int(m[1]) in names:
            out[int(m[1])] = m[2]
    return out
