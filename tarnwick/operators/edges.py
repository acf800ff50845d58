"""Dependency edges: raw mentions are extracted per file, then resolved by joins.

Every language yields candidates (src, seq, place, target, kind): targets of one mention in order of
preference.  resolve() joins them to what exists and keeps the first; self-edges and unresolved
mentions go.  No name is resolved by being unique alone.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.vectors import large
from tarnwick.operators.chunkers import UNPARSED

SCHEMA_VERSION = 3
MENTIONS = "src string, seq int, place int, target string, kind string"

#: Places of a module specifier in ECMAScript: after the from of an import or export, of a bare import, or as the one argument of require() or import().
TS_SPECIFIER = r"""(?P<quote>['"])(?P<said>[^'"\n]+)(?P=quote)"""
TS_IMPORT = re.compile(rf"""(?:\bfrom\s*|\bimport\s+|\bimport(?=['"])|\b(?:require|import)\s*\(\s*){TS_SPECIFIER}""")
# Source extensions by the extension of the module they are built to, and those a specifier may leave out, in the order they are tried.
BUILT_FROM = {".js": [".ts", ".tsx", ".d.ts", ".js", ".jsx"], ".jsx": [".tsx", ".jsx"], ".mjs": [".mts", ".mjs"], ".cjs": [".cts", ".cjs"]}
LEFT_OUT = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
RUBY_REQUIRE = re.compile(r"""^\s*(require_relative|require|autoload\s+:\w+\s*,)\s*\(?\s*['"]([^'"]+)['"]""", re.M)
PHP_USE = re.compile(r"^\s*use\s+(?!function|const)([\w\\]+)(?:\s*\{([^}]*)\})?", re.M)
PHP_NAMESPACE = re.compile(r"^\s*namespace\s+([\w\\]+)", re.M)
PHP_CLASS = re.compile(r"^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+(\w+)", re.M)
GO_IMPORT = re.compile(r'^\s*(?:import\s+)?(?:(\w+|\.|_)\s+)?"([^"]+)"\s*$', re.M)
GO_PACKAGE = re.compile(r"^package\s+(\w+)", re.M)
GO_DECL = re.compile(r"^(?:func\s+(\w+)|type\s+(\w+)|(?:const|var)\s+(\w+))", re.M)


def python_module(path: str) -> str:
    mod = path[:-3].replace("/", ".")
    mod = mod[4:] if mod.startswith("src.") else mod
    return mod[: -len(".__init__")] if mod.endswith(".__init__") else mod


def python_mentions(path: str, text: str) -> Iterator[tuple[int, str, str]]:
    """(place, target, kind) by mention: modules as ``m:`` names; calls only through an imported name."""
    try:
        tree = ast.parse(text)
    except UNPARSED:
        return
    own = python_module(path).split(".")
    package = own if path.endswith("__init__.py") else own[:-1]
    alias: dict[str, list[str]] = {}
    seq = 0
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                alias[a.asname or a.name.split(".")[0]] = ["m:" + a.name]
                yield seq, 0, "m:" + a.name, "import"
                seq += 1
        elif isinstance(node, ast.ImportFrom):
            base = ".".join([*package[: len(package) - node.level + 1], *([node.module] if node.module else [])]) if node.level else node.module or ""
            for a in node.names:
                options = [f"m:{base}.{a.name}" if base else f"m:{a.name}", f"m:{base}"]
                alias[a.asname or a.name] = options
                for k, o in enumerate(options):
                    yield seq, k, o, "import"
                seq += 1
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            while isinstance(f, (ast.Attribute, ast.Call, ast.Subscript)):
                f = f.func if isinstance(f, ast.Call) else f.value
            if isinstance(f, ast.Name) and f.id in alias:
                for k, o in enumerate(alias[f.id]):
                    yield seq, k, o, "call"
                seq += 1


def ts_mentions(path: str, text: str) -> Iterator[tuple[int, int, str, str]]:
    here = posixpath.dirname(path)
    for seq, m in enumerate(TS_IMPORT.finditer(text)):
        said = m["said"]
        if not said.startswith("."):
            continue
        at = posixpath.normpath(posixpath.join(here, said))
        stem, ext = posixpath.splitext(at)
        options = [*(stem + x for x in BUILT_FROM.get(ext, [])), at, *(at + x for x in LEFT_OUT), *(f"{at}/index{x}" for x in LEFT_OUT)]
        for k, o in enumerate(options):
            yield seq, k, "f:" + o, "import"


def ruby_mentions(path: str, text: str) -> Iterator[tuple[int, int, str, str]]:
    here = posixpath.dirname(path)
    for seq, m in enumerate(RUBY_REQUIRE.finditer(text)):
        name = m[2] if m[2].endswith(".rb") else m[2] + ".rb"
        if m[1] == "require_relative":
            options = ["f:" + posixpath.normpath(posixpath.join(here, name))]
        else:
            options = [f"f:lib/{name}", f"f:{name}", "f:" + posixpath.normpath(posixpath.join(here, name)), f"l:{name}"]
        for k, o in enumerate(options):
            yield seq, k, o, "import"


def php_mentions(path: str, text: str) -> Iterator[tuple[int, int, str, str]]:
    space = (m[1] if (m := PHP_NAMESPACE.search(text)) else "").strip("\\")
    seq = 0
    for m in PHP_USE.finditer(text):
        base = m[1].strip("\\")
        names = [f"{base}\\{x.split(' as ')[0].strip()}" for x in m[2].split(",") if x.strip()] if m[2] else [base]
        for n in names:
            yield seq, 0, "c:" + n, "import"
            yield seq, 1, "c:" + (f"{space}\\{n}" if space else n), "import"
            seq += 1


def go_mentions(path: str, text: str) -> Iterator[tuple[int, int, str, str]]:
    here = posixpath.dirname(path)
    bare = re.sub(r'"(?:\\.|[^"\\\n])*"|`[^`]*`|//[^\n]*|/\*.*?\*/', '""', text, flags=re.S)
    seq = 0
    for m in GO_IMPORT.finditer(text):
        name = m[1] if m[1] and m[1] not in "._" else posixpath.basename(m[2])
        for used in sorted(set(re.findall(rf"(?<![.\w]){re.escape(name)}\.(\w+)", bare))) or [""]:
            yield seq, 0, f"g:{m[2]}#{used}", "import"
            yield seq, 1, f"p:{m[2]}", "import"
            seq += 1
    package = (m[1] if (m := GO_PACKAGE.search(text)) else "")
    own = {x for t in GO_DECL.findall(bare) for x in t if x}
    for name in sorted(set(re.findall(r"(?<![.\w])([A-Za-z_]\w*)", bare)) - own):
        yield seq, 0, f"s:{here}#{package}#{name}", "call"
        seq += 1


BY_EXT = {"py": python_mentions, **dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), ts_mentions), "rb": ruby_mentions, "php": php_mentions, "go": go_mentions}


def addresses(path: str, text: str) -> Iterator[str]:
    """Names under which a file can be mentioned."""
    yield "f:" + path
    ext = path.rpartition(".")[2]
    if ext == "py":
        yield "m:" + python_module(path)
    elif ext == "rb":
        parts = path.split("/lib/")
        if len(parts) > 1:
            yield "l:" + path.split("/lib/", 1)[1]
    elif ext == "php":
        space = (m[1] if (m := PHP_NAMESPACE.search(text)) else "").strip("\\")
        for c in PHP_CLASS.findall(text):
            yield "c:" + (f"{space}\\{c}" if space else c)
    elif ext == "go" and (m := GO_PACKAGE.search(text)):
        here = posixpath.dirname(path)
        names = [x for t in GO_DECL.findall(text) for x in t if x]
        segments = here.split("/")
        for k in range(len(segments)):  # an import path may end with any suffix of the directory
            tail = "/".join(segments[k:])
            yield f"p:{tail}"
            yield from (f"g:{tail}#{n}" for n in names)
        yield from (f"s:{here}#{m[1]}#{n}" for n in names)


def mentions(files: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, seq, place, target, kind) for p, t in zip(pdf["path"], pdf["text"]) if (f := BY_EXT.get(p.rpartition(".")[2])) for seq, place, target, kind in f(p, t or "")]
            yield pd.DataFrame(rows, columns=["src", "seq", "place", "target", "kind"])

    return files.select("path", "text").mapInPandas(run, MENTIONS)


def address_table(files: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(a, p) for p, t in zip(pdf["path"], pdf["text"]) for a in addresses(p, t or "")], columns=["target", "dst"])

    return files.select("path", "text").mapInPandas(run, "target string, dst string")


def resolve(said: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (src, dst, kind): the first candidate of each mention that exists; of several files under one name the first by path.

    Go import paths are tried by each suffix, the longest first, as a repository does not say its module root.
    """
    go = said.where(F.col("target").rlike("^[gp]:"))
    path, rest = F.regexp_extract("target", "^[gp]:([^#]*)", 1), F.regexp_extract("target", "(#.*)?$", 0)
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.substring("target", 1, 2), F.array_join(F.slice(parts, i, F.size(parts)), "/"), rest))
    go = go.select("src", "seq", F.posexplode(tails).alias("k", "target"), "kind", "place").select("src", "seq", (F.col("place") * 100 + F.col("k")).cast("int").alias("place"), "target", "kind")
    all_ = said.where(~F.col("target").rlike("^[gp]:")).select("src", "seq", (F.col("place") * 100).cast("int").alias("place"), "target", "kind").unionByName(go)
    first = known.groupBy("target").agg(F.min("dst").alias("dst"))
    hit = all_.join(large(first), "target").groupBy("src", "seq", "kind").agg(F.min_by("dst", F.struct("place", "dst")).alias("dst"))
    return hit.where("src <> dst").select("src", "dst", "kind").distinct()


def edges(files: DataFrame) -> DataFrame:
    return resolve(mentions(files), address_table(files))
