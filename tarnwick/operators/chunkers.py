"""Chunkers: a file's text to chunks, symbols and a skeleton.

A strategy is any object with ``exts`` and ``chunk(path, text)``.  parsed() runs strategies over a
corpus in one pass of mapInPandas, a file at a time; children() turns the result into relations.
Chunks are an exact partition of a file's lines: see corpus.partition_violations.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.params import DEFAULTS

#: What the parser raises for a text it can't read; one nested too deeply for its stack is a MemoryError.
UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)

RESULT = (
    "path string, sha string, parse_ok boolean, total_lines int, skeleton string, "
    "chunks array<struct<kind:string,name:string,part:string,start_line:int,end_line:int,text:string,breadcrumb:string>>, "
    "symbols array<struct<name:string,kind:string,line:int,end_line:int,signature:string,decorators:array<string>,doc:string>>"
)


@dataclass
class Unit:
    """A run of lines that should stay together: lines lo to hi, from 1."""

    lo: int
    hi: int
    kind: str
    name: str = ""
    inner: list["Unit"] = field(default_factory=list)  # where an oversized unit may be cut


@dataclass
class Parsed:
    units: list[Unit]
    symbols: list[dict]
    skeleton: str
    ok: bool = True


def weight(lines: list[str]) -> int:
    """Characters that aren't white space."""
    return sum(len("".join(x.split())) for x in lines)


def totals(lines: list[str]) -> list[int]:
    """Weights of the lines summed up from 0, so that the weight of any run is one subtraction."""
    return [0, *accumulate(weight([x]) for x in lines)]


def line_windows(lines: list[str], lo: int, hi: int, budget: int) -> list[tuple[int, int]]:
    """Greedy windows of lines lo to hi within the budget; a line over the budget stands alone."""
    out, start, size = [], lo, 0
    for k in range(lo, hi + 1):
        n = weight([lines[k - 1]])
        if k > start and size + n > budget:
            out.append((start, k - 1))
            start, size = k, 0
        size += n
    return [*out, (start, hi)] if start <= hi else out


def covering(units: list[Unit], total: int) -> list[Unit]:
    """Units stretched over all lines: a gap belongs to the next unit, what follows the last to it."""
    out, at = [], 1
    for u in sorted(units, key=lambda u: u.lo):
        if u.hi < at:
            continue
        out.append(Unit(at, u.hi, u.kind, u.name, u.inner))
        at = u.hi + 1
    if out:
        out[-1].hi = total
    elif total:
        out = [Unit(1, total, "lines")]
    return out


def packed(units: list[Unit], lines: list[str], budget: int) -> list[dict]:
    """Chunks of the units: small neighbours are merged, an oversized unit is cut at its inner units, or else by lines."""
    out: list[dict] = []
    held: list[Unit] = []
    total = totals(lines)

    def flush() -> None:
        if held:
            named = [u.name for u in held if u.name]
            kind = held[0].kind if len({u.kind for u in held}) == 1 else "block"
            out.append({"kind": kind, "name": ", ".join(named), "part": "", "start_line": held[0].lo, "end_line": held[-1].hi})
            held.clear()

    for u in units:
        size = total[u.hi] - total[u.lo - 1]
        if held and total[u.hi] - total[held[0].lo - 1] > budget:
            flush()
        if size <= budget:
            held.append(u)
            continue
        flush()
        cuts: list[tuple[int, int]] = []
        if u.inner:
            inner = [Unit(max(x.lo, u.lo), x.hi, x.kind, x.name) for x in u.inner]
            inner = [Unit(x.lo + u.lo - 1, x.hi + u.lo - 1, x.kind, x.name) for x in covering([Unit(x.lo - u.lo + 1, x.hi - u.lo + 1, x.kind, x.name) for x in inner], u.hi - u.lo + 1)]
            run: list[Unit] = []
            for x in inner:
                if run and total[x.hi] - total[run[0].lo - 1] > budget:
                    cuts.append((run[0].lo, run[-1].hi))
                    run = []
                if total[x.hi] - total[x.lo - 1] > budget:
                    cuts += line_windows(lines, x.lo, x.hi, budget)
                else:
                    run.append(x)
            if run:
                cuts.append((run[0].lo, run[-1].hi))
        else:
            cuts = line_windows(lines, u.lo, u.hi, budget)
        out += [{"kind": u.kind, "name": u.name, "part": f"{k}/{len(cuts)}" if len(cuts) > 1 else "", "start_line": a, "end_line": b} for k, (a, b) in enumerate(cuts, 1)]
    flush()
    return out


class PythonChunker:
    """Top-level statements by the standard parser; a file it can't read is cut by lines."""

    exts = ("py", "pyi")

    def parse(self, path: str, text: str) -> Parsed:
        try:
            return self._parsed(path, ast.parse(text))
        except UNPARSED:
            return Parsed([], [], f"# {path}", ok=False)

    def _parsed(self, path: str, tree: ast.Module) -> Parsed:
        units, symbols, doc = [], [], (ast.get_docstring(tree) or "").split("\n")[0]
        skeleton = [f"# {path}"] + ([doc] if doc else [])
        for node in tree.body:
            lo = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            kind = "class" if isinstance(node, ast.ClassDef) else "function" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else "code"
            inner = [Unit(min([x.lineno, *(d.lineno for d in getattr(x, "decorator_list", []))]), x.end_lineno, "code") for x in getattr(node, "body", []) if kind != "code"]
            units.append(Unit(lo, node.end_lineno, kind, getattr(node, "name", ""), inner))
            self._symbols(node, "", symbols, skeleton)
        return Parsed(units, symbols, "\n".join(skeleton))

    def _symbols(self, node: ast.AST, prefix: str, out: list[dict], skeleton: list[str]) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else ("async_" if isinstance(node, ast.AsyncFunctionDef) else "") + ("method" if prefix else "function")
            if is_class:
                sign = f"class {node.name}" + (f"({', '.join(ast.unparse(b) for b in node.bases)})" if node.bases else "")
            else:
                sign = f"{'async ' if kind.startswith('async') else ''}def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
            doc = (ast.get_docstring(node) or "").split("\n")[0]
            lo = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append({"name": prefix + node.name, "kind": kind, "line": lo, "end_line": node.end_lineno, "signature": sign, "decorators": [ast.unparse(d) for d in node.decorator_list], "doc": doc})
            skeleton.append("    " * prefix.count(".") + sign + (f"  # {doc}" if doc else ""))
            if is_class:
                for x in node.body:
                    self._symbols(x, prefix + node.name + ".", out, skeleton)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                if isinstance(t, ast.Name):
                    out.append({"name": prefix + t.id, "kind": "class_attr" if prefix else "constant", "line": node.lineno, "end_line": node.end_lineno, "signature": t.id, "decorators": [], "doc": ""})
                    if not prefix and (t.id.isupper() or t.id.startswith("_")):
                        skeleton.append(t.id)


@dataclass(frozen=True)
class Brace:
    """How declarations of a language with braces (or end) look: patterns with a group ``name``, tried on each top-level line."""

    exts: tuple[str, ...]
    decls: tuple[tuple[str, str], ...]  # (kind, pattern)
    comment: str = r"//.*|/\*.*?\*/"
    ends: bool = False  # blocks close with ``end``


# Declarations by language.
TS = Brace(("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), (
    ("function", r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"), ("class", r"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
    ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>[\w$]+)"), ("type", r"^\s*(?:export\s+)?(?:type|enum)\s+(?P<name>[\w$]+)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)"),
    ("constant", r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)"), ("function", r"^\s*(?P<name>[\w$]+\.[\w$.]+)\s*=\s*(?:async\s+)?function\b"),
    ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(?P<name>[\w$]+)\s*\([^;]*\)\s*(?::[^{;]+)?\{\s*$")))
GO = Brace(("go",), (("method", r"^func\s+\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("type", r"^type\s+(?P<name>\w+)"), ("constant", r"^(?:const|var)\s+(?P<name>\w+)")))
RUST = Brace(("rs",), (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?P<name>[\w:<>, ]+?)\s*(?:\{|where|$)"), ("constant", r"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<name>\w+)"), ("module", r"^(?:pub\s+)?mod\s+(?P<name>\w+)")))
PHP = Brace(("php",), (("class", r"^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait|enum)\s+(?P<name>\w+)"), ("function", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+)*function\s+&?(?P<name>\w+)"), ("constant", r"^\s*const\s+(?P<name>\w+)")), r"//.*|#(?!\[).*|/\*.*?\*/")
RUBY = Brace(("rb",), (("class", r"^\s*class\s+(?P<name>[\w:]+)"), ("module", r"^\s*module\s+(?P<name>[\w:]+)"), ("method", r"^\s*def\s+(?P<name>[\w.?!=]+)"), ("constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]+)\s*=")), r"#.*", True)
OPENS = re.compile(r"^\s*(class|module|def|if|unless|case|while|until|begin|for)\b|\bdo\b(\s*\|[^|]*\|)?\s*$")
STRING = re.compile(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`""")


class BraceChunker:
    """Declarations and blocks found by scanning lines; grammars need not be installed."""

    def __init__(self, spec: Brace):
        self.spec, self.exts = spec, spec.exts
        self.decls = [(k, re.compile(p)) for k, p in spec.decls]
        self.comment = re.compile(spec.comment)

    def _depths(self, lines: list[str]) -> list[tuple[int, int]]:
        """Depth of blocks before and after each line."""
        out, depth = [], 0
        for x in lines:
            bare = self.comment.sub("", STRING.sub('""', x))
            if self.spec.ends:
                opened = 0 if re.search(r"\bend\b", bare) and OPENS.search(bare) else int(bool(OPENS.search(bare))) - int(bool(re.match(r"\s*end\b", bare)))
            else:
                opened = bare.count("{") + bare.count("(") + bare.count("[") - bare.count("}") - bare.count(")") - bare.count("]")
            out.append((depth, max(0, depth + opened)))
            depth = out[-1][1]
        return out

    def parse(self, path: str, text: str) -> Parsed:
        lines = text.splitlines()
        depths = self._depths(lines)
        found: list[dict] = []
        for k, x in enumerate(lines):
            for kind, rx in self.decls:
                if m := rx.match(x):
                    end = next((j for j in range(k, len(lines)) if depths[j][1] <= depths[k][0] and (j > k or depths[k][1] <= depths[k][0])), len(lines) - 1)
                    found.append({"kind": kind, "name": m["name"], "lo": k + 1, "hi": end + 1, "depth": depths[k][0], "sig": re.split(r"\s*\{\s*$", x.strip())[0]})
                    break
        units, symbols, skeleton = [], [], [f"# {path}"]
        stack: list[dict] = []
        for d in found:
            while stack and stack[-1]["hi"] < d["lo"]:
                stack.pop()
            if stack and stack[-1]["kind"] in ("function", "method"):
                continue  # local names aren't symbols
            kind = "method" if d["kind"] == "function" and stack and stack[-1]["kind"] in ("class", "impl", "interface") else d["kind"]
            name = ".".join([*(s["name"] for s in stack), d["name"]])
            symbols.append({"name": name, "kind": kind, "line": d["lo"], "end_line": d["hi"], "signature": d["sig"], "decorators": [], "doc": ""})
            skeleton.append("    " * len(stack) + d["sig"])
            if not stack:
                units.append(Unit(d["lo"], d["hi"], kind, d["name"]))
            elif len(stack) == 1:
                units[-1].inner.append(Unit(d["lo"], d["hi"], kind, d["name"]))
            if d["kind"] not in ("constant", "type"):
                stack.append(d)
        return Parsed(units, symbols, "\n".join(skeleton))


class MarkdownChunker:
    """Cuts at the best line near the budget: headings first, then fences, paragraphs and blank lines; never inside a fence or front matter."""

    exts = ("md", "mdx", "markdown", "rst", "txt")
    HEAD = re.compile(r"^(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
    # How good a line is to begin a chunk.
    FENCE_SCORE, PARAGRAPH_SCORE, BLANK_SCORE, PLAIN_SCORE = 80, 20, 5, 1

    def scan(self, lines: list[str]) -> tuple[list[int], list[dict], int]:
        """Score of each line as a cut (0: not allowed), headings, and lines of front matter."""
        scores, heads, fence, front = [], [], False, 0
        if lines and lines[0].strip() == "---":
            front = next((k + 1 for k in range(1, len(lines)) if lines[k].strip() == "---"), 0)
        for k, x in enumerate(lines):
            if k < front:
                scores.append(0)
            elif re.match(r"\s*(```|~~~)", x):
                scores.append(0 if fence else self.FENCE_SCORE)
                fence = not fence
            elif fence:
                scores.append(0)
            elif m := self.HEAD.match(x):
                scores.append(110 - 10 * len(m[1]))
                heads.append({"line": k + 1, "level": len(m[1]), "title": m[2]})
            elif not x.strip():
                scores.append(self.BLANK_SCORE)
            else:
                scores.append(self.PARAGRAPH_SCORE if k and not lines[k - 1].strip() else self.PLAIN_SCORE)
        return scores, heads, front

    def cuts(self, lines: list[str], scores: list[int], target: int) -> list[tuple[int, int]]:
        """Windows of lines: of the allowed cuts within half the target around it, the one with the best score, then nearest, then first."""
        half, out, lo, total = target // 2, [], 0, totals(lines)
        while lo < len(lines):
            if total[-1] - total[lo] <= target + half:
                out.append((lo + 1, len(lines)))
                break
            best, hard = None, None
            for k in range(lo, len(lines)):
                size = total[k] - total[lo]
                if k > lo and scores[k]:
                    if target - half <= size <= target + half and (best is None or (scores[k], -abs(size - target)) > best[0]):
                        best = ((scores[k], -abs(size - target)), k)
                    if size >= target and hard is None:
                        hard = k
                if size > target + half and (best or hard):
                    break
            at = best[1] if best else hard
            if at is None:
                out.append((lo + 1, len(lines)))
                break
            out.append((lo + 1, at))
            lo = at
        return out

    def chunk(self, path: str, text: str, budget: int) -> dict:
        lines = text.splitlines()
        scores, heads, front = self.scan(lines)
        title = next((m[1].strip("\"' ") for x in lines[1 : front - 1] if (m := re.match(r"title:\s*(.*)", x))), path)
        for i, h in enumerate(heads):
            h["end"] = next((o["line"] - 1 for o in heads[i + 1 :] if o["level"] <= h["level"]), len(lines))

        def crumb(line: int) -> str:
            return " > ".join([title, *(h["title"] for h in heads if h["line"] <= line <= h["end"])])

        chunks = []
        for a, b in self.cuts(lines, scores, budget):
            first = next((h for h in heads if a <= h["line"] <= b), None)
            chunks.append({"kind": "section" if first else "doc", "name": first["title"] if first else "", "part": "", "start_line": a, "end_line": b, "text": "\n".join(lines[a - 1 : b]), "breadcrumb": crumb(first["line"] if first and first["line"] == a else a)})
        symbols = [{"name": h["title"], "kind": "heading", "line": h["line"], "end_line": h["end"], "signature": "#" * h["level"] + " " + h["title"], "decorators": [], "doc": ""} for h in heads]
        return {"parse_ok": True, "total_lines": len(lines), "skeleton": "\n".join([f"# {path}", *("  " * (h["level"] - 1) + h["title"] for h in heads)]), "chunks": chunks, "symbols": symbols}


@cache
def builtin() -> list:
    from tarnwick.operators.php import PhpChunker  # it builds on this module

    return [PythonChunker(), BraceChunker(TS), BraceChunker(GO), BraceChunker(RUST), PhpChunker(), BraceChunker(RUBY), MarkdownChunker()]


def strategy_for(path: str, own: list | None = None):
    """The first strategy with the path's extension, the caller's before the built-in ones."""
    ext = path.rpartition(".")[2].lower()
    return next((s for s in [*(own or []), *builtin()] if ext in s.exts), None)


def by_units(path: str, text: str, p: Parsed, budget: int) -> dict:
    """Chunks of a parsed file: its units, merged and cut to the budget."""
    lines = text.splitlines()
    units = covering(p.units, len(lines)) if p.ok else [Unit(a, b, "lines") for a, b in line_windows(lines, 1, len(lines), budget)]
    chunks = packed(units, lines, budget) if p.ok else [{"kind": u.kind, "name": "", "part": "", "start_line": u.lo, "end_line": u.hi} for u in units]
    for c in chunks:
        c["text"] = "\n".join(lines[c["start_line"] - 1 : c["end_line"]])
        c["breadcrumb"] = path + (f" > {c['name']}" if c["name"] else "")
    return {"parse_ok": p.ok, "total_lines": len(lines), "skeleton": p.skeleton, "chunks": chunks, "symbols": p.symbols}


def chunk_file(path: str, text: str, strategy, budget: int = DEFAULTS.chunk_budget) -> dict:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out = strategy.chunk(path, text, budget) if hasattr(strategy, "chunk") else by_units(path, text, strategy.parse(path, text), budget)
    return {"path": path, "sha": hashlib.sha256(text.encode()).hexdigest(), **out}


def arrow(**types: str) -> pa.StructType:
    return pa.struct([(n, {"string": pa.string(), "int": pa.int32(), "strings": pa.list_(pa.string())}[t]) for n, t in types.items()])


#: RESULT as Arrow has it, and files whose results a task holds at once.
CHUNK = arrow(kind="string", name="string", part="string", start_line="int", end_line="int", text="string", breadcrumb="string")
SYMBOL = arrow(name="string", kind="string", line="int", end_line="int", signature="string", decorators="strings", doc="string")
ARROW = pa.schema([("path", pa.string()), ("sha", pa.string()), ("parse_ok", pa.bool_()), ("total_lines", pa.int32()), ("skeleton", pa.string()), ("chunks", pa.list_(CHUNK)), ("symbols", pa.list_(SYMBOL))])
AT_ONCE = 500


def parsed(files: DataFrame, own: list | None = None, budget: int = DEFAULTS.chunk_budget) -> DataFrame:
    """files (path, text) -> RESULT, for files that some strategy takes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, AT_ONCE) for whole in it for at in range(0, whole.num_rows, AT_ONCE)):
            rows = [chunk_file(p, t or "", s, budget) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := strategy_for(p, own))]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select("path", "text").mapInArrow(run, RESULT)


def children(done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (path, sha, skeleton), chunks and symbols of parsed(); keep done, since each reads it."""
    files = done.select("path", "sha", "skeleton")
    chunks = done.select(F.col("path").alias("file"), F.inline("chunks"))
    ids = chunks.withColumn("id", F.xxhash64("file", "start_line"))
    symbols = done.select(F.col("path").alias("file"), F.inline("symbols"))
    return files, ids, symbols
