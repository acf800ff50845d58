"""Narration without a model: numbered candidates, citations spliced back verbatim, pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.text import FENCE, SEEN, SHOWN

SPAN = r"\s*[Ll]?\d+\s*(?:-\s*[Ll]?\d+\s*)?"
CITE = re.compile(rf"\[\[\s*(\d+)\s*(?::({SPAN}(?:,{SPAN})*))?\]\]")
PARTIAL = re.compile(r"\[(?:\[[^\]]*\]?)?$")
PAGE = 24_000
BODY = 200_000
SNAP, NARROW = 8, 70

#: A narrator takes a prompt and yields text; None stands for no model.
Narrator = Callable[[str], Iterator[str]]


def candidates(selection: DataFrame, budget: int = BODY) -> DataFrame:
    """selection (qid, id, file, start_line, end_line, text, role, score) numbered core first; bodies until the budget is spent, then without."""
    w = Window.partitionBy("qid").orderBy(F.when(F.col("role") == "core", 0).otherwise(1), F.col("score").desc(), "id")
    rows = selection.withColumns({"k": F.row_number().over(w), "used": F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.withColumn("text", F.when(F.col("used") <= budget, F.col("text"))).drop("used")


def numbered(text: str, first: int) -> str:
    return "\n".join(f"{first + i}: {x}" for i, x in enumerate(text.splitlines()))


def ranges(spec: str | None) -> list[tuple[int, int]]:
    out = []
    for part in re.sub(r"[Ll\s]", "", spec or "").split(","):
        if part:
            lo, _, hi = part.partition("-")
            out.append((int(lo), int(hi or lo)))
    return out


def snapped(lo: int, hi: int, symbols: list[dict]) -> tuple[int, int]:
    """A range drawn to the edges of a symbol that lie within SNAP lines of it."""
    for s in symbols:
        if abs(s["line"] - lo) <= SNAP and abs(s["end_line"] - hi) <= SNAP:
            return s["line"], s["end_line"]
    return lo, hi


def cite(k: int, spec: str | None, cands: list[dict], symbols: dict[str, list[dict]], claim: str, seen: set) -> str:
    """The code of a citation, verbatim; an unknown number vanishes, a span that was shown is only named."""
    if not 1 <= k <= len(cands):
        return ""
    c = cands[k - 1]
    own = symbols.get(c["file"], [])
    spans = [snapped(lo, hi, own) for lo, hi in ranges(spec)]
    if not spans:
        spans = [(c["start_line"], c["end_line"])]
        if c["end_line"] - c["start_line"] + 1 > NARROW:
            named = [s for s in own if c["start_line"] <= s["line"] and s["end_line"] <= c["end_line"] and s["name"].split(".")[-1] in claim]
            if named:
                spans = [(named[0]["line"], named[0]["end_line"])]
    out = []
    lines = c["text"].splitlines()
    for lo, hi in spans:
        lo, hi = max(lo, c["start_line"]), min(hi, c["end_line"])
        if lo > hi:
            continue
        where = f"{c['file']}:{lo}-{hi}"
        if (c["file"], lo, hi) in seen:
            out.append(SEEN.format(where=where))
            continue
        seen.add((c["file"], lo, hi))
        body = "\n".join(lines[lo - c["start_line"] : hi - c["start_line"] + 1])
        fence = "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", body)), default=0))
        out.append(f"\n{SHOWN.format(where=where)}\n{fence}{FENCE.get(c['file'].rpartition('.')[2], '')}\n{body}\n{fence}\n")
    return "".join(out)


def splice(text: str, cands: list[dict], symbols: dict[str, list[dict]] | None = None) -> str:
    """The answer with each citation replaced by its code."""
    seen: set = set()

    def put(m: re.Match) -> str:
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        return cite(int(m[1]), m[2], cands, symbols or {}, line, seen)

    return CITE.sub(put, text)


def cited_files(text: str, cands: list[dict]) -> list[str]:
    return list(dict.fromkeys(cands[int(m[1]) - 1]["file"] for m in CITE.finditer(text) if 1 <= int(m[1]) <= len(cands)))


class Splicer:
    """splice() over a stream: holds back only what may be the beginning of a citation."""

    def __init__(self, cands: list[dict], symbols: dict[str, list[dict]] | None = None):
        self.cands, self.symbols, self.seen, self.held, self.line = cands, symbols or {}, set(), "", ""

    def feed(self, piece: str) -> str:
        self.held += piece
        m = PARTIAL.search(self.held)
        ready, self.held = (self.held[: m.start()], self.held[m.start() :]) if m else (self.held, "")
        return self._out(ready)

    def close(self) -> str:
        ready, self.held = self.held, ""
        return self._out(ready)

    def _out(self, text: str) -> str:
        def put(m: re.Match) -> str:
            before = self.line + text[: m.start()]
            return cite(int(m[1]), m[2], self.cands, self.symbols, before.rpartition("\n")[2], self.seen)

        out = CITE.sub(put, text)
        self.line = (self.line + text).rpartition("\n")[2]
        return out


def paginate(text: str, size: int = PAGE) -> list[str]:
    """Pages of at most size characters; a code block is never cut, so one may be longer."""
    blocks, at = [], 0
    for m in re.finditer(r"(?ms)^(`{3,})[^\n]*\n.*?^\1\s*$\n?", text):
        blocks += [x + "\n" for x in text[at : m.start()].splitlines()] + [m[0]]
        at = m.end()
    blocks += [x + "\n" for x in text[at:].splitlines()]
    pages, page = [], ""
    for b in blocks:
        if page and len(page) + len(b) > size:
            pages.append(page)
            page = ""
        page += b
    return [*pages, page] if page else pages or [""]


def plan_by_directory(bundle: DataFrame, most: int = 4) -> DataFrame:
    """Work for agents: the files of each top directory together, the largest directories first, the rest with the last."""
    from tarnwick.functions.text import top_dir

    sizes = bundle.groupBy("qid", top_dir("file").alias("dir")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("file")).alias("files"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "dir"))
    return sizes.withColumn("agent", F.least(rank, F.lit(most))).groupBy("qid", "agent").agg(F.array_sort(F.flatten(F.collect_list("files"))).alias("files"))


def answer(question: str, cands: list[dict], narrator: Narrator | None, rendered: str, symbols: dict[str, list[dict]] | None = None) -> dict:
    """The narrated answer, or the rendered bundle where there is no model, it fails, or nothing was cited."""
    prompt = question + "\n\n" + "\n\n".join(f"[{k}] {c['file']}:{c['start_line']}-{c['end_line']}\n{numbered(c['text'], c['start_line'])}" for k, c in enumerate(cands, 1))
    try:
        text = "".join(narrator(prompt)) if narrator and cands else ""
    except Exception:
        text = ""
    files = cited_files(text, cands)
    return {"text": splice(text, cands, symbols), "files": files, "narrated": True} if files else {"text": rendered, "files": [], "narrated": False}
