"""PHP files: page scripts by their sections, all others by their declarations.

A page script mixes statements, functions and HTML in one file.  Scanning declarations alone
would lump what lies between them together, so there declarations stand alone with the comments
over them, and the rest is cut at ruled comments (``//-------``), which may carry a title.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import pairwise

from tarnwick.operators import chunkers as C

# Ruled comments, titles under them, sizes and scores of sections.
RULE = re.compile(r"^\s*(?://|#|/\*+)\s*[-=*#~_─═]{8,}")
TITLE = re.compile(r"^\s*(?://|#|\*)\s*([A-Za-z0-9(\[].{2,70}?)\s*(?:\*/)?\s*$")
TITLE_WITHIN = 6
SECTION_LEAST = 400
RULE_SCORE, HTML_SCORE, STATEMENT_SCORE, BLANK_SCORE, PLAIN_SCORE = 85, 90, 20, 5, 1
HTML_SHARE = 0.6
LEGACY_STATEMENTS, LEGACY_ISLANDS = 3, 2

ALONE = ("function", "class")
OPEN = re.compile(r"<\?(?:php\b|=)?")
TOKEN = re.compile(
    r"(?P<close>\?>)"
    r"|(?P<comment>/\*.*?(?:\*/|\Z)|(?://|#(?!\[))(?:(?!\?>)[^\n])*)"
    r"|(?P<text><<<[ \t]*['\"]?(?P<mark>\w+)['\"]?\n.*?^[ \t]*(?P=mark)\b|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`)"
    r"|(?P<up>[{(\[])|(?P<down>[})\]])|(?P<stop>;)|(?P<word>\w+)|(?P<other>[^\s\w])", re.S | re.M)


@dataclass
class Layout:
    """What each line (from 0) holds, and what stands at the top level of a file."""

    html: list[bool]  # part of an island of HTML between statements
    code: list[bool]
    comment: list[bool]
    starts: set[int] = field(default_factory=set)  # lines on which a statement begins
    islands: list[int] = field(default_factory=list)  # lines on which an island begins
    heads: list[tuple[int, str]] = field(default_factory=list)  # (line, first word) of each statement
    titles: dict[int, str] = field(default_factory=dict)  # by the ruled comment (from 1) over them


def layout(text: str) -> Layout:
    """One pass over the text, in and out of PHP; strings and comments open and close nothing."""
    lines = text.splitlines()
    total = len(lines)
    out = Layout(*([False] * total for _ in range(3)))
    out.titles = {k: m[1].strip() for k, (x, y) in enumerate(pairwise(lines), 1) if RULE.match(x) and not RULE.match(y) and (m := TITLE.match(y))}
    at, line, depth, fresh = 0, 0, 0, True

    def mark(flags: list[bool], piece: str) -> None:
        for k, x in enumerate(piece.split("\n")):
            if x.strip() and line + k < total:
                flags[line + k] = True

    while at < len(text):
        m = OPEN.search(text, at)
        island = text[at : m.start() if m else len(text)]
        if island.strip():
            lead = len(island) - len(island.lstrip())
            if depth == 0:
                out.islands.append(line + island.count("\n", 0, lead))
                mark(out.html, island)
                fresh = True
            else:
                mark(out.code, island)
        line += island.count("\n")
        if not m:
            break
        at = m.end()
        while at < len(text):
            t = TOKEN.search(text, at)
            if not t:
                line, at = line + text.count("\n", at), len(text)
                break
            line += text.count("\n", at, t.start())
            at, kind, piece = t.end(), t.lastgroup if t.lastgroup != "mark" else "text", t.group()
            if kind == "close":
                fresh = fresh or depth == 0
                break
            if kind == "comment":
                mark(out.comment, piece)
            else:
                mark(out.code, piece)
                if fresh and depth == 0 and kind not in ("stop", "down"):
                    out.starts.add(line)
                    out.heads.append((line, piece.lower() if kind == "word" else ""))
                depth = max(0, depth + (kind == "up") - (kind == "down"))
                fresh = depth == 0 and (kind == "stop" or piece == "}")
            line += piece.count("\n")
    return out


def is_page_script(seen: Layout, units: list[C.Unit]) -> bool:
    """No namespace, and a function, three statements or two islands of HTML at the top level."""
    if any(word == "namespace" for _, word in seen.heads):
        return False
    inside = {k for u in units for k in range(u.lo - 1, u.hi)}
    statements = sum(k not in inside for k, _ in seen.heads) + len(seen.islands)
    return any(u.kind == "function" for u in units) or statements >= LEGACY_STATEMENTS or len(seen.islands) >= LEGACY_ISLANDS


class PhpChunker:
    """Routes a file by its shape: page scripts to sections, others to their declarations."""

    exts = ("php",)

    def __init__(self):
        self.plain = C.BraceChunker(C.PHP)

    def chunk(self, path: str, text: str, budget: int) -> dict:
        p, seen = self.plain.parse(path, text), layout(text)
        if not text or not is_page_script(seen, p.units):
            return C.by_units(path, text, p, budget)
        lines = text.splitlines()
        chunks: list[dict] = []
        at = 1
        for u in sorted((u for u in p.units if u.kind in ALONE), key=lambda u: u.lo):
            if u.lo < at:
                continue
            lo = self._head(seen, u.lo, at)
            chunks += self._flow(path, lines, seen, at, lo - 1, budget) if lo > at else []
            own = C.packed([C.Unit(lo, u.hi, u.kind, u.name, u.inner)], lines, budget)
            sig = lines[u.lo - 1].strip().rstrip("{").rstrip()
            chunks += [{**c, "breadcrumb": f"{path} > {sig}"} for c in own]
            at = u.hi + 1
        chunks += self._flow(path, lines, seen, at, len(lines), budget) if at <= len(lines) else []
        for c in chunks:
            c["text"] = "\n".join(lines[c["start_line"] - 1 : c["end_line"]])
        sections = [{"name": c["name"], "kind": "heading", "line": c["start_line"], "end_line": c["end_line"], "signature": f"// {c['name']}", "decorators": [], "doc": ""} for c in chunks if c["kind"] in ("module", "html") and c["name"]]
        symbols = sorted([*p.symbols, *sections], key=lambda s: s["line"])
        skeleton = "\n".join([f"# {path}", *("    " * ("." in s["name"] and s["kind"] != "heading") + s["signature"] for s in symbols)])
        return {"parse_ok": True, "total_lines": len(lines), "skeleton": skeleton, "chunks": chunks, "symbols": symbols}

    def _head(self, seen: Layout, lo: int, least: int) -> int:
        """First line of the comments right over line lo, blank lines between them included."""
        top, k = lo, lo - 1
        while k >= least and not seen.code[k - 1] and not seen.html[k - 1]:
            if seen.comment[k - 1]:
                top = k
            k -= 1
        return top

    def _flow(self, path: str, lines: list[str], seen: Layout, lo: int, hi: int, budget: int) -> list[dict]:
        """Lines lo to hi in sections: at ruled comments that follow enough code, and within the budget."""
        total = C.totals(lines)
        cuts, first, before = [], lo, False  # before: the last line with anything on it was a comment
        for k in range(lo, hi + 1):
            if RULE.match(lines[k - 1]) and seen.comment[k - 1] and not before and total[k - 1] - total[first - 1] >= SECTION_LEAST:
                cuts.append((first, k - 1))
                first = k
            if lines[k - 1].strip():
                before = seen.comment[k - 1] and not seen.code[k - 1] and not seen.html[k - 1]
        out = []
        for a, b in [*cuts, (first, hi)]:
            pieces = [(a, b)]
            if total[b] - total[a - 1] > budget:
                scores = [self._score(lines, seen, k) for k in range(a, b + 1)]
                pieces = [(x + a - 1, y + a - 1) for x, y in C.MarkdownChunker().cuts(lines[a - 1 : b], scores, budget)]
            out += [self._section(path, lines, seen, x, y) for x, y in pieces]
        return out

    def _score(self, lines: list[str], seen: Layout, k: int) -> int:
        if k - 1 in seen.islands:
            return HTML_SCORE
        if RULE.match(lines[k - 1]):
            return RULE_SCORE
        if k - 1 in seen.starts:
            return STATEMENT_SCORE
        return PLAIN_SCORE if lines[k - 1].strip() else BLANK_SCORE

    def _section(self, path: str, lines: list[str], seen: Layout, lo: int, hi: int) -> dict:
        title = next((seen.titles[k] for k in range(lo, min(lo + TITLE_WITHIN, hi)) if k in seen.titles), "")
        html = C.weight([lines[k - 1] for k in range(lo, hi + 1) if seen.html[k - 1]])
        kind = "html" if html > HTML_SHARE * max(1, C.weight(lines[lo - 1 : hi])) else "module"
        where = f" > [{title}]" if title else f" ({'html' if kind == 'html' else 'module level'})"
        return {"kind": kind, "name": title, "part": "", "start_line": lo, "end_line": hi, "breadcrumb": path + where}
