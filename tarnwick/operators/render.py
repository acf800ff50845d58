"""Bundles as text; takes rows that were collected for one query, which a bundle bounds."""

from __future__ import annotations

import re

from tarnwick.functions.text import FENCE

BODIES, WINDOW = 38_000, 800


def render_bundle(query: str, entries: list[dict]) -> str:
    """Core files with their chunks' text, related files as a map of one line each."""
    out = [f"# {query}", ""]
    for e in sorted(entries, key=lambda e: (e["tier"], e["place"])):
        if e["tier"] == 1:
            out.append(f"## {e['file']}  ({e['score']:.3f})")
            for c in e.get("chunks", []):
                out += [f"L{c['start_line']}-{c['end_line']}", f"```{FENCE.get(e['file'].rpartition('.')[2], '')}", c["text"], "```"]
        else:
            out.append(f"- {e['file']}" + {"graph": " (linked)", "floor": " (recall)", "flow": " (answered before)"}.get(e["via"], ""))
    return "\n".join(out)


def query_window(text: str, query: str, room: int) -> tuple[int, int]:
    """Lines (from 0, end exclusive) grown around the line that shares most with the query, within room characters."""
    lines = text.splitlines() or [""]
    asked = {w.lower() for w in re.findall(r"[A-Za-z]{4,}", query)}
    best = max(range(len(lines)), key=lambda k: (sum(len(w) for w in {x.lower() for x in re.findall(r"[A-Za-z]{4,}", lines[k])} & asked), -k))
    lo, hi, size = best, best + 1, len(lines[best])
    while True:
        grown = False
        for at in (lo - 1, hi):
            if 0 <= at < len(lines) and size + len(lines[at]) + 1 <= room:
                size += len(lines[at]) + 1
                lo, hi = min(lo, at), max(hi, at + 1)
                grown = True
        if not grown:
            return lo, hi


def render_pruned(query: str, chunks: list[dict], seen: set | None = None, budget: int = BODIES) -> str:
    """Chunks best first: whole while the budget lasts, then a window around the query, then a pointer; shown ids are only named."""
    out, left, seen = [], budget, set() if seen is None else seen
    for c in chunks:
        head = f"### {c['file']}:{c['start_line']}-{c['end_line']}"
        if c["id"] in seen:
            out.append(head + " (shown before)")
            continue
        text = c["text"]
        if len(text) > left:
            if left < WINDOW:
                out.append(head + " (read it for its body)")
                continue
            lo, hi = query_window(text, query, left)
            text = "\n".join(text.splitlines()[lo:hi])
            head = f"### {c['file']}:{c['start_line'] + lo}-{c['start_line'] + hi - 1}"
        seen.add(c["id"])
        left -= len(text)
        out.append(f"{head}\n```\n{text}\n```")
    return "\n".join(out)
