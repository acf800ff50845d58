"""Plain versions of the operators, and small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, size int, shard int, n long, id string, items int"


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["an", "er", "la", "ti", "o", "sé", "Qu", "is"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Near and exact copies, shared passages, nulls, empty, short, repeated and very long texts."""
    r = random.Random(seed)
    passage = prose(r, 60)
    texts: list[tuple[int | None, str | None]] = []
    for k in range(12):
        base = prose(r, 120).split(" ")
        for c in range(3):
            w = list(base)
            for _ in range(c * 2):
                w[r.randrange(len(w))] = prose(r, 1)
            texts.append((100 + k * 10 + c, " ".join(w)))
    texts += [(300 + k, prose(r, 30) + " " + passage + " " + prose(r, 30)) for k in range(5)]
    texts += [(400, passage), (401, passage), (402, passage.upper()), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "one two three four"), (6, "one two three four"), (7, "a b c d e"), (8, "a b c d e f")]
    texts += [(9, "ab" * 400), (10, "ab" * 300), (11, "z" * 250), (12, prose(r, 30_000)), (None, prose(r, 40)), (None, None), (13, passage[:150] + passage[:150]), (14, "\U0001F600 é\x00 \x85   end")]
    rows = [(i, t, r.choice(["en", "fr", "de", None]), r.choice(["b", "a", "é", None]), 1, 0.5, "s", 3, 4, 5, "i", 6) for i, t in texts]
    return rows + [rows[0], rows[40], rows[0]]


class Union:
    def __init__(self):
        self.p: dict = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(rows: list[tuple]) -> dict:
    u, sets = Union(), [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    for k, (i, a) in enumerate(sets):
        u.find(i)
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                u.join(i, j)
    return {i: u.find(i) for i, _ in sets}


def repeated_bytes(rows: list[tuple]) -> dict[tuple, tuple]:
    first: dict[bytes, tuple] = {}
    texts = {((-(2**63) if r[0] is None else r[0]), r[1] or "") for r in rows}
    for i, t in sorted(texts):
        b = t.encode()
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w not in first or (i, s) < first[w]:
                first[w] = (i, s)
    out = {}
    for i, t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] != (i, s):
                gone[s : s + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i, t] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def fold_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def benchmark_hits(text: str | None, items: list[tuple]) -> tuple:
    w = fold_words(text)
    hit, held = set(), set()
    for i, t in items:
        own = fold_words(t)
        n = min(13, len(own))
        for a in range(len(own) - n + 1) if own else ():
            win = own[a : a + n]
            for s in range(len(w) - n + 1):
                if w[s : s + n] == win:
                    hit |= set(range(s, s + n))
                    held.add("" if i is None else str(i))
    return len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def mix_targets(rows: list[tuple]) -> dict:
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    return {s: (size[s], target[s]) for s in order}


def shards(rows: list[tuple], n: int = 40, keep: int = 20) -> Counter:
    """(doc_id, size, shard, slot) of the law in tarnwick.llm.sharding."""
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    own = sorted((key(r[1]), -(2**63) if r[0] is None else r[0], len((r[1] or "").encode()) + 16) for r in rows)
    total, group = sum(x[2] for x in own), Counter()
    for h, _, s in own:
        group[h] += s
    home, held = {}, [0] * n
    for h, s in sorted(group.items(), key=lambda x: (-x[1], x[0])):
        at = held.index(min(held))
        if s > total // (n * keep) and (held[at] + s) * n <= total:
            home[h] = at
            held[at] += s
    out, slots = Counter(), Counter()
    for h, i, s in own:
        if h in home:
            out[i, s, home[h], slots[home[h]]] += 1
            slots[home[h]] += 1
    at, start = 0, {}
    ends = [2 * (j * total - n * sum(held[:j])) for j in range(1, n)]
    for h, i, s in own:
        if h in home:
            continue
        start.setdefault(h, at)
        mid = 2 * start[h] + group[h] if group[h] <= total // (n * keep) else 2 * at + s
        shard = sum(e <= mid * n for e in ends)
        out[i, s, shard, slots[shard]] += 1
        slots[shard] += 1
        at += s
    return out
