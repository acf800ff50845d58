"""Personal data by patterns and a semi-Markov conditional random field.

Base spans come from four fixed patterns with their checks and are always kept.  The
field adds spans that the patterns miss (telephone numbers without a plus sign, written
out addresses such as ``name (at) host (dot) org``, addresses and cards in other groupings).
It works on tokens near digits and at-signs: whole tokens, as many as an entity and what its
features look at can reach.  A candidate segment runs over several
tokens and is scored as a whole, by what it contains, its shape, its borders and the word
before it; single tokens outside are scored 0, and neighbouring segments by their types.
An entity is at most ENTITY tokens, so the dynamic programme that chooses boundaries and
types together is linear in the text.  It is trained in numpy by the exact conditional
likelihood on sentences made from templates with a fixed seed.

A span of the field is added only where it meets no base span.  Positions are code points,
end exclusive.  Null texts count as empty; repeated rows get equal results; null ids are
kept; an empty table gives an empty result.  Long texts are scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tarnwick.llm.arrow import with_columns
from tarnwick.llm.common import table

KINDS = ("email", "ip", "card", "phone")
ENTITY = 20  # tokens
REACH = ENTITY + 6  # tokens around digits and at-signs that the field sees: an entity, its borders and the words before it

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HOT = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
WORDISH = re.compile(r"[A-Za-z0-9._%+-]")

# Words before a number that tell what it is.
CUES = {
    "tel": "tel telephone phone call mobile cell fax number dial telefon tél móvil teléfono anruf handy",
    "card": "card visa mastercard amex credit karte carte tarjeta pan",
    "ip": "ip host server address addr adresse",
    "mail": "mail email contact courriel correo",
    "date": "on date since until version no order ref isbn id",
}
CUE = {w: k for k, ws in CUES.items() for w in ws.split()}


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches of each kind that pass their check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and WORDISH.match(text, s - 1):
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out["email"].append((s, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the field ---

FEATURES = (
    "bias", "digits<8", "digits8-9", "digits10", "digits11-12", "digits13-15", "digits16", "digits17-19", "plus", "paren", "one_group", "groups2", "groups3", "groups4", "groups>4",
    "longest<=4", "longest5-8", "longest>8", "dot", "dash", "space", "slash", "luhn", "ip4", "at", "at_words", "dotted", "dot_words", "date_like", "even_groups", "open_left", "open_right",
    "cue_tel", "cue_card", "cue_ip", "cue_mail", "cue_date", "tail2-6", "wordy", "more_left", "more_right", "loose", "dot_left", "dot_right",
)
F_AT = {f: i for i, f in enumerate(FEATURES)}
SEPARATORS = set(" -.()/")


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)]


def candidates(tok: list[tuple[str, int, int]]) -> list[tuple[int, int, list[int]]]:
    """Segments (first token, end token, features) that may be entities."""
    out = []
    kind = ["d" if t[0] in "0123456789" else "w" if t[0].isalpha() else t for t, _, _ in tok]
    n = len(tok)
    for i in range(n):
        if kind[i] == "d" or (tok[i][0] in "+(" and i + 1 < n and kind[i + 1] == "d"):
            digits = run = 0
            for j in range(i, min(n, i + ENTITY)):
                if kind[j] == "d":
                    digits, run = digits + len(tok[j][0]), 0
                    if digits > 19:
                        break
                    if (digits >= 7 or "." in {tok[x][0] for x in range(i, j)}) and digits >= 4:
                        out.append((i, j + 1, _number(tok, kind, i, j + 1)))
                elif j > i and (tok[j][0] not in SEPARATORS or (run := run + 1) > 2):
                    break
        elif kind[i] == "@" or (kind[i] in "([" and i + 2 < n and tok[i + 1][0].lower() == "at" and tok[i + 2][0] in ")]"):
            left, right = i, i + (1 if kind[i] == "@" else 3)
            words = kind[i] != "@"
            while left and right - left < ENTITY and (kind[left - 1] in ("d", "w") or tok[left - 1][0] in "._%+-" or (words and left == i and tok[left - 1][0] == " ")):
                left -= 1
            starts = [x for x in range(left, i) if kind[x] in ("d", "w") and (x == left or kind[x - 1] not in ("d", "w"))]
            end, dotted, ends = right, False, []  # ends: end token, whether plain blanks part its words
            last, loose = right, False
            while end < n and end - i < ENTITY:
                t = tok[end][0]
                if kind[end] in ("d", "w"):
                    if t.lower() == "dot":
                        dotted = True
                    else:
                        loose = loose or (last > right and _loose(tok, last, end))
                        last = end + 1
                        if dotted:
                            ends.append((end + 1, loose))
                elif t == ".":
                    dotted = True
                elif t in "-" or (words and t in " ()[]"):
                    pass
                else:
                    break
                end += 1
            for s in starts:
                for e, apart in ends:
                    if e - s <= ENTITY:
                        out.append((s, e, _address(tok, kind, s, e, words, apart)))
    return out


def _borders(tok, kind, i: int, j: int) -> list[str]:
    f = []
    if i == 0 or (kind[i - 1] not in ("d", "w", "_", "-", ".", "+", "(", "@")):
        f.append("open_left")
    if j == len(tok) or (kind[j] not in ("d", "w", "_", "-", "@")):
        f.append("open_right")
    if i >= 2 and kind[i - 1] in (" ", "-", ".", ") ") and kind[i - 2] == "d" or i and kind[i - 1] in "+(":
        f.append("more_left")
    if j + 1 < len(tok) and kind[j] in (" ", "-", ".") and kind[j + 1] == "d":
        f.append("more_right")
    for x in range(i - 1, max(-1, i - 5), -1):
        if kind[x] == "w":
            if cue := CUE.get(tok[x][0].lower()):
                f.append(f"cue_{cue}")
            break
    return f


def _number(tok, kind, i: int, j: int) -> list[int]:
    groups = [tok[x][0] for x in range(i, j) if kind[x] == "d"]
    seps = {tok[x][0] for x in range(i, j) if kind[x] != "d"}
    n = sum(map(len, groups))
    f = ["bias", *_borders(tok, kind, i, j)]
    f.append("digits<8" if n < 8 else "digits8-9" if n < 10 else "digits10" if n == 10 else "digits11-12" if n < 13 else "digits13-15" if n < 16 else "digits16" if n == 16 else "digits17-19")
    f.append("one_group" if len(groups) == 1 else f"groups{len(groups)}" if len(groups) < 5 else "groups>4")
    longest = max(map(len, groups))
    f.append("longest<=4" if longest < 5 else "longest5-8" if longest < 9 else "longest>8")
    f += [name for c, name in (("+", "plus"), ("(", "paren"), (".", "dot"), ("-", "dash"), (" ", "space"), ("/", "slash")) if c in seps]
    if n >= 13 and luhn("".join(groups)):
        f.append("luhn")
    if len(groups) == 4 and seps == {"."} and j - i == 7 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        f.append("ip4")
    if len(groups) == 3 and (len(groups[0]) == 4 and groups[0][:2] in ("19", "20") or len(groups[2]) == 4 and groups[2][:2] in ("19", "20") and len(groups[0]) <= 2):
        f.append("date_like")
    if len(groups) > 2 and len({len(g) for g in groups[:-1]}) == 1 and len(groups[0]) == 4:
        f.append("even_groups")
    return [F_AT[x] for x in f]


def _loose(tok, i: int, j: int) -> bool:
    """Whether what is between two words of a host parts them: blanks or brackets without a written dot, other than `` . ``."""
    between = "".join(tok[x][0] for x in range(i, j)).lower()
    return "dot" not in between and between != " . " and any(c in between for c in " ()[]")


def _dot_after(tok, kind, j: int) -> bool:
    """Whether the host goes on: a dot and a word, or a written dot and a word."""
    if j + 1 < len(tok) and tok[j][0] == "." and kind[j + 1] in ("d", "w"):
        return True
    x = j
    while x < len(tok) and x - j < 3 and tok[x][0] in " ()[]":
        x += 1
    return x > j and x < len(tok) and tok[x][0].lower() == "dot"


def _address(tok, kind, i: int, j: int, words: bool, loose: bool) -> list[int]:
    f = ["bias", *_borders(tok, kind, i, j), "at_words" if words else "at"]
    f += ["loose"] if loose else []
    f += ["dot_left"] if i >= 2 and tok[i - 1][0] in "._%+-" and kind[i - 2] in ("d", "w") else []
    f += ["dot_right"] if _dot_after(tok, kind, j) else []
    seps = [tok[x][0].lower() for x in range(i, j)]
    f += ["dotted"] if "." in seps else []
    f += ["dot_words"] if "dot" in seps else []
    f += ["tail2-6"] if kind[j - 1] == "w" and 2 <= len(tok[j - 1][0]) <= 6 else []
    f += ["wordy"] if kind[i] == "w" else []
    return [F_AT[x] for x in f]


class Field:
    """Weights of whole segments by type, and of neighbouring types; type 0 is outside."""

    def __init__(self):
        self.w = np.zeros((len(KINDS), len(FEATURES)))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _ends(self, n: int, segs) -> list[list[tuple[int, np.ndarray, int]]]:
        ends: list[list] = [[] for _ in range(n + 1)]
        for x, (i, j, f) in enumerate(segs):
            ends[j].append((i, self.w[:, f].sum(axis=1), x))
        return ends

    def decode(self, n: int, segs) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, end token, type)."""
        if not segs:
            return []
        ends, k = self._ends(n, segs), len(KINDS) + 1
        best = [[0.0] + [-np.inf] * (k - 1)]
        back: list[list] = [[None] * k]
        t = self.t.tolist()
        for j in range(1, n + 1):
            prev = best[j - 1]
            scores = [prev[a] + t[a][0] for a in range(k)]
            a = max(range(k), key=scores.__getitem__)
            row, ptr = [scores[a]] + [-np.inf] * (k - 1), [(j - 1, a)] + [None] * (k - 1)
            for i, s, _ in ends[j]:
                for y in range(1, k):
                    scores = [best[i][a] + t[a][y] for a in range(k)]
                    a = max(range(k), key=scores.__getitem__)
                    v = scores[a] + s[y - 1]
                    if v > row[y]:
                        row[y], ptr[y] = v, (i, a)
            best.append(row)
            back.append(ptr)
        y, j, out = max(range(k), key=best[n].__getitem__), n, []
        while j:
            i, a = back[j][y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, a
        return out[::-1]

    def gradient(self, n: int, segs, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the conditional log likelihood, by forward and backward sums over segmentations."""
        k = len(KINDS) + 1
        ends = self._ends(n, segs)
        starts: list[list] = [[] for _ in range(n + 1)]
        for j in range(n + 1):
            for i, s, x in ends[j]:
                starts[i].append((j, s, x))
        a = np.full((n + 1, k), -1e30)
        a[0, 0] = 0
        for j in range(1, n + 1):
            a[j, 0] = np.logaddexp.reduce(a[j - 1] + self.t[:, 0])
            for i, s, _ in ends[j]:
                a[j, 1:] = np.logaddexp(a[j, 1:], np.logaddexp.reduce(a[i][:, None] + self.t[:, 1:], axis=0) + s)
        z = np.logaddexp.reduce(a[n])
        b = np.full((n + 1, k), -1e30)
        b[n] = 0
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for i in range(n - 1, -1, -1):
            b[i] = self.t[:, 0] + b[i + 1, 0]
            gt[:, 0] -= np.exp(a[i] + self.t[:, 0] + b[i + 1, 0] - z)
            for j, s, x in starts[i]:
                to = self.t[:, 1:] + (s + b[j, 1:])[None]
                b[i] = np.logaddexp(b[i], np.logaddexp.reduce(to, axis=1))
                p = np.exp(a[i][:, None] + to - z)
                gt[:, 1:] -= p
                gw[:, segs[x][2]] -= p.sum(axis=0)[:, None]
        score, y0, at = 0.0, 0, 0
        own = {(i, j): y for i, j, y in gold}
        by = {(i, j): f for i, j, f in segs}
        first = {i: j for i, j, _ in gold}
        while at < n:
            if at in first:
                j = first[at]
                y = own[at, j] + 1
                f = by[at, j]
                gw[y - 1, f] += 1
                score += self.w[y - 1, f].sum()
            else:
                j, y = at + 1, 0
            gt[y0, y] += 1
            score += self.t[y0, y]
            at, y0 = j, y
        return gw, gt, score - z


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with typed spans, from templates."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["on", "er", "la", "ti", "en", "sch", "qu", "es", "mo", "ra"]) for _ in range(r.randint(1, 3)))

    def card() -> str:
        s = r.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        form = r.choice(["", " ", "-", ".", "/"])
        return form.join(s[i : i + 4] for i in range(0, 16, 4))

    phones = [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"+{d(2)} {d(3)} {d(6)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]
    ips = [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))]
    mails = [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}{d(2)} (at) {word()} (dot) org", lambda: f"{word()}[at]{word()}.net", lambda: f"{word()}_{d(1)}@{word()}{d(1)}.{word()}.de", lambda: f"{word()}.{word()}.{word()} (at) {word()}.org", lambda: f"{word()} [at] {word()}.net", lambda: f"{word()} (at) {word()} (dot) {word()} (dot) uk"]
    noise = [lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", lambda: f"1{d(1)}.0{r.randint(1, 9)}.19{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: d(r.randint(1, 9)), lambda: f"order {d(7)}", lambda: f"{d(2)}:{d(2)}", lambda: f"isbn 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(3)}.{d(3)},{d(2)}", lambda: f"{d(4)}-{d(4)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(24)), lambda: f"{r.randint(256, 999)}.{d(3)}.{d(1)}.{d(2)}", lambda: f"{d(12)}", lambda: f"{d(17)}", lambda: f"1{d(9)}", lambda: f"page@{word()}", lambda: f"{d(3)} {d(4)} {d(2)}"]
    makers = {0: mails, 1: ips, 2: [card], 3: phones}
    lead = {0: ["mail", "contact", "write"], 1: ["ip", "host", "from"], 2: ["card", "visa", "with"], 3: ["call", "tel", "phone", "at"]}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 3))) + " "
            if r.random() < 0.6:
                y = r.randrange(4)
                if r.random() < 0.5:
                    text += r.choice(lead[y]) + r.choice([" ", ": "])
                s = r.choice(makers[y])()
                spans.append((len(text), len(text) + len(s), y))
            else:
                s = r.choice(noise)()
            text += s + r.choice([" ", ". ", ", ", "\n", " " + " ".join(word() for _ in range(r.randint(1, 5))) + " "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 500, epochs: int = 12, seed: int = 4) -> Field:
    field, data = Field(), []
    for text, spans in sentences(n, seed):
        tok = tokens_of(text, 0, len(text))
        at, end = {s: i for i, (_, s, _) in enumerate(tok)}, {e: i + 1 for i, (_, _, e) in enumerate(tok)}
        segs = candidates(tok)
        known = {(i, j) for i, j, _ in segs}
        gold = {(at[s], end[e], y) for s, e, y in spans if s in at and e in end and (at[s], end[e]) in known}
        data.append((len(tok), segs, gold))
    hw, ht = np.full_like(field.w, 1e-3), np.full_like(field.t, 1e-3)
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(data)):
            gw, gt, _ = field.gradient(*data[i])
            gw -= 1e-3 * field.w
            gt -= 1e-3 * field.t
            hw += gw**2
            ht += gt**2
            field.w += 0.3 * gw / np.sqrt(hw)
            field.t += 0.3 * gt / np.sqrt(ht)
    return field


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _before(text: str, at: int, floor: int) -> int:
    """Where the REACH-th token before a token border begins, or floor."""
    for _ in range(REACH):
        if at <= floor:
            return floor
        at -= 1
        same = _letter if _letter(text[at]) else "0123456789".__contains__ if text[at] in "0123456789" else None
        while same and at > floor and same(text[at - 1]):
            at -= 1
    return max(at, floor)


def _after(text: str, at: int) -> int:
    """Where the REACH-th token after a token border ends."""
    for _ in range(REACH):
        if not (m := TOKEN.match(text, at)):
            break
        at = m.end()
    return at


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, end, type) of the field's segments, over all parts of the text near digits and at-signs.

    A part begins and ends at token borders.  How far one reaches is looked up only where the next
    digit or at-sign lies beyond the part as known, so every token is passed a few times at most.
    """
    out: list[tuple[int, int, int]] = []

    def zone(lo: int, hi: int) -> None:
        tok = tokens_of(text, lo, hi)
        for i, j, y in field.decode(len(tok), candidates(tok)):
            out.append((tok[i][1], tok[j - 1][2], y))

    lo, hi, last = -1, -1, -1  # the part, and the end of its last digit or at-sign
    for m in HOT.finditer(text):
        if m.start() >= hi:
            if lo >= 0:
                hi = _after(text, last)
            if lo < 0 or m.start() >= hi:
                start = _before(text, m.start(), max(hi, 0))
                if lo < 0:
                    lo = start
                elif start > hi:
                    zone(lo, hi)
                    lo = start
                hi = m.end()
        last = m.end()
    if lo >= 0:
        zone(lo, _after(text, last))
    return out


def all_spans(text: str, field: Field) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and base spans with those of the field."""
    base = base_spans(text)
    both = {k: list(v) for k, v in base.items()}
    if not HOT.search(text):
        return base, both
    held = sorted(x for v in base.values() for x in v)
    at, reach = 0, -1
    for s, e, y in sorted(field_spans(text, field)):
        while at < len(held) and held[at][0] < e:
            reach = max(reach, held[at][1])
            at += 1
        if reach <= s:
            both[KINDS[y]].append((s, e))
    return base, {k: sorted(v) for k, v in both.items()}


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def marked(docs: DataFrame, field: Field, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        def fn(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
            for t in texts:
                base, both = all_spans(t.decode("utf-8", "replace"), shared.value)
                for k in KINDS:
                    out[f"n_{k}"].append(len(base[k]))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(both))
            return out

        return fn

    return with_columns(docs, text_col, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", make, keep_text)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(), keep_text=False)
