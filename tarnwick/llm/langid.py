"""Language identification by hierarchical discrimination.

A text becomes the square roots of its counts of hashed byte trigrams and four-grams (of
the lower-cased text, anything but letters a space), scaled to length 1; every byte of
the text counts.  One linear support vector machine for each family against the rest
names the language's family; within it one machine for each pair of languages votes.
Machines are trained in numpy by dual coordinate descent on a sample of at most PER_LANG
texts a language and SAMPLE in all, of at most LONGEST bytes each, drawn by a hash of id and
text.  Equal rows count once there, and rows without id or with one id by their texts, so the driver
holds a bounded number of bytes whatever repeats.  A language without texts that short is not learned.

The score is the sigmoid of the weakest margin that decided.  Null texts and texts
without a letter are `und` with score 0, and so is every text if nothing was learned.
With one language learned, that is the answer.  Ties go to the larger sum of margins,
then to the first name.  Repeated rows get equal answers.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import with_columns
from tarnwick.llm.common import crc_mod, table

DIM = 1 << 13
PER_LANG = 500
SAMPLE = 5000
LONGEST = 50_000
PIECE = 120  # bytes of a piece of each sampled text, learned besides the whole
STEP = 1 << 20
COST = 20.0
EPOCHS = 12

# Families of languages, by ISO 639-1 code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "indic": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "malayic": "id ms tl jv su",
}
FAMILY = {c: f for f, codes in FAMILIES.items() for c in codes.split()}
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def features(text: bytes) -> np.ndarray:
    low = b" ".join(text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split())
    codes = np.frombuffer(b" " + low + b"  ", dtype=np.uint8)
    out = np.zeros(DIM)
    for at in range(0, len(codes) - 3, STEP):
        c = codes[at : at + STEP + 3].astype(np.uint32)
        three = (c[:-3] << 16 | c[1:-2] << 8 | c[2:-1]) * np.uint32(0x9E3779B1)
        four = (three ^ c[3:]) * np.uint32(0x85EBCA77)
        out += np.bincount(three >> np.uint32(19), minlength=DIM) + np.bincount(four >> np.uint32(19), minlength=DIM)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; x has rows of length 1, y is -1 or 1."""
    r, w, a = np.random.default_rng(2), np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x))
    cost = np.where(y > 0, COST * len(y) / (2 * max((y > 0).sum(), 1)), COST * len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(EPOCHS):
        for i in r.permutation(len(x)):
            g = y[i] * float(w @ x[i]) - 1 + a[i] / (2 * cost[i])
            new = max(a[i] - g / (1 + 1 / (2 * cost[i])), 0.0)
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                a[i] = new
    return w


def _piece(text: bytes, i: int) -> bytes:
    at = (i * 2654435761) % (len(text) - PIECE)
    return text[at : at + PIECE]


class Model:
    def __init__(self, rows: list[tuple[str, bytes]]):
        rows = rows + [(k, piece) for i, (k, t) in enumerate(rows) if len(t) > 2 * PIECE for piece in [_piece(t, i)] if has_letter(piece)]  # so that short texts are learned as well
        x = np.stack([features(t) for _, t in rows]) if rows else np.zeros((0, DIM), dtype=np.float32)
        lang = np.array([k for k, _ in rows])
        self.langs = sorted(set(lang.tolist()))
        by: dict[str, list[str]] = {}
        for k in self.langs:
            by.setdefault(FAMILY.get(k, k), []).append(k)
        self.families = sorted(by.items())
        self.weights: list[np.ndarray] = []
        family = np.array([FAMILY.get(k, k) for k in lang])
        self.top = [self._add(svm(x, np.where(family == f, 1, -1))) for f, _ in self.families] if len(by) > 1 else []
        self.pairs: dict[tuple[str, str], int] = {}
        for _, own in self.families:
            for a, b in combinations(own, 2):
                m = (lang == a) | (lang == b)
                self.pairs[a, b] = self._add(svm(x[m], np.where(lang[m] == a, 1, -1)))
        self.matrix = np.stack(self.weights) if self.weights else np.zeros((0, DIM), dtype=np.float32)
        del self.weights

    def _add(self, w: np.ndarray) -> int:
        self.weights.append(w)
        return len(self.weights) - 1

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        m = self.matrix @ features(text)
        margin = 6.0
        own = self.families[0][1]
        if self.top:
            tops = m[self.top]
            best = int(tops.argmax())
            own = self.families[best][1]
            rest = np.delete(tops, best)
            margin = min(margin, float(tops[best] - rest.max()) / 2)
        if len(own) == 1:
            return own[0], _sigmoid(margin)
        votes = {k: [0, 0.0, 6.0] for k in own}
        for a, b in combinations(own, 2):
            s = float(m[self.pairs[a, b]])
            win = a if s >= 0 else b
            votes[win][0] += 1
            votes[win][2] = min(votes[win][2], abs(s))
            votes[a][1] += s
            votes[b][1] -= s
        name = min(own, key=lambda k: (-votes[k][0], -votes[k][1], k))
        return name, _sigmoid(min(margin, votes[name][2]))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-3 * max(x, 0.0))))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """Different rows of docs drawn by a hash of id and text, about as many a language, in a fixed order."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)), F.lit(1 << 40))
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= LONGEST))
    known = known.select(F.col(lang_col).alias("_tw_lang"), draw.alias("_tw_draw"), F.col(text_col).alias("_tw_text"))
    counts = {r[0]: r[1] for r in known.groupBy("_tw_lang").agg(F.approx_count_distinct("_tw_draw")).collect()}  # a row a language
    if not counts:
        return []
    want = max(1, min(PER_LANG, SAMPLE // len(counts)))
    limits = docs.sparkSession.createDataFrame([(k, int(min(1.0, (want + 4 * want**0.5) / n) * (1 << 40))) for k, n in counts.items()], "_tw_lang string, _tw_limit long")
    drawn = known.join(F.broadcast(limits), "_tw_lang").where("_tw_draw < _tw_limit")
    rows = drawn.groupBy("_tw_lang", "_tw_draw").agg(F.min("_tw_text").alias("_tw_text")).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["_tw_lang"], r["_tw_draw"])):
        taken[r["_tw_lang"]] = taken.get(r["_tw_lang"], 0) + 1
        if taken[r["_tw_lang"]] <= want:
            out.append((r["_tw_lang"], r["_tw_text"].encode()))
    return [(k, t) for k, t in out if has_letter(t)]


def identified(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(texts: list[bytes]) -> dict[str, list]:
            out = [shared.value.predict(t) for t in texts]
            return {"lang_pred": [x[0] for x in out], "score": [x[1] for x in out]}

        return fn

    return with_columns(docs, text_col, "lang_pred string, score double", make, keep_text)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = Model(sample(docs.where(crc_mod(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
