"""Joining documents whose word shingles overlap, by PartEnum signatures.

A document's set is its distinct SHINGLE-word shingles.  Sets of sizes a and b with
Jaccard similarity of at least 0.8 differ in at most (a + b) / 9 elements.  Sets are put
into size bands (a set near the foot of its band also into the one before), so that two similar
sets meet in a band whose largest difference k is known.  The domain of shingles is
partitioned in two levels; if no more than k elements differ, then in more than
``slack`` of the n1 first-level parts no more than k2 differ, and there some n2 - k2 of the
n2 second-level parts agree.  Every such subset of parts is hashed into one signature, so
similar sets share a signature without fail.  Parts with an empty subset say nothing; a
set with at most ``slack`` such parts leaves its empty signatures out, and any other set
sends them too, so that no pair is lost.

Equal sets are joined by a hash of the set first; one of each goes on.  Signatures are
shuffled once and streamed in order; a bucket is written as links to its smallest id, never
as pairs.  Then

1. each document is compared with the smallest id it met,
2. with the first id of each of its buckets that is not yet in its component,
3. and where buckets still hold several components, all documents that share such a bucket
   with its first id come together once, and pairs between different components are put to a
   bound (counts of the sets in CELLS cells), block by block; those that pass it are compared.

Compared is by exact sets, built from the texts.  So all links between components are
found, and no group's pairs are listed.

Null, empty and wordless texts have no shingles and link with nothing; a text of fewer
words is one shingle.  A null id links with nothing and has a null component.  Rows with
one id are one document; repeated rows are returned as often as they come.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import pieces, raw, sized, whole_groups, with_columns
from tarnwick.llm.common import components, few, only_in, stored, table

SHINGLE = 5
NUM, DEN = 4, 5  # similarity of at least NUM / DEN
CELLS = 256
RATIO = 1.3  # of a band's bounds; the fewest signatures a document, weighing narrow bands against sets that lie in two
ELEMENTS = 2.5  # behind a signature, at least, where a scheme allows it
CACHE = 150_000
BLOCK = 2048
BOUNDED = 8192  # pairs put to the bound at once
SALT = 256
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ODD = np.uint64(0xD6E8FEB86659FD93)
LENGTHS = np.arange(SHINGLE + 1, dtype=np.uint64) * ODD


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The set, as sorted 64-bit hashes."""
    own = text.translate(LOWER).split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, own), dtype=np.uint64, count=len(own))
    n = max(1, len(w) - SHINGLE + 1)
    k = min(SHINGLE, len(w))
    h = w[:n].copy()
    for j in range(1, k):
        h *= M1
        h += w[j : n + j]
    return np.unique(mix(h + LENGTHS[k]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def bands() -> Iterator[int]:
    b = 1
    while True:
        yield b
        b = max(b + 1, int(np.ceil(b * RATIO)))


@lru_cache(maxsize=None)
def edges(size: int) -> tuple[int, int, int]:
    """Band of a size: its number and bounds, the upper one left out."""
    low = None
    for i, b in enumerate(bands()):
        if b > size:
            return i - 1, low, b
        low = b


def _more_than(n: int, p: float, s: int) -> float:
    """Chance that more than s of n parts are weak."""
    if n > 60:
        sd = sqrt(max(n * p * (1 - p), 1e-12))
        return 0.5 * (1 - erf((s + 0.5 - n * p) / sd / sqrt(2)))
    return 1 - sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(s + 1))


class Scheme:
    """Partition of the domain for a band: the cheapest that leaves few sets with too many weak parts."""

    def __init__(self, low: int, high: int):
        most = high - 1
        k = (most + most * DEN // NUM) * (DEN - NUM) // (DEN + NUM)  # the larger set may lie in the next band
        best = None
        for k2 in range(1 if k else 0, min(k, 4) + 1):
            for n2 in range(k2 + 2 if k > 1 else k2 + 1, k2 + 4 if k2 else 2):  # a signature spans two second-level parts at least
                for slack in range(0, k + 2):
                    n1 = k // (k2 + 1) + 1 + slack
                    q = (1 - 1 / (n1 * n2)) ** low
                    weak = sum(comb(n2, j) * q**j * (1 - q) ** (n2 - j) for j in range(n2 - k2, n2 + 1))
                    if _more_than(n1, weak, slack) <= 0.03:
                        cost = n1 * comb(n2, k2)
                        held = sqrt(low * most) * (n2 - k2) / (n1 * n2)  # elements behind a signature
                        if best is None or (held < ELEMENTS, cost) < best[0]:
                            best = ((held < ELEMENTS, cost), n1, n2, k2, slack)
                        break
        if best is None:
            k2 = min(k, 4)
            best = (None, k // (k2 + 1) + 1, k2 + 3, k2, 0)
        _, self.n1, self.n2, self.k2, self.slack = best
        subsets = list(combinations(range(self.n2), self.n2 - self.k2))
        self.subsets = np.zeros((self.n2, len(subsets)), dtype=np.uint64)
        for c, s in enumerate(subsets):
            self.subsets[list(s), c] = 1
        cells = self.n1 * self.n2
        self.cut = (np.arange(1, cells, dtype=np.uint64) << np.uint64(32)) // np.uint64(cells)
        self.salt = mix(np.arange(self.n1 * len(subsets), dtype=np.uint64) * ODD + np.uint64(low)).reshape(self.n1, -1)

    def signatures(self, h: np.ndarray, total: np.ndarray) -> np.ndarray:
        """h: sorted hashes; total: their mixed values summed up from 0."""
        at = np.concatenate([[0], np.searchsorted(h >> np.uint64(32), self.cut, side="left"), [len(h)]])
        sums = (total[at[1:]] - total[at[:-1]]).reshape(self.n1, self.n2)
        count = np.diff(at).astype(np.uint64).reshape(self.n1, self.n2)
        held = count @ self.subsets
        sig = mix(sums @ self.subsets + held * ODD + self.salt)
        if (held == 0).any(axis=1).sum() > self.slack:
            return sig.ravel()
        return sig[held > 0]


@lru_cache(maxsize=None)
def scheme(low: int, high: int) -> Scheme:
    return Scheme(low, high)


def signatures(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + ODD))])
    _, low, high = edges(len(h))
    out = [scheme(low, high).signatures(h, total)]
    while low > 1 and NUM * len(h) <= DEN * (low - 1):  # a smaller partner may lie in the band before
        _, low, high = edges(low - 1)
        out.append(scheme(low, high).signatures(h, total))
    return np.concatenate(out)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), s1 and s2 (hash of the set), cells (counts of the set in CELLS cells, at most 255 each)."""

    def make():
        hashes = WordHashes()

        def fn(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {"n": [], "s1": [], "s2": [], "cells": []}
            for t in texts:
                h = shingles(t, hashes)
                out["n"].append(len(h))
                out["s1"].append(int(mix(h + ODD).sum().astype(np.int64)) if len(h) else 0)
                out["s2"].append(int(np.bitwise_xor.reduce(mix(h ^ M1)).astype(np.int64)) if len(h) else 0)
                out["cells"].append(np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
            return out

        return fn

    return with_columns(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_tw_text")), "_tw_text", "n long, s1 long, s2 long, cells binary", make, keep_text=False)


def buckets(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> rows (sig, a, b): b shares signature sig with a, the smallest id there."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            for part, texts in pieces(batch, "text"):
                sigs = [signatures(shingles(t, hashes)) for t in texts]
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), [len(s) for s in sigs])
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(ids.astype(np.int64))], ["sig", "id"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (signature, its first id, whether another id has come) at the end of the batch before
        for batch in it:
            if not batch.num_rows:
                continue
            sig, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "id"))
            first = np.concatenate([[last is None or sig[0] != last[0]], sig[1:] != sig[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
            lead = np.where(at >= 0, ids[np.maximum(at, 0)], last[1] if last else 0)
            pair = lead != ids
            yield pa.RecordBatch.from_arrays([pa.array(x[pair]) for x in (sig, lead, ids)], ["sig", "a", "b"])
            last = (sig[-1], lead[-1])

    flat = sized(docs).mapInArrow(emit, "sig long, id long")
    return flat.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(meet, "sig long, a long, b long")


def bounded(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets with these cells and sizes can be similar; never wrongly False."""
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return (DEN + NUM) * apart <= (DEN - NUM) * (na + nb)


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) whose cells leave them possible."""

    @F.pandas_udf("boolean")
    def passes(ca: pd.Series, cb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(c), dtype=np.uint8).reshape(-1, CELLS) for c in (ca, cb))
        return pd.Series(bounded(a, b, na.to_numpy(), nb.to_numpy()))

    left = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    right = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    near = pairs.join(left, "a").join(right, "b").where((DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb")))
    return near.where(passes("ca", "cb", "na", "nb")).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (a, b), at most so many where that is known, whose exact sets are similar.  A hot a is dealt to several tasks, with its text."""
    pairs = stored(pairs, most)
    n = pairs.count()
    own = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = only_in(docs, stored(own, 2 * n), "id")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    salted = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    rows = heads.join(texts, heads["a"] == texts["id"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text").union(
        salted.join(texts, salted["b"] == texts["id"]).select("a", "salt", "b", "text"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, sets = WordHashes(), None, []
        for batch in (whole.slice(at, 256) for whole in it for at in range(0, whole.num_rows, 256)):
            a, b = [], []
            for x, s, y, t in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist(), raw(batch.column("text"))):
                if key != (x, s):
                    key, sets = (x, s), []
                h = shingles(t, hashes)
                if y is None:
                    sets.append(h)
                elif any(similar(h, o) for o in sets):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stored(sized(rows).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(compare, "a long, b long"), n)


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) not yet in one component."""
    left, right = parts.select(F.col("id").alias("a"), F.col("component").alias("pa")), parts.select(F.col("id").alias("b"), F.col("component").alias("pb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b")


def _crossed(ids: np.ndarray, part: np.ndarray, n: np.ndarray, cells: np.ndarray, own: np.ndarray, x: int, y: int) -> Iterator[np.ndarray]:
    """Pairs of one block with another (or with itself) that lie in different parts and pass the bound, in pieces of at most BOUNDED."""
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    step = max(1, 200_000 // max(len(right), 1))
    for at in range(0, len(left), step):
        i, j = (v.ravel() for v in np.meshgrid(left[at : at + step], right, indexing="ij"))
        ok = (part[i] != part[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
        if x == y:
            ok &= i < j
        i, j = i[ok], j[ok]
        for lo in range(0, len(i), BOUNDED):  # the cells of a pair take CELLS numbers
            a, b = i[lo : lo + BOUNDED], j[lo : lo + BOUNDED]
            near = bounded(cells[a], cells[b], n[a], n[b])
            yield np.sort(np.stack([ids[a[near]], ids[b[near]]]), axis=0)


def across(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (head, id, part) -> pairs of different parts of a head that pass the bound.  Large heads are split into pairs of blocks."""
    sizes = members.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "head").join(known.select("id", "n", "cells"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("head", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "part", "n", "cells")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(it, ("head", "x", "y")):
            ids, part, n, own, x, y = (rows.column(c).to_numpy() for c in ("id", "part", "n", "own", "x", "y"))
            cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), dtype=np.uint8).reshape(-1, CELLS)
            for s, e in zip(at[:-1], at[1:]):
                for pairs in _crossed(ids[s:e], part[s:e], n[s:e], cells[s:e], own[s:e], x[s], y[s]):
                    if pairs.shape[1]:
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in pairs], ["a", "b"])

    return dealt.repartition("head", "x", "y").sortWithinPartitions("head", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row (id, n), and the components (id, component) of ids that have a link."""
    known = stored(described(docs, id_col, text_col))
    n = known.count()
    sets = known.where("id is not null and n > 0")
    equal = stored(sets.groupBy("s1", "s2", "n").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("c")).where("z > a"), n)
    copies = stored(sets.join(equal, ["s1", "s2", "n"]).where("id <> a").select("a", F.col("id").alias("b")).distinct(), n)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    firsts = own.where(F.length("text") > 0)
    kept = sets.dropDuplicates(["id"]).select("id", "n", "cells")
    met = stored(buckets(only_in(firsts, copies.select(F.col("b").alias("id")).distinct(), "id", "left_anti")))
    links = verified(possible(met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), kept), own, n)
    parts = stored(components(links, rows=n), n)
    between = apart(met.select("a", "b").distinct(), parts).distinct()
    open_ = stored(between)
    if not open_.isEmpty():
        links = links.union(verified(possible(open_, kept), own, open_.count()))
        parts = stored(components(links, rows=links.count()), n)
        still = stored(apart(open_, parts), open_.count())
        if not still.isEmpty():
            sigs = met.join(F.broadcast(still) if few(still) else still, ["a", "b"], "left_semi").select("sig").distinct()
            rows = met.join(sigs, "sig", "left_semi").select(F.col("a").alias("head"), F.col("b").alias("id")).distinct()
            rows = rows.union(rows.select("head", F.col("head").alias("id")).distinct())
            rows = rows.join(parts, "id", "left").select("head", "id", F.coalesce("component", "id").alias("part"))
            links = links.union(verified(across(rows, kept), own))
    every = links.union(copies)
    return known, stored(components(every, rows=every.count()), n)


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_shingles, component_id."""
    known, parts = joined(docs, id_col, text_col)
    out = known.select("id", F.col("n").alias("n_shingles")).join(parts, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id; rows with null ids stay.

    Of rows with equal id and text one stays, that of the smallest hash of all its columns; rows of one id
    with different texts are all kept or all dropped.
    """
    known, parts = joined(docs, id_col, text_col)
    gone = stored(parts.where("id <> component").select(F.col("id").alias(id_col)).distinct(), known.count())
    out = only_in(docs, gone, id_col, "left_anti")
    twice = known.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col))
    if twice.isEmpty():
        return out
    twice = stored(twice)
    again = only_in(out, twice, id_col).withColumn("_tw_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).withColumn("_tw_text", F.md5(F.coalesce(text_col, F.lit(""))))
    one = again.groupBy(F.col(id_col).alias("_tw_id"), "_tw_text", F.col(text_col).isNull()).agg(F.min_by("_tw_row", F.xxhash64("_tw_row")).alias("_tw_row"))
    return out.where(F.col(id_col).isNull()).union(only_in(out.where(F.col(id_col).isNotNull()), twice, id_col, "left_anti")).union(one.select("_tw_row.*"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of clustered() over all documents."""
    return clustered(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, root) AS (SELECT doc_id, doc_id FROM doc UNION SELECT way.b, reach.root FROM reach JOIN way ON way.a = reach.id),
part AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN part ON part.id = doc.doc_id
"""
