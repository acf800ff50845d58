"""Near-duplicate embeddings by lattice hashing.

Each of TABLES tables projects a unit vector at random onto BLOCKS times 8 dimensions and
decodes each 8 of them to the nearest point of the E8 lattice; label, length and points make
the vector's cell.  A vector is at home in its cell and also probes the PROBES neighbouring
cells that lie nearest (one block moved by a shortest lattice vector).  Two vectors meet where
one is at home and the other at home or probing.  First only (cell, id) rows are shuffled;
cells of a single vector go, then the vectors of the others are compared by cosine in double
precision, block by block.  A pair that meets more than once counts at its first
meeting, which both vectors' cells tell, so links are summed without listing pairs, and a
cell of any size is split into pairs of blocks of BLOCK vectors.

At cosine 0.98 two vectors meet with probability 0.9997 (measured on random pairs, 64
dimensions), and more surely above.  No pair under 0.98 is linked.

Vectors that are null, empty or zero, hold a null or a number that isn't finite, or have no
label or no id link with nothing; vectors of different lengths never meet.  Rows with one id
are one vector (the first by label and numbers); each row is returned.  A null id has a
null component and isn't kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import sized, whole_groups
from tarnwick.llm.common import components, smallest, stored, table

LEAST = 0.98
TABLES = 5
BLOCKS = 2
PROBES = 4
WIDTH = 0.25  # of a lattice unit, at 64 dimensions
BLOCK = 1024
LISTED = 1 + PROBES
M = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = np.array([np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)])
    halves = np.array([s for s in product((0.5, -0.5), repeat=8) if np.prod(s) > 0])
    return np.concatenate([pairs, halves])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    k = np.abs(e[odd]).argmax(axis=1)
    r[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=64)
def projections(d: int, seed: int = 8) -> np.ndarray:
    """TABLES matrices of d columns and BLOCKS * 8 rows, scaled to lattice units.

    Rows are orthonormal, with fewer dimensions than rows the columns; either way a pair lies on
    average as near in each block as at 64 dimensions.
    """
    r = np.random.default_rng([seed, d])
    out = []
    for _ in range(TABLES):
        g = r.standard_normal((d, 8 * BLOCKS))
        q = np.linalg.qr(g)[0].T if d >= 8 * BLOCKS else np.linalg.qr(g.T)[0]
        out.append(q / (WIDTH * np.sqrt(64 / max(d, 8 * BLOCKS))))
    return np.stack(out)


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For unit vectors, TABLES times LISTED cells each, of every table the home first."""
    n, d = x.shape
    out = np.empty((n, TABLES, LISTED), dtype=np.uint64)
    weight = mix(np.arange(1, 8 * BLOCKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    step = ((2 * roots()).astype(np.int64).astype(np.uint64)[None] * weight.reshape(BLOCKS, 1, 8)).sum(axis=2)  # a root's part in the sum, by block
    for t, p in enumerate(projections(d)):
        z = x @ p.T
        home = np.concatenate([nearest_e8(z[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
        gain = np.concatenate([1 - (z - home)[:, 8 * b : 8 * b + 8] @ roots().T for b in range(BLOCKS)], axis=1)
        near = np.argsort(gain, axis=1, kind="stable")[:, :PROBES]
        total = ((2 * home).astype(np.int64).astype(np.uint64) * weight).sum(axis=1)
        salt = mix(label.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 1_000_003 + d))
        out[:, t, 0] = mix(total + salt)
        out[:, t, 1:] = mix(total[:, None] + step.ravel()[near] + salt[:, None])
    return out.reshape(n, -1).view(np.int64)


def indexed(vectors: DataFrame) -> DataFrame:
    """vectors (id, label, v) -> id, d, x (the numbers as bytes of doubles), cells; those that can link."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v = batch.column("v")
                lengths, flat = np.diff(v.offsets.to_numpy()), v.values.slice(v.offsets[0].as_py(), v.offsets[-1].as_py() - v.offsets[0].as_py())
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null numbers become nan
                start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
                ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                for d in np.unique(lengths[lengths > 0]):
                    rows = np.flatnonzero(lengths == d)
                    x = values[start[rows][:, None] + np.arange(d)]
                    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    if not ok.any():
                        continue
                    rows, x = rows[ok], x[ok]
                    own = cells(unit(x), label[rows])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[rows].astype(np.int64)), pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), pa.array(own.ravel())),
                    ], ["id", "x", "cells"])

    return sized(vectors).mapInArrow(run, "id long, x binary, cells array<long>")


def _first_meeting(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Whether this cell is where the pairs (rows of a and b: their cells) first meet."""
    undecided, here = np.ones(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
    a, b = a.reshape(len(a), TABLES, LISTED), b.reshape(len(b), TABLES, LISTED)
    for t in range(TABLES):
        ha, hb = a[:, t, 0], b[:, t, 0]
        at_b, at_a = (a[:, t] == hb[:, None]).any(axis=1), (b[:, t] == ha[:, None]).any(axis=1)
        first = np.where(at_a & at_b, np.minimum(ha, hb), np.where(at_a, ha, hb))
        here |= undecided & (at_a | at_b) & (first == cell)
        undecided &= ~(at_a | at_b)
    return here


def compared(ids: np.ndarray, x: np.ndarray, listed: np.ndarray, home: np.ndarray, own: np.ndarray, cell: int, bx: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one pair of blocks of a cell: links first met here by place, and the place each place is joined to."""
    order = np.argsort(ids, kind="stable")
    count, si, sj = np.zeros(len(ids), dtype=np.int64), [], []
    left, right = order[own[order] == bx], order[own[order] == by]
    step = max(1, 400_000 // max(len(right), 1))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        cos = x[rows] @ x[right].T
        ok = (cos >= LEAST) & (home[rows][:, None] | home[right][None]) & (ids[rows][:, None] != ids[right][None])
        if bx == by:
            ok &= ids[rows][:, None] < ids[right][None]
        p, q = np.nonzero(ok)
        i, j = rows[p], right[q]
        for c in range(0, len(i), 100_000):
            a, b = i[c : c + 100_000], j[c : c + 100_000]
            new = _first_meeting(listed[a], listed[b], cell)
            count += np.bincount(a[new], minlength=len(ids)) + np.bincount(b[new], minlength=len(ids))
        si.append(i)
        sj.append(j)
    return count, smallest(len(ids), np.concatenate(si), np.concatenate(sj)) if si else np.arange(len(ids))


def linked(vectors: DataFrame) -> DataFrame:
    """vectors (id, label, v) -> rows (id, n, to): n links found at one place, and an id it is joined to there."""
    index = stored(indexed(vectors))
    rows = index.select("id", F.posexplode("cells").alias("place", "cell")).select("id", "cell", (F.col("place") % LISTED == 0).alias("home"))
    shared = rows.groupBy("cell").agg(F.count("*").alias("c"), F.max("home").alias("h")).where("c > 1 and h").select("cell", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    dealt = rows.join(shared, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("id", "cell", "home", "own", F.least("own", "other").alias("bx"), F.greatest("own", "other").alias("by"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, at in whole_groups(it, ("cell", "bx", "by")):
            ids, own, cell, bx, by = (group.column(c).to_numpy() for c in ("id", "own", "cell", "bx", "by"))
            home = group.column("home").to_numpy()
            raw = group.column("x").to_pylist()
            flat = group.column("cells").combine_chunks()
            listed = flat.flatten().to_numpy().reshape(len(ids), -1)
            out = []
            for s, e in zip(at[:-1], at[1:]):
                size = len(raw[s])
                same = np.array([len(r) == size for r in raw[s:e]])
                if e - s < 2 or not same.all():  # other lengths have other cells, but for a clash of hashes
                    keep = np.flatnonzero(same)
                else:
                    keep = np.arange(e - s)
                x = unit(np.frombuffer(b"".join(raw[s + k] for k in keep)).reshape(len(keep), -1))
                n, to = compared(ids[s:e][keep], x, listed[s:e][keep], home[s:e][keep], own[s:e][keep], cell[s], bx[s], by[s])
                places = np.arange(len(keep))
                hit = (n > 0) | (to != places)
                out.append(np.stack([ids[s:e][keep][hit], n[hit], ids[s:e][keep][to[hit]]]))
            all_ = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in all_], ["id", "n", "to"])

    return stored(dealt.join(index, "id").repartition("cell", "bx", "by").sortWithinPartitions("cell", "bx", "by").mapInArrow(compare, "id long, n long, to long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a row of vectors: id, n_links, component_id, kept."""
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).where("id is not null and label is not null and v is not null")
    if not own.groupBy("id").count().where("count > 1").isEmpty():
        own = own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    found = linked(own)
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    parts = components(found.where("id <> to"), "id", "to")
    out = ids.join(links, "id", "left").join(parts, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"))


def op1_lattice(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP1_SQL = """
WITH RECURSIVE vec AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id),
part AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
own AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN own USING (vec_id) LEFT JOIN part ON part.id = vec_id
"""
