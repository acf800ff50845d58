"""Removing repeated passages: common-prefix intervals of an enhanced suffix array.

A byte goes if a LENGTH-byte string that covers it also starts earlier (a smaller doc_id, or
the same document).  The corpus' suffixes are far too many for one array, so they are dealt
by anchors first:

1. Documents equal to one of smaller id are repeats as a whole; the rest go on.
2. Anchors are the smallest hashes of GRAM bytes in each window of SPREAD places, so any
   two equal LENGTH-byte strings hold the same anchor at the same place.  An anchor's
   context reaches LENGTH - GRAM bytes to its left and LENGTH bytes to its right and so holds
   all those strings.  Anchors are shuffled by hash and streamed in order.  Anchors of one
   document go; where contexts agree, all but the first occurrence are repeats as a whole.
   First occurrences of differing contexts go on.
3. Their contexts are gathered by anchor, and the suffixes of a batch of contexts are sorted
   by prefix doubling.  Suffixes that share LENGTH bytes form a run.  A run whose left
   neighbours agree is part of the run one byte to the left and is passed over; in the others
   a stack scan of common prefixes yields the tree of intervals, each a maximal repeat with
   all its occurrences, of which all but the first are removed.
   An anchor with more than GROUP (16 384) contexts is worked out from its strings' hashes instead,
   by a grouped minimum, with the same result.
4. Removed ranges meet by document; only documents that have some are joined with them.

All keys are hashes of 64 bits (128 for whole texts and for step 3's large groups).
Null texts count as empty, and a null id comes before all others.  Rows with one id are one
document by order of start, repeated rows get equal results.  Texts under LENGTH bytes are
kept whole; very long texts are worked on whole, in pieces.  An empty table gives an empty result.
Only id and text are read, so extra columns of any name clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.arrow import pieces, raw, sized, whole_groups
from tarnwick.llm.common import few, only_in, stored, table

LENGTH = 100
GRAM = 37
SPREAD = LENGTH - GRAM + 1  # 64 places
LEFT = LENGTH - GRAM
WIDE = LEFT + LENGTH
GROUP = 16384
BATCH = 3000
COMBINE = 300_000  # anchors of a task whose equal contexts are combined before the shuffle
STEP = 1 << 21
LOW = -(2**63)
U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _joined(h: np.ndarray, s: int) -> np.ndarray:
    """Hashes of strings longer by s, from those at places s apart."""
    x = h[:-s] ^ (h[:-s] >> U(29))
    x *= M2
    x += h[s:]
    return x


def grams(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    h = (text.astype(U) + U(1)) * M1
    for s in (1, 2, 4, 8, 16):
        h = _joined(h, s)
    h = _joined(h, GRAM - 32)
    h ^= h >> U(33)
    h *= M3
    h ^= h >> U(29)
    return h


def _sliding(f, a: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while k < width:
        s = min(k, width - k)
        a = f(a[:-s], a[s:])
        k += s
    return a


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and context hashes of the anchors of a text of at least LENGTH bytes.  Worked on in pieces; none is left out."""
    at, hs, cs = [], [], []
    n = len(text)
    for lo in range(0, n - LENGTH + 1, STEP):  # this piece's windows begin at lo .. hi - 1
        hi = min(n - LENGTH + 1, lo + STEP)
        a, b = max(0, lo - LEFT), min(n, hi - 1 + LENGTH + LENGTH)  # so that every context is whole
        g = grams(text[a:b])
        own = g[lo - a : hi - a + SPREAD - 1]
        low = _sliding(np.minimum, own, SPREAD)
        edge = np.zeros(SPREAD - 1, dtype=U)
        p = np.flatnonzero(own == _sliding(np.maximum, np.concatenate([edge, low, edge]), SPREAD)) + lo
        left, right = np.minimum(LEFT, p), np.minimum(LENGTH, n - p)
        first, last = p - left, p + right - GRAM
        c = left.astype(U) * M1 + right.astype(U)
        for j in range(-(-WIDE // GRAM)):
            c = (c ^ (c >> U(30))) * M2 + g[np.minimum(first + GRAM * j, last) - a]
        at.append(p)
        hs.append(g[p - a])
        cs.append(c)
    p, h, c = np.concatenate(at), np.concatenate(hs), np.concatenate(cs)
    if n - LENGTH + 1 > STEP:
        p, keep = np.unique(p, return_index=True)
        h, c = h[keep], c[keep]
    return p, h, c


def anchored(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> rows (h, c, id, p, r): anchor hash, context hash, place, bytes to the right in the context.

    A task combines what it has: of the occurrences of one context among its last COMBINE anchors only
    the first goes on; the others are surely repeats, marked by a negative r and dealt out evenly (by a
    hash of their place as h), so that a common passage sends a few rows a task to its anchor.
    """

    def combined(held: list[tuple]) -> pa.RecordBatch:
        h, c, i, p, r = (np.concatenate(x) for x in zip(*held))
        key = h * M1 + c
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        twin = order[same | np.append(same[1:], False)]  # only contexts that come more than once
        twin = twin[np.lexsort((p[twin], i[twin], key[twin]))]
        head = twin[np.maximum.accumulate(np.where(np.concatenate([[True], key[twin][1:] != key[twin][:-1]]), np.arange(len(twin)), 0))] if len(twin) else twin
        again = (i[twin] == i[head]) & (p[twin] == p[head])  # the first itself, and repeated rows of one document
        rest, keep = twin[~again], np.ones(len(h), dtype=bool)
        keep[twin[again & (twin != head)]] = False
        h[rest] = (i[rest].view(U) ^ (p[rest].astype(U) * M3)) * M2
        r[rest] = -r[rest]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h.view(np.int64), c.view(np.int64), i, p.astype(np.int32), r.astype(np.int32))], ["h", "c", "id", "p", "r"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in it:
            for part, texts in pieces(batch, "text"):
                for i, t in zip(part.column("id").to_pylist(), texts):
                    if len(t) >= LENGTH:
                        p, h, c = anchors(np.frombuffer(t, dtype=np.uint8))
                        held.append((h, c, np.full(len(p), i, dtype=np.int64), p, np.minimum(LENGTH, len(t) - p)))
                if sum(len(x[0]) for x in held) > COMBINE:
                    yield combined(held)
                    held = []
        if held:
            yield combined(held)

    return sized(docs).mapInArrow(run, "h long, c long, id long, p int, r int")


def sorted_out(rows: DataFrame) -> DataFrame:
    """Anchors -> rows (id, s, e, h): with null h a repeated range; else a first occurrence's context, one of several of anchor h.

    Streams each anchor's rows in the order of context and occurrence.  It holds what it needs of the
    current anchor alone: its first occurrence until another context is seen.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the current anchor: its hash, its context, that context's first (id, p, r), and whether it was given out
        for batch in it:
            if not batch.num_rows:
                continue
            h, c, i, p, r = (batch.column(k).to_numpy() for k in ("h", "c", "id", "p", "r"))
            known = r < 0
            if known.any():  # repeats that a task had found
                lo = p[known] - np.minimum(LEFT, p[known])
                yield pa.RecordBatch.from_arrays([pa.array(i[known]), pa.array(lo.astype(np.int32)), pa.array((p[known] - r[known]).astype(np.int32)), pa.nulls(known.sum(), pa.int64())], ["id", "s", "e", "h"])
                h, c, i, p, r = (x[~known] for x in (h, c, i, p, r))
                if not len(h):
                    continue
            if held is not None:  # goes on in front
                h, c, i, p, r = (np.concatenate([[x], y]) for x, y in zip(held[:5], (h, c, i, p, r)))
            n = len(h)
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            first = np.maximum.accumulate(np.where(new_c, np.arange(n), 0))
            again = ~new_c & ((i != i[first]) | (p != p[first]))
            group = np.cumsum(new_h) - 1
            several = (np.bincount(group, weights=new_c) > 1)[group]
            before = held is not None and held[5]
            if before:
                several = several | (group == 0)
            give = new_c & several
            f = first[-1]
            given = bool(give[f]) or (before and f == 0)
            if before:
                give[0] = False  # was given out in the batch before
            ids, start = np.concatenate([i[again], i[give]]), np.concatenate([p[again] - np.minimum(LEFT, p[again]), p[give] - np.minimum(LEFT, p[give])])
            end = np.concatenate([p[again] + r[again], p[give] + r[give]])
            key = pa.array(np.concatenate([np.zeros(again.sum(), dtype=np.int64), h[give]]), mask=np.concatenate([np.ones(again.sum(), dtype=bool), np.zeros(give.sum(), dtype=bool)]))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), key], ["id", "s", "e", "h"])
            held = (h[f], c[f], i[f], p[f], r[f], given)

    return rows.repartition("h").sortWithinPartitions("h", "c", "id", "p").mapInArrow(run, "id long, s int, e int, h long")


def _ranks(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(key, axis=None)
    sorted_ = key.ravel()[order]
    rank = np.zeros(len(order), dtype=np.int32)
    np.cumsum(sorted_[1:] != sorted_[:-1], out=rank[1:])
    out = np.empty_like(rank)
    out[order] = rank
    return out.reshape(key.shape)


def repeats(ids: np.ndarray, start: np.ndarray, texts: list[bytes]) -> list[tuple[int, int, int]]:
    """Ranges (id, s, e) that are covered by repeats of earlier strings, among these contexts (id, first place, bytes)."""
    m = len(texts)
    size = np.array([len(t) for t in texts])
    x = np.zeros((m, WIDE + 8), dtype=np.uint8)
    for k, t in enumerate(texts):
        x[k, : len(t)] = np.frombuffer(t, dtype=np.uint8)
    wide = np.lib.stride_tricks.sliding_window_view(x, 8, axis=1)[:, : WIDE - 7]
    rank = _ranks(np.ascontiguousarray(wide).view(">u8")[..., 0].astype(U))
    have = 8
    while have < LENGTH:  # ranks of prefixes twice as long, at last of LENGTH bytes
        step = min(have, LENGTH - have)
        rank = _ranks(rank[:, :-step].astype(np.int64) << 32 | rank[:, step:])
        have += step
    rank = rank[:, :SPREAD]
    ctx, off = np.nonzero(np.arange(rank.shape[1])[None] <= (size - LENGTH)[:, None])
    sid, spos, rank = ids[ctx], start[ctx] + off, rank[ctx, off]
    order = np.lexsort((spos, sid, rank))
    ctx, off, sid, spos, rank = ctx[order], off[order], sid[order], spos[order], rank[order]
    new = np.concatenate([[True], rank[1:] != rank[:-1]])
    run = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    left = np.where(off > 0, x[ctx, np.maximum(off - 1, 0)].astype(np.int64), -1 - np.arange(len(off)))  # an unknown neighbour agrees with none
    many = (sid != sid[head[run]]) | (spos != spos[head[run]])
    diverse = (np.maximum.reduceat(left, head) != np.minimum.reduceat(left, head)) & np.logical_or.reduceat(many, head)
    take = np.flatnonzero(diverse[run])
    if not len(take):
        return []
    ctx, off, sid, spos, run = ctx[take], off[take], sid[take], spos[take], run[take]
    rest = WIDE - LENGTH
    tail = np.zeros((len(ctx), rest + 1), dtype=np.uint8)
    cols = off[:, None] + LENGTH + np.arange(rest)[None]
    inside = cols < size[ctx][:, None]
    tail[:, :rest] = np.where(inside, x[ctx[:, None], np.minimum(cols, WIDE)], 0)
    words = tail.reshape(len(ctx), -1, 8).view(">u8")[..., 0].astype(U)
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), run))
    ctx, off, sid, spos, run, tail, inside = (v[order] for v in (ctx, off, sid, spos, run, tail, inside))
    same = (tail[1:, :rest] == tail[:-1, :rest]) & inside[1:] & inside[:-1]
    lcp = np.where(run[1:] == run[:-1], LENGTH + np.where(same.all(axis=1), rest, same.argmin(axis=1)), 0)
    return _intervals(sid, spos, np.append(lcp, 0))


def _intervals(sid: np.ndarray, spos: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Stack scan: lcp[k] is the common prefix of suffixes k and k + 1.  For each interval all occurrences but the first are given out, to its length.

    An occurrence is given out once, with the longest interval in which it isn't the first.
    """
    out: dict[tuple[int, int], int] = {}
    stack: list[int] = []  # common prefixes of the open intervals
    firsts = list(zip(sid.tolist(), spos.tolist()))
    members: list[list[int]] = []  # of each open interval: its suffixes, an inner interval by its earliest
    for k, depth in enumerate(lcp.tolist()):
        own = [k]
        while stack and stack[-1] > depth:
            length = stack.pop()
            inner = members.pop() + own
            own = [_close(inner, firsts, length, out)]
        if depth >= LENGTH:
            if stack and stack[-1] == depth:
                members[-1] += own
            else:
                stack.append(depth)
                members.append(own)
    return [(i, s, s + n) for (i, s), n in out.items()]


def _close(inner: list[int], firsts: list[tuple[int, int]], length: int, out: dict[tuple[int, int], int]) -> int:
    """Give out all occurrences of a closed interval but the earliest, which stands for it in the interval around."""
    first = min(inner, key=firsts.__getitem__)
    for k in inner:
        at = firsts[k]
        if at != firsts[first] and out.get(at, 0) < length:
            out[at] = length
    return first


def contexts(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """firsts (id, s, e, h) with the bytes of the range, t.  The texts are joined once a document."""
    by = firsts.groupBy("id").agg(F.collect_list(F.struct("s", "e", "h")).alias("own"))  # as many as a text has anchors
    here = only_in(docs, stored(firsts.select("id").distinct()), "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in pieces(batch, "text"):
                lists = part.column("own")
                n = np.diff(lists.offsets.to_numpy()[: part.num_rows + 1])
                flat = lists.flatten()
                s, e, h = (flat.field(k).to_numpy() for k in range(3))
                doc = np.repeat(np.arange(part.num_rows), n)
                ids = part.column("id").to_numpy()[doc]
                for at in range(0, len(s), 20_000):
                    t = [texts[d][x:y] for d, x, y in zip(doc[at : at + 20_000], s[at : at + 20_000], e[at : at + 20_000])]
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 20_000]), pa.array(ids[at : at + 20_000]), pa.array(s[at : at + 20_000]), pa.array(t, pa.binary())], ["h", "id", "s", "t"])

    return sized(here).join(by, "id").select("id", "text", "own").mapInArrow(run, "h long, id long, s int, t binary")


def by_arrays(rows: DataFrame) -> DataFrame:
    """Contexts (h, id, s, t) -> repeated ranges (id, s, e), by suffix arrays of batches of whole anchors."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, at in whole_groups(it, ("h",)):
            ids, s, t = group.column("id").to_numpy(), group.column("s").to_numpy().astype(np.int64), raw(group.column("t").combine_chunks())
            lo, out = 0, []
            for hi in range(1, len(at)):
                if hi == len(at) - 1 or at[hi + 1] - at[lo] > BATCH:  # whole anchors, at most BATCH contexts or one anchor
                    a, b = at[lo], at[hi]
                    out += repeats(ids[a:b], s[a:b], t[a:b])
                    lo = hi
            if out:
                i, x, y = (np.array(v, dtype=np.int64) for v in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], ["id", "s", "e"])

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "id long, s int, e int")


def by_hashes(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: every string of LENGTH bytes by its hash, and the first place of each by a grouped minimum."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            k, i, p = [], [], []
            for d, s, t in zip(batch.column("id").to_pylist(), batch.column("s").to_pylist(), raw(batch.column("t"))):
                for o in range(len(t) - LENGTH + 1):
                    k.append(hashlib.blake2b(t[o : o + LENGTH], digest_size=16).digest())
                    i.append(d)
                    p.append(s + o)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(i, pa.int64()), pa.array(p, pa.int32())], ["k", "id", "s"])

    places = stored(rows.mapInArrow(run, "k binary, id long, s int"))
    first = places.groupBy("k").agg(F.min(F.struct("id", "s")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return places.join(first, "k").where("id <> f.id or s <> f.s").select("id", "s", (F.col("s") + LENGTH).cast("int").alias("e"))


def ranges(docs: DataFrame) -> DataFrame:
    """docs (id, text), no text twice -> repeated ranges (id, s, e); they may overlap."""
    found = stored(sorted_out(anchored(docs)))
    firsts = found.where("h is not null")
    sizes = firsts.groupBy("h").count().where(F.col("count") > GROUP).select("h")
    rows = stored(contexts(firsts, docs))
    sizes = stored(sizes)
    out = found.where("h is null").select("id", "s", "e")
    if sizes.isEmpty():
        return out.union(by_arrays(rows))
    sizes = F.broadcast(sizes) if few(sizes) else sizes
    return out.union(by_arrays(rows.join(sizes, "h", "left_anti"))).union(by_hashes(rows.join(sizes, "h", "left_semi")))


def merged(own: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in own):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_bytes, n_removed, n_spans, kept_sha256."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOW))
    rows = docs.select(F.col(id_col).alias("own_id"), key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = stored(rows.select("id", F.md5("text").alias("m")))
    first = sums.groupBy("m").agg(F.min("id").alias("f"), F.max("id").alias("z")).where("z > f")
    copies = stored(sums.join(first, "m").where("id <> f").select("id", "m").distinct())
    size, n = F.octet_length("text").cast("long"), F.lit(0).cast("long")

    def whole(df: DataFrame, gone: bool) -> DataFrame:
        """Documents that are kept whole, or copies, which go if they have a string to compare."""
        out = (size >= LENGTH) & F.lit(gone)
        return df.select("own_id", size.alias("n_bytes"), F.when(out, size).otherwise(n).alias("n_removed"), F.when(out, n + 1).otherwise(n).alias("n_spans"), F.sha2(F.when(out, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"))

    small = few(copies)
    part = F.broadcast(copies) if small else copies
    marked = rows if copies.isEmpty() else rows.withColumn("m", F.md5("text"))
    copied = None if copies.isEmpty() else marked.join(part, ["id", "m"], "left_semi")
    own = rows if copies.isEmpty() else marked.join(part, ["id", "m"], "left_anti").drop("m")
    cuts = stored(ranges(own.select("id", "text")).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("cuts")))
    ids = cuts.select("id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece, texts in pieces(batch, "text"):
                gone, spans, sums = [], [], []
                for t, cut in zip(texts, piece.column("cuts").to_pylist()):
                    at, sha, total = 0, hashlib.sha256(), 0
                    cut = merged(cut)
                    for s, e in cut:
                        sha.update(t[at:s])
                        total += e - s
                        at = e
                    sha.update(t[at:])
                    gone.append(total)
                    spans.append(len(cut))
                    sums.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column("own_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums)], ["own_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    mark = F.broadcast(ids) if few(ids) else ids
    with_cuts = own.join(mark, "id", "left_semi").join(cuts, "id").select("own_id", "text", "cuts")
    out = whole(own.join(mark, "id", "left_anti"), False).union(sized(with_cuts).mapInArrow(run, f"own_id {dict(rows.dtypes)['own_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return (out if copied is None else out.union(whole(copied, True))).withColumnRenamed("own_id", id_col)


def op3_suffix(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns of removed() over all documents."""
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
place AS (SELECT doc_id, s, hash(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM doc)),
ordered AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM place),
gone AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM ordered WHERE r > 1),
isle AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM gone),
cut AS (SELECT doc_id, i, min(s) AS lo, max(s) + 100 AS hi FROM isle GROUP BY doc_id, i),
cuts AS (SELECT doc_id, list({'lo': lo, 'hi': hi} ORDER BY lo) AS c FROM cut GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(list_sum(list_transform(c, lambda x: x.hi - x.lo)), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(c), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(c) + 2), lambda i: substr(h, 2 * coalesce(c[i - 1].hi, 0) + 1, 2 * (coalesce(c[i].lo, n) - coalesce(c[i - 1].hi, 0)))), '') END)) AS kept_sha256
FROM doc LEFT JOIN cuts USING (doc_id)
"""
