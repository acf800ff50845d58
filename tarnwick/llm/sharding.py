"""Sharding by sampled splitters.

Records are ordered by (text key, doc_id), where the text key is the first 60 bits
of the text's MD5; rows with equal texts share it and stand side by side.

1. A size-weighted sample of keys is drawn (exponential clocks, so that a row's chance
   follows its size), a number for each range of RANGE_BYTES; every k-th sampled key is a
   range boundary.
2. Groups of equal texts over 1/KEEP of a shard are measured.  From the largest down, each is
   given a home, the shard with the least in it so far, if it fits there; such a group stays
   whole.  Of the others (a group larger than a shard, or that fits nowhere) each row is on its own.
   There can be no more than KEEP groups a shard of that size.
3. Rows are counted and measured per range.  A range over four times the mean is sampled
   again and subdivided, in at most ROUNDS rounds (one that stays large costs time, not
   correctness); a text key that fills several ranges is subdivided by doc_id.
4. The ranges without homes are laid end to end.  Their exact sizes give each row its place in
   that order, and the order fills what the homes left of each shard: a row's shard is the one in which
   the middle of its unit falls.  A unit is a group of equal texts up to 1/KEEP of a shard, else a row.

Law ``bytes``: shard sizes differ from the mean by no more than the larger of one row
and 1/KEEP of a shard, on either side.  The sample steers only how work is spread; the shards and
slots do not depend on it, so reruns agree.  In a shard the homes come first, then rows in order.

Null texts count as empty; null ids come first; repeated rows each take a slot and stand together;
very long texts are whole; an empty table gives an empty result.  Columns of the input with the name
of an output column are replaced, unless shard() is told to keep them under another name.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import stored

SHARDS = 40
RANGES_PER_SHARD = 32  # at least
RANGE_BYTES = 128 << 20  # of text; a table with more than MOST_RANGES of them gets larger ones
MOST_RANGES = 1 << 15
SAMPLES_PER_RANGE = 16
ROUNDS = 3
KEEP = 20  # groups of equal texts over 1/KEEP of a shard are placed one by one
OVERHEAD = 16
LOW = -(2**63)


def text_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with _tw_h, _tw_id, _tw_size."""
    return df.withColumns({"_tw_h": text_key(F.col(text_col)), "_tw_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)), "_tw_size": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + OVERHEAD})


def _sample(keys: DataFrame, n: int, seed: int, total: int | None) -> list[tuple[int, int, int]]:
    """About n keys of total bytes, with their sizes, each drawn by its size: those whose exponential clock, as fast as their size, rings early enough."""
    if not total:
        return []
    u = (F.pmod(F.xxhash64("_tw_h", "_tw_id", F.lit(seed)), F.lit(2**52)) + 1) / float(2**52)
    rows = keys.where(-F.log(u) / F.col("_tw_size") <= n / total).select("_tw_h", "_tw_id", "_tw_size").collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


class Splitters:
    """Sorted boundaries; range r holds the keys from boundary r - 1 to below boundary r."""

    def __init__(self, cuts: list[tuple[int, int]]):
        self.cuts = sorted(set(cuts))
        heads = [h for h, _ in self.cuts]
        self.hot = {h for h, i in self.cuts if i != LOW}
        self.h = np.array(heads, dtype=np.int64)
        self.ids = {h: np.array([i for g, i in self.cuts if g == h and i != LOW], dtype=np.int64) for h in self.hot}

    @staticmethod
    def drawn(sample: list[tuple[int, int, int]], every: int, alone: frozenset[int] = frozenset()) -> "Splitters":
        """Every so many keys of the sample; the keys alone get ranges of their own."""
        cuts = [(h, i) for h, i, _ in sample[every - 1 :: every]]
        counts: dict[int, int] = {}
        for h, _ in cuts:
            counts[h] = counts.get(h, 0) + 1
        out: list[tuple[int, int]] = [x for h in alone for x in ((h, LOW), (h + 1, LOW))]
        for h, i in cuts:
            if counts[h] == 1 and h not in alone:
                out.append((h, LOW))
            else:
                out += [(h, LOW), (h, i), (h + 1, LOW)]
        return Splitters(out)

    def with_cuts(self, more: "Splitters") -> "Splitters":
        return Splitters(self.cuts + more.cuts)

    def locate(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.h, h, side="left")
        at = np.searchsorted(self.h, h, side="right")
        plain = ~np.isin(h, np.fromiter(self.hot, np.int64, len(self.hot)))
        out[plain] = at[plain]
        for g in np.unique(h[~plain]):
            m = h == g
            out[m] = np.searchsorted(self.h, g, side="left") + 1 + np.searchsorted(self.ids[int(g)], ids[m], side="right")
        return out

    def column(self) -> Column:
        cuts = self

        @F.pandas_udf("int")
        def ranged(h: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(cuts.locate(h.to_numpy(np.int64), i.to_numpy(np.int64)).astype(np.int32))

        return ranged("_tw_h", "_tw_id")


def homes(groups: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """(key, size) of large groups -> the shard of each that has a home, and what each shard holds then."""
    held, out = [0] * shards, {}
    for size, h in sorted((-size, h) for h, size in groups):
        s = min(range(shards), key=held.__getitem__)
        if (held[s] - size) * shards <= total:
            out[h] = s
            held[s] -= size
    return out, held


class Layout:
    """Exact sizes of the ranges, where each begins, and the homes of large groups."""

    def __init__(self, splitters: Splitters, rows: list, shards: int, home: dict[int, int], held: list[int]):
        self.splitters, self.shards, self.home, self.held = splitters, shards, home, held
        self.ranges = sorted((r["_tw_range"], r["n"], r["bytes"]) for r in rows)
        self.n, self.total = sum(r[1] for r in self.ranges), sum(r[2] for r in self.ranges)
        self.keep = self.total // (shards * KEEP)

    def _own(self, h: int) -> range:
        """The ranges of a key that has ranges of its own."""
        first = int(np.searchsorted(self.splitters.h, h)) + 1
        return range(first, first + len(self.splitters.ids.get(h, ())) + 1)

    def table(self, spark) -> DataFrame:
        """One row a range: its first row and byte in the order of the rest, or its shard and first slot if it is of a home; of a small group that was subdivided twice its middle."""
        size = {r: (n, b) for r, n, b in self.ranges}
        at = {r: h for h in self.home for r in self._own(h)}
        slots, lies = [0] * self.shards, {}
        for h in sorted(self.home):
            for r in self._own(h):
                if r in size:
                    lies[r] = slots[self.home[h]]
                    slots[self.home[h]] += size[r][0]
        start, n, b = {}, 0, 0
        for r, k, own in self.ranges:
            if r not in at:
                start[r] = (n, b)
                n, b = n + k, b + own
        mids: dict[int, int | None] = {}
        for h in self.splitters.hot - set(self.home):
            own = [r for r in self._own(h) if r in size]
            whole = sum(size[r][1] for r in own)
            mids |= {r: 2 * start[r0][1] + whole if whole <= self.keep else None for r0 in own[:1] for r in own}
        self.slots = slots
        data = [(r, lies[r], 0, False, None, self.home[at[r]]) if r in at else (r, *start[r], r in mids, mids.get(r), None) for r in size]
        return spark.createDataFrame(data, "_tw_range int, _tw_n0 long, _tw_b0 long, _tw_hot boolean, _tw_mid long, _tw_home int")

    def placed(self, keys: DataFrame) -> DataFrame:
        """keys with _tw_shard, _tw_home and _tw_at: the slot of a row of a home, else its place in the order of the rest.  One shuffle, by range."""
        spark = keys.sparkSession
        parts = max(1, min(len(self.ranges), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(self.n / 500_000))))
        df = keys.withColumn("_tw_range", self.splitters.column()).repartition(parts, "_tw_range")
        order = Window.partitionBy("_tw_range").orderBy("_tw_h", "_tw_id")
        group = Window.partitionBy("_tw_range", "_tw_h")
        df = df.withColumns({"_tw_rn": F.row_number().over(order), "_tw_cum": F.sum("_tw_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_tw_size")})
        df = df.withColumns({"_tw_gt": F.sum("_tw_size").over(group), "_tw_gs": F.min("_tw_cum").over(group)})
        df = df.join(F.broadcast(self.table(spark)), "_tw_range")  # a row a range
        row = 2 * (F.col("_tw_b0") + F.col("_tw_cum")) + F.col("_tw_size")
        whole = 2 * (F.col("_tw_b0") + F.col("_tw_gs")) + F.col("_tw_gt")
        twice = F.when(F.col("_tw_hot"), F.coalesce("_tw_mid", row)).when(F.col("_tw_gt") <= self.keep, whole).otherwise(row)
        free = np.cumsum([2 * (self.total - self.shards * x) for x in self.held])[:-1]  # where each shard's part of the rest ends, times 2 and shards
        ends = F.lit([int(x) for x in free] or [2**62])
        shard = F.coalesce("_tw_home", F.size(F.filter(ends, lambda x: x <= twice * self.shards)))
        return df.withColumns({"_tw_shard": shard, "_tw_at": F.col("_tw_n0") + F.col("_tw_rn") - 1}).drop("_tw_range", "_tw_rn", "_tw_cum", "_tw_gt", "_tw_gs", "_tw_n0", "_tw_b0", "_tw_hot", "_tw_mid")


def layout(keys: DataFrame, shards: int = SHARDS) -> Layout:
    """Draw splitters, find homes for large groups and measure the ranges, subdividing the overfull; keys is read once for each."""
    total = keys.agg(F.sum("_tw_size")).first()[0] or 0
    want = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, total // RANGE_BYTES))
    sample = _sample(keys, want * SAMPLES_PER_RANGE, 17, total)  # at most MOST_RANGES * SAMPLES_PER_RANGE, about
    n = want * SAMPLES_PER_RANGE
    seen: dict[int, float] = {}
    for h, _, size in sample:
        seen[h] = seen.get(h, 0.0) + max(size, total / n)  # what a drawn row stands for, at least
    maybe = [(h,) for h, own in seen.items() if 8 * own >= total / (shards * KEEP)]  # so a large group is missed with a chance of less than one in ten million
    large = []
    if maybe:  # fewer than 8 * shards * KEEP, but for those whose rows are far smaller than a range
        sizes = keys.join(F.broadcast(keys.sparkSession.createDataFrame(maybe, "_tw_h long")), "_tw_h").groupBy("_tw_h").agg(F.sum("_tw_size").alias("b"))
        large = [(r["_tw_h"], r["b"]) for r in sizes.where(F.col("b") > total // (shards * KEEP)).collect()]
    home, held = homes(large, total, shards)
    cuts = Splitters.drawn(sample, SAMPLES_PER_RANGE, frozenset(home))
    for again in range(ROUNDS + 1):
        counts = keys.groupBy(cuts.column().alias("_tw_range")).agg(F.count("*").alias("n"), F.sum("_tw_size").alias("bytes")).collect()  # a row a range
        mean = sum(r["bytes"] for r in counts) / want
        over = [r["_tw_range"] for r in counts if r["n"] > 1 and r["bytes"] > 4 * mean]
        if not over or again == ROUNDS:
            break
        share = sum(r["bytes"] for r in counts if r["_tw_range"] in set(over))
        more = _sample(keys.where(cuts.column().isin(over)), max(2, round(share / mean * SAMPLES_PER_RANGE)), 29 + again, share)
        new = cuts.with_cuts(Splitters.drawn(more, SAMPLES_PER_RANGE if len(more) >= 4 * SAMPLES_PER_RANGE else 1, frozenset(home)))
        if len(new.cuts) == len(cuts.cuts):
            break
        cuts = new
    return Layout(cuts, counts, shards, home, held)


MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, kept: str | None = None) -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard.

    A column of df with one of these names is replaced, or if kept is given, carried along under its name after that prefix.
    """
    clash = [c for c in df.columns if c.lower() in MADE]
    df = df.drop(*clash) if kept is None else df.withColumnsRenamed({c: kept + c for c in clash})
    crc = {"_tw_crc": F.crc32(F.coalesce(F.col(text_col), F.lit("")))}
    narrow = set(df.columns) == {id_col, text_col}
    keys = stored(keyed(df.select(id_col, text_col), id_col, text_col).withColumns(crc).drop(text_col))
    plan = layout(keys.drop("_tw_crc"), shards)
    places = plan.placed(keys.select("_tw_h", "_tw_id", "_tw_size"))
    first = stored(places.where("_tw_home is null").groupBy("_tw_shard").agg(F.min("_tw_at").alias("_tw_first")), shards)  # a row a shard
    rows = plan.placed(keys if narrow else keyed(df, id_col, text_col).withColumns(crc))
    rows = rows.join(F.broadcast(first), "_tw_shard", "left")
    slots = F.element_at(F.lit([int(x) for x in plan.slots]).cast("array<long>"), F.col("_tw_shard") + 1)
    return rows.withColumns({
        "size": F.col("_tw_size"), "text_crc32": F.col("_tw_crc"), "law": F.lit("bytes"), "shard": F.col("_tw_shard"),
        "slot": F.when(F.col("_tw_home").isNotNull(), F.col("_tw_at")).otherwise(F.col("_tw_at") - F.col("_tw_first") + slots), "grown_shard": F.lit(None).cast("int"),
    }).drop("_tw_h", "_tw_id", "_tw_size", "_tw_crc", "_tw_shard", "_tw_at", "_tw_first", "_tw_home")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of shard() over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP4_SQL = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda acc, i: CASE WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, b)) AS t),
doc AS (SELECT doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 16 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
crc AS (SELECT x, xor(list_reduce(list_transform(range(strlen(x)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda acc, b: xor(acc >> 8, t[xor(acc, b) % 256 + 1]), 4294967295), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT x, h FROM doc), bits),
whole AS (SELECT k, sum(size) AS whole FROM doc GROUP BY k), total AS (SELECT sum(size) AS total FROM doc),
large AS (SELECT k, whole, row_number() OVER (ORDER BY whole DESC, k) AS r FROM whole, total WHERE whole > total // (40 * 20)),
fill(r, k, home, held) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, list_transform(range(40), lambda x: 0::HUGEINT)
  UNION ALL SELECT large.r, large.k, CASE WHEN fits THEN s - 1 END, CASE WHEN fits THEN list_transform(held, lambda x, i: CASE WHEN i = s THEN x + whole ELSE x END) ELSE held END
  FROM (SELECT fill.r, fill.held, list_position(fill.held, list_min(fill.held))::INTEGER AS s, list_min(fill.held) AS least FROM fill) AS f JOIN large ON large.r = f.r + 1, LATERAL (SELECT (least + whole) * 40 <= total AS fits FROM total)),
free AS (SELECT list_transform(range(1, 40), lambda i: 2 * (i * total - 40 * list_sum(held[1:i]))) AS ends FROM fill, total ORDER BY r DESC LIMIT 1),
own AS (SELECT doc.*, whole, home FROM doc JOIN whole USING (k) LEFT JOIN fill USING (k)),
place AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS pos FROM own WHERE home IS NULL),
unit AS (SELECT place.*, CASE WHEN whole <= total // (40 * 20) THEN 2 * min(pos) OVER (PARTITION BY k) + whole ELSE 2 * pos + size END AS mid FROM place, total),
put AS (SELECT doc_id, x, size, k, 1 AS late, len(list_filter(ends, lambda e: e <= mid * 40)) AS shard FROM unit, free UNION ALL SELECT doc_id, x, size, k, 0, home FROM own WHERE home IS NOT NULL)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY late, k, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM put JOIN crc USING (x)
"""
