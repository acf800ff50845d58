"""The knowledge graph: structural and semantic edges, hubs, surprises, communities, paths."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.vectors import dot, small, unit
from tarnwick.params import DEFAULTS, Params

#: Vertices and edges up to which the sequential algorithms run in one task.
ONE_TASK = 2_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, with the set of kinds; self-loops go."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def degrees(edges: DataFrame) -> DataFrame:
    """Undirected degree: (file, degree)."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("file")).groupBy("file").agg(F.count("*").alias("degree"))


def god_nodes(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.col("degree").desc(), "file").limit(k)


#: Vectors of a block, and vectors up to which one side is a single block sent to all tasks.
BLOCK, ONE_SIDE = 4096, 20_000


def similarities(files: DataFrame, least: float, top: int | None = None) -> DataFrame:
    """Pairs (a, b, cosine) of skeleton vectors, both ways, of at least this cosine; of each a only the first few of a block, if top says so.

    Vectors are dealt to blocks of about BLOCK; each task multiplies one pair of blocks, so it holds two blocks and
    a strip of their product, nothing is collected and, with top, each block gives a few rows a vector.
    """
    v = files.where("skel_vec is not null").select("path", F.transform("skel_vec", lambda x: x.cast("double")).alias("v"))
    n = v.count()
    blocks = 1 if n <= ONE_SIDE else -(-n // BLOCK)
    own = v.withColumn("own", F.pmod(F.xxhash64("path"), F.lit(blocks)))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left, right = own.select("path", "v", F.col("own").alias("x"), F.lit(True).alias("here")).withColumn("y", numbers), own.select("path", "v", F.col("own").alias("y"), F.lit(False).alias("here")).withColumn("x", numbers).select("path", "v", "x", "here", "y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = [pdf[pdf["here"] == h].sort_values("path") for h in (True, False)]
        a, b = (np.stack(s["v"].to_numpy()) if len(s) else np.zeros((0, 1)) for s in sides)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": str, "b": str, "cosine": float})
        a, b = (m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) > 0, norm, 1) for m in (a, b))
        names, others = sides[0]["path"].to_numpy(), sides[1]["path"].to_numpy()
        for at in range(0, len(a), 512):
            cos = np.round(a[at : at + 512] @ b.T, 6) + 0.0
            cos[names[at : at + 512][:, None] == others[None]] = -2  # a file isn't its own neighbour
            if top is not None and top < len(others):
                order = np.argsort(-cos, axis=1, kind="stable")[:, :top]  # others are in order, so ties go to the first name
                i, j = np.repeat(np.arange(len(cos)), top), order.ravel()
            else:
                i, j = (x.ravel() for x in np.indices(cos.shape))
            keep = (cos[i, j] >= least) & (cos[i, j] > -1.5)
            out.append(pd.DataFrame({"a": names[at + i[keep]], "b": others[j[keep]], "cosine": cos[i[keep], j[keep]]}))
        return pd.concat(out)

    return left.unionByName(right).groupBy("x", "y").applyInPandas(run, "a string, b string, cosine double")


def similarities_to(files: DataFrame, path: str, least: float) -> DataFrame:
    """One file's neighbours: (b, cosine)."""
    row = files.where((F.col("path") == path) & F.col("skel_vec").isNotNull()).select("skel_vec").first()
    if row is None:
        return files.where("false").select(F.col("path").alias("b"), F.lit(0.0).alias("cosine"))
    other = files.where((F.col("path") != path) & F.col("skel_vec").isNotNull())
    cosine = F.round(dot(unit(F.col("skel_vec")), unit(F.lit([float(x) for x in row["skel_vec"]]))), 6)
    return other.select(F.col("path").alias("b"), cosine.alias("cosine")).where(F.col("cosine") >= least)


def semantic_edges(files: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Each file's nearest few of at least semantic_min, made symmetric: (a, b, cosine), a < b."""
    near = similarities(files, p.semantic_min, p.semantic_top).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))).where(F.col("r") <= p.semantic_top)
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))


def surprises(files: DataFrame, edges: DataFrame, communities: DataFrame, p: Params = DEFAULTS, k: int = 10) -> DataFrame:
    """Similar pairs without a structural edge whose communities differ."""
    pairs = similarities(files, p.surprise_min).where("a < b").join(undirected(edges).select("a", "b"), ["a", "b"], "left_anti")
    of = lambda x: communities.select(F.col("file").alias(x), F.col("community").alias("c" + x))
    return pairs.join(small(of("a")), "a").join(small(of("b")), "b").where("ca <> cb").select("a", "b", "cosine").orderBy(F.col("cosine").desc(), "a", "b").limit(k)


def _propagate(nodes: list[str], links: list[tuple[str, str, float]], rounds: int = 50) -> dict[str, int]:
    """Label propagation in ascending order of nodes, with updates in place; ties go to the smallest label."""
    near: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
    label = {n: i for i, n in enumerate(sorted(nodes))}
    for _ in range(rounds):
        changed = False
        for n in sorted(nodes):
            votes: dict[int, float] = defaultdict(float)
            for m, w in near[n]:
                votes[label[m]] += w
            if votes:
                best = min(votes, key=lambda x: (-round(votes[x], 9), x))
                if best != label[n]:
                    label[n], changed = best, True
        if not changed:
            break
    size: dict[int, int] = defaultdict(int)
    for x in label.values():
        size[x] += 1
    rank = {x: i for i, x in enumerate(sorted(size, key=lambda x: (-size[x], x)))}
    return {n: rank[x] for n, x in label.items()}


def communities(files: DataFrame, edges: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(file, community), numbered by size.  The algorithm is sequential, so it runs in one task; above ONE_TASK links use synchronous_communities."""
    links = undirected(edges).select("a", "b", F.size("kinds").cast("double").alias("w"))
    if semantic is not None:
        links = links.unionByName(semantic.select("a", "b", (0.5 * F.col("cosine")).alias("w")))
    links = links.groupBy("a", "b").agg(F.sum("w").alias("w"))
    rows = links.unionByName(files.select(F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["b"].notna()]
        own = set(pdf.loc[pdf["b"].isna(), "a"])
        pairs = [(a, b, w) for a, b, w in sorted(zip(known["a"], known["b"], known["w"])) if a in own and b in own]
        return pd.DataFrame(sorted(_propagate(sorted(own), pairs).items()), columns=["file", "community"]).astype({"community": "int64"})

    if rows.limit(ONE_TASK + 1).count() > ONE_TASK:
        raise ValueError("too many links for one task; use synchronous_communities")
    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: run(pdf.drop(columns="one")), "file string, community long")


def synchronous_communities(files: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """A distributed variant, all labels updated at once; its communities differ from the sequential ones."""
    links = undirected(edges).select("a", "b", F.size("kinds").alias("w"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    label = files.select(F.col("path").alias("file"), F.col("path").alias("label"))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("file").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        votes = votes.unionByName(label.select(F.col("file").alias("a"), "label", F.lit(1).cast("long").alias("w"))).groupBy("a", "label").agg(F.sum("w").alias("w"))
        label = votes.groupBy("a").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")).withColumnRenamed("a", "file").checkpoint()
    return label.withColumnRenamed("label", "community")


def fingerprint(files: DataFrame, edges: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row: a hash of the paths, the number of edges and the thresholds; per-path hashes are summed, so nothing is collected."""
    f = files.agg(F.count("*").alias("files"), F.sum(F.xxhash64("path").cast("decimal(38,0)")).cast("string").alias("paths"))
    e = edges.where("src <> dst").select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    return f.crossJoin(F.broadcast(e)).select(F.sha1(F.to_json(F.struct("files", "paths", "edges", F.lit(json.dumps([p.semantic_min, p.semantic_top, p.surprise_min])).alias("t")))).alias("fingerprint"))


def resolve_node(files: DataFrame, said: str, vector: list[float] | None = None) -> DataFrame:
    """One row: the exact path, else the first that ends with it, else the nearest skeleton (tests count 0.85)."""
    rank = F.when(F.col("path") == said, 0).when(F.col("path").endswith("/" + said), 1)
    named = files.select("path", rank.alias("r"), F.lit(0.0).alias("s")).where("r is not null")
    if vector is not None:
        s = dot(unit(F.col("skel_vec")), F.lit(vector)) * F.when(T.is_test_path("path"), 0.85).otherwise(1.0)
        named = named.unionByName(files.where("skel_vec is not null").select("path", F.lit(2).alias("r"), s.alias("s")))
    return named.orderBy("r", F.col("s").desc(), "path").limit(1).select("path")


def tolls(degree: dict[str, int], nodes: list[str]) -> dict[str, int]:
    """What it costs to pass through a node: package files, tests, and hubs above the 90th percentile."""
    deg = sorted(degree.get(n, 0) for n in nodes)
    floor = max(8, deg[min(len(deg) - 1, int(len(deg) * 0.90))]) if deg else 8
    out = {}
    for n in nodes:
        d = degree.get(n, 0)
        out[n] = (4 if n.endswith("__init__.py") else 0) + (4 if T.is_test(n) else 0) + (3 + d - floor if d > floor else 0)
    return out


def shortest_path(edges: DataFrame, semantic: DataFrame | None, start: str, goal: str) -> list[str]:
    """Cheapest path: a structural hop costs 2, a semantic one 3, plus the toll of nodes between; ties by name.

    The graph of one repository is small by construction; its size is checked before it is brought to the driver.
    """
    links = undirected(edges).select("a", "b", F.lit(2).alias("w"))
    if semantic is not None:
        links = links.unionByName(semantic.select("a", "b", F.lit(3).alias("w")))
    rows = links.groupBy("a", "b").agg(F.min("w").alias("w")).limit(ONE_TASK + 1).collect()
    if len(rows) > ONE_TASK:
        raise ValueError("the graph is too large for the driver; use within_hops")
    near: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for r in rows:
        near[r["a"]].append((r["b"], r["w"]))
        near[r["b"]].append((r["a"], r["w"]))
    toll = tolls({n: len(x) for n, x in near.items()}, sorted(near))
    heap, done = [(0, [start])], set()
    while heap:
        cost, path = heapq.heappop(heap)
        at = path[-1]
        if at == goal:
            return path
        if at in done:
            continue
        done.add(at)
        for m, w in near[at]:
            if m not in done:
                heapq.heappush(heap, (cost + w + (0 if m == goal else toll.get(m, 0)), [*path, m]))
    return []


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Breadth-first search: starts (file) -> (file, hops), with a join a hop."""
    pairs = undirected(edges).select("a", "b")
    both = pairs.union(pairs.select("b", "a")).persist()
    seen = starts.select("file", F.lit(0).alias("hops"))
    front = seen
    for k in range(1, hops + 1):
        front = both.join(small(front.select(F.col("file").alias("a"))), "a").select(F.col("b").alias("file")).distinct().join(seen, "file", "left_anti").withColumn("hops", F.lit(k)).persist()
        seen = seen.unionByName(front)
    return seen


def central_files(files: DataFrame, edges: DataFrame, symbols: DataFrame, k: int = 12) -> DataFrame:
    """Most connected files, three points a neighbour and one a symbol; tests and demonstrations left out."""
    names = symbols.groupBy("file").agg(F.count("*").alias("symbols"))
    rows = files.select(F.col("path").alias("file")).join(degrees(edges), "file", "left").join(names, "file", "left")
    score = 3 * F.coalesce("degree", F.lit(0)) + F.coalesce("symbols", F.lit(0))
    return rows.where(~T.is_test_path("file") & ~T.is_demo_path("file")).select("file", score.alias("score")).orderBy(F.col("score").desc(), "file").limit(k)
