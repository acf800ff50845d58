"""Graph, evaluation, reranking and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators import evaluation as E
from tarnwick.operators import graph as G
from tarnwick.operators import rerank as R
from tarnwick.plans import adapters as A
from tarnwick.plans.retrieval import BUNDLE, RANKED, SCORED, bundle, shortlist
from tarnwick.operators import bundle as B
from tarnwick.streaming import limiter


def god_nodes(spark, sf_dir: str) -> DataFrame:
    return G.god_nodes(A.supply_edges(spark, sf_dir), 25)


def undirected(spark, sf_dir: str) -> DataFrame:
    return G.undirected(A.supply_edges(spark, sf_dir)).select("a", "b", F.array_join("kinds", ",").alias("kinds"))


def semantic_edges(spark, sf_dir: str) -> DataFrame:
    return G.semantic_edges(A.skeletons(spark, sf_dir), G.Params(semantic_min=-1.0))


def surprises(spark, sf_dir: str) -> DataFrame:
    files = A.skeletons(spark, sf_dir)
    parts = files.select(F.col("path").alias("file"), F.substring("path", 1, 3).alias("community"))
    return G.surprises(files, A.label_edges(spark, sf_dir), parts, G.Params(surprise_min=-1.0), 8)


def within_hops(spark, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("supplier/1",)], "file string")
    return G.within_hops(A.supply_edges(spark, sf_dir), start, 2).groupBy("hops").agg(F.count("*").alias("n")).select(F.col("hops").cast("long").alias("hops"), "n")


def communities(spark, sf_dir: str) -> DataFrame:
    """Label propagation over label files; sequential, so no SQL."""
    files = A.skeletons(spark, sf_dir)
    return G.communities(files, A.label_edges(spark, sf_dir), G.semantic_edges(files, G.Params(semantic_min=0.0)))


def central_files(spark, sf_dir: str) -> DataFrame:
    edges = A.supply_edges(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return G.central_files(nodes, edges, spark.createDataFrame([], "file string, name string"), 12).select("file", F.col("score").cast("long").alias("score"))


def recall_at(spark, sf_dir: str) -> DataFrame:
    """A query's own file is its gold."""
    ranked = B.rank_files(shortlist(spark, sf_dir, of_file=1))
    gold = A.table(spark, sf_dir, "embeddings").where(A.in_query_set()).select(F.col("vec_id").alias("qid"), A.label_file(F.col("label")).alias("file"))
    return E.recall_at(ranked, gold)


def bundle_full(spark, sf_dir: str) -> DataFrame:
    gold = A.table(spark, sf_dir, "embeddings").where(A.in_query_set()).select(F.col("vec_id").alias("qid"), A.label_file(F.col("label")).alias("file"))
    return E.bundle_full(bundle(spark, sf_dir), gold)


def rerank_merge(spark, sf_dir: str) -> DataFrame:
    """Verdicts of batches (each keeps two, best first) merged round robin, with the first of all rescued."""
    s = shortlist(spark, sf_dir, of_all=24).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))).where("rank <= 24")
    w = Window.partitionBy("qid", "batch").orderBy((F.col("id") * 7) % 11, "id")
    verdict = s.withColumn("batch", F.floor((F.col("rank") - 1) / 8).cast("int")).withColumn("place", F.row_number().over(w)).where("place <= 2")
    return R.merge_round_robin(verdict.select("qid", "batch", "place", "id"), s.select("qid", "id", "rank")).select("qid", "id", F.col("order").cast("long").alias("order"), "rescued")


def limited(spark, sf_dir: str) -> DataFrame:
    """At most 2 hits of a user an hour; hits that are turned away don't count."""
    return limiter.limited(A.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 2, 3600).groupBy("allowed").agg(F.count("*").alias("n"))


def event_windows(spark, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "v")


def block_probes(spark, sf_dir: str) -> DataFrame:
    from tarnwick.operators.corpus import line_table

    return E.block_probes(line_table(A.files(spark, sf_dir))).select("path", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


QUERIES = {
    "god_nodes": god_nodes, "undirected": undirected, "semantic_edges": semantic_edges, "surprises": surprises, "within_hops": within_hops, "communities": communities, "central_files": central_files,
    "recall_at": recall_at, "bundle_full": bundle_full, "rerank_merge": rerank_merge, "rate_limit": limited, "event_windows": event_windows, "block_probes": block_probes,
}

PAIR = f"e AS ({A.SUPPLY_SQL}), p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, kind FROM e), deg AS (SELECT file, count(*) AS degree FROM (SELECT DISTINCT a AS file, b AS o FROM p UNION SELECT DISTINCT b, a FROM p) GROUP BY file)"
COS = f"skel AS ({A.SKELETON_SQL}), cos AS (SELECT x.path AS a, y.path AS b, round(list_inner_product(list_transform(x.skel_vec, lambda v: v / sqrt(list_inner_product(x.skel_vec, x.skel_vec))), list_transform(y.skel_vec, lambda v: v / sqrt(list_inner_product(y.skel_vec, y.skel_vec)))), 6) AS cosine FROM skel x, skel y WHERE x.path <> y.path)"
GOLD = f"gold AS (SELECT vec_id AS qid, {A.LABEL_FILE_SQL} AS file FROM embeddings WHERE vec_id % 20 = 0)"
from tarnwick.plans.lexical import LINES  # noqa: E402

ORACLES = {
    "god_nodes": f"WITH {PAIR} SELECT file, degree FROM deg ORDER BY degree DESC, file LIMIT 25",
    "undirected": f"WITH {PAIR} SELECT a, b, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM p GROUP BY a, b",
    "semantic_edges": f"WITH {COS} SELECT least(a, b) AS a, greatest(a, b) AS b, max(cosine) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS r FROM cos) WHERE r <= 3 GROUP BY ALL",
    "surprises": f"WITH {COS}, edge AS ({A.LABEL_EDGE_SQL}) SELECT a, b, cosine FROM cos WHERE a < b AND a[:3] <> b[:3] AND NOT EXISTS (SELECT 1 FROM edge WHERE (src = a AND dst = b) OR (src = b AND dst = a)) ORDER BY cosine DESC, a, b LIMIT 8",
    "within_hops": f"""WITH {PAIR}, one AS (SELECT DISTINCT dst AS f FROM e WHERE src = 'supplier/1'), two AS (SELECT DISTINCT src AS f FROM e JOIN one ON dst = f WHERE src <> 'supplier/1')
      SELECT 0::BIGINT AS hops, 1::BIGINT AS n UNION ALL SELECT 1, count(*) FROM one UNION ALL SELECT 2, count(*) FROM two""",
    "central_files": f"WITH {PAIR} SELECT file, 3 * degree AS score FROM deg ORDER BY score DESC, file LIMIT 12",
    "recall_at": f"WITH {SCORED}, {RANKED}, {GOLD} SELECT avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_5, count(*) AS queries FROM gold LEFT JOIN ranked USING (qid, file)",
    "bundle_full": f"WITH {SCORED}, {RANKED}, {BUNDLE}, {GOLD} SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM bundle b WHERE b.qid = gold.qid AND b.file = gold.file) THEN 1.0::DOUBLE ELSE 0 END) AS bundle_full, count(*) AS queries FROM gold",
    "rerank_merge": f"""WITH {SCORED}, s AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored), t AS (SELECT *, (rank - 1) // 8 AS batch FROM s WHERE rank <= 24),
      v AS (SELECT *, row_number() OVER (PARTITION BY qid, batch ORDER BY (id * 7) % 11, id) AS place FROM t), k AS (SELECT qid, id, place, batch, false AS rescued FROM v WHERE place <= 2),
      a AS (SELECT * FROM k UNION ALL SELECT qid, id, 1000000, 0, true FROM t WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.qid = t.qid AND k.id = t.id))
      SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, batch) AS "order", rescued FROM a""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      r(user_id, k, held, allowed) AS (SELECT user_id, k, [t], true FROM e WHERE k = 1
        UNION ALL SELECT user_id, k, CASE WHEN len(own) < 2 THEN list_append(own, t) ELSE own END, len(own) < 2 FROM (SELECT e.user_id, e.k, e.t, list_filter(r.held, lambda x: x > e.t - 3600) AS own FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
      SELECT allowed, count(*) AS n FROM r GROUP BY allowed""",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL",
    "block_probes": f"""WITH l AS (SELECT path, line, trim(text) = '' AS blank FROM ({LINES})), i AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS isle FROM l),
      b AS (SELECT path, min(line) AS lo, max(line) AS hi FROM i WHERE NOT blank GROUP BY path, isle), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY lo) - 1 AS k, count(*) OVER (PARTITION BY path) AS n FROM b)
      SELECT path, lo, hi FROM r WHERE k % greatest(CAST(ceil(n / 60) AS BIGINT), 1) = 0""",
}
