"""The flow cache: answers found again by meaning, and dropped when a cited file changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwick.functions import text as T
from tarnwick.functions.vectors import large, unit
from tarnwick.operators.scoring import HELD, PAIRS, PRODUCT, TASKS, leading, millionths, sent, union, vectors
from tarnwick.params import DEFAULTS, Params

MAX_TEXT = 14_000


def make_flow(answers: DataFrame) -> DataFrame:
    """answers (id, question, text, files, vec, qvec, created) as they are stored: text cut, vectors of length 1."""
    return answers.withColumns({"text": F.substring("text", 1, MAX_TEXT), "vec": unit(F.col("vec")), "qvec": unit(F.col("qvec"))})


def dealt(flows: DataFrame, against: DataFrame) -> DataFrame:
    """flows dealt over tasks for a product with so many others."""
    n = flows.count()
    return flows.repartition(max(1, -(-n // HELD), min(TASKS, n * against.count() // PAIRS)))


def cache_flows(flows: DataFrame, new: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """flows and new ones; a stored flow whose question is nearly that of a new one is replaced."""
    asked = new.select(F.col("id").alias("qid"), "qvec")
    own = dealt(flows.where("qvec is not null").select("id", "qvec"), asked)

    def near(shared) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value[1]
            step = max(1, PRODUCT // q.shape[1])
            for batch in (whole.slice(at, step) for whole in it for at in range(0, whole.num_rows, step)):
                hit = (vectors(batch.column(1), len(q)) @ q > p.flow_same).any(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], ["id"])

        return own.mapInArrow(run, own.select("id").schema)

    same = union([near(x) for x in sent(asked.where("qvec is not null"))], flows, own.select("id").schema).distinct()
    return flows.join(large(same), "id", "left_anti").unionByName(new)


def match_flows(flows: DataFrame, queries: DataFrame, p: Params = DEFAULTS, top: int = 2) -> DataFrame:
    """ATTACH: (qid, id, sim, qscore, rank), the best few flows by question and prose, of at least flow_attach."""
    asked = queries.where("qvec is not null").select("qid", "qvec")
    own = dealt(flows.where("vec is not null").select("id", "vec", "qvec"), asked)
    schema = StructType([queries.schema["qid"], own.schema["id"], *StructType.fromDDL("sim double, qscore double")])

    def ranked(shared) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The first few flows of each query among those a task holds."""
            held = [b for b in it if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            table = table.take(pa.compute.sort_indices(table.column("id"))).combine_chunks()
            ids, vec, qvec = (table.column(x).chunk(0) for x in ("id", "vec", "qvec"))
            qids, q = shared.value
            vec, known, qvec = vectors(vec, len(q)), np.asarray(qvec.is_valid()), vectors(qvec, len(q))
            step = max(1, 2 * PRODUCT // len(vec))
            for at in range(0, len(qids), step):
                asked = q[:, at : at + step].T
                sim = millionths((asked @ vec.T + 1) / 2)
                if np.isnan(sim).any():
                    sim[np.isnan(sim)] = np.inf  # as SQL sorts it
                i, j = np.nonzero(leading(sim, top) & (sim / 1e6 >= p.flow_attach))
                qscore = millionths((np.einsum("kd,kd->k", asked[i], qvec[j]) + 1) / 2) / 1e6 + 0.0
                value = sim[i, j] / 1e6
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(at + i)), ids.take(pa.array(j)), pa.array(np.where(np.isinf(value), np.nan, value)), pa.array(qscore, mask=~known[j])], ["qid", "id", "sim", "qscore"])

        return own.mapInArrow(run, schema)

    rows = union([ranked(x) for x in sent(asked)], flows, schema)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("sim").desc(), "id")).cast("long")).where(F.col("rank") <= top)


def current(flows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, current): whether every cited file still has the hash it was cited with."""
    cited = flows.select("id", F.explode_outer("files").alias("path", "was"))
    now = cited.join(large(files.select("path", F.col("sha").alias("now"))), "path", "left")
    return now.groupBy("id").agg(F.min(F.when(F.col("path").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("was") == F.col("now"), F.lit(False)))).alias("current"))


def stale(flows: DataFrame, files: DataFrame) -> DataFrame:
    return current(flows, files).where("not current").select("id")


def prune_stale(flows: DataFrame, files: DataFrame) -> DataFrame:
    return flows.join(large(stale(flows, files)), "id", "left_anti")


def serve(flows: DataFrame, queries: DataFrame, files: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """SERVE: (qid, id), the first attached flow that is near enough, covers the question and is current."""
    hit = match_flows(flows, queries, p).where(F.col("qscore") >= p.flow_serve)
    rows = hit.join(large(queries.select("qid", "query")), "qid").join(large(flows.select("id", "question")), "id").join(large(current(flows, files)), "id")
    ok = rows.where(F.col("current") & T.covers("query", "question", p.flow_cover))
    return ok.groupBy("qid").agg(F.min_by("id", "rank").alias("id"))


def flow_lane(bundle: DataFrame, matched: DataFrame, flows: DataFrame, most: int = 3) -> DataFrame:
    """Related files that matched flows cite and the bundle lacks: at most a few a query."""
    cited = matched.join(large(flows.select("id", F.explode(F.map_keys("files")).alias("file"))), "id").groupBy("qid", "file").agg(F.min("rank").alias("rank"))
    new = cited.join(large(bundle.select("qid", "file")), ["qid", "file"], "left_anti")
    return new.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "file"))).where(F.col("r") <= most).select("qid", "file")


def listing(flows: DataFrame, files: DataFrame) -> DataFrame:
    """Newest first, with whether they are stale."""
    return flows.join(large(current(flows, files)), "id").select("id", "question", "created", (~F.col("current")).alias("stale")).orderBy(F.col("created").desc(), "id")
