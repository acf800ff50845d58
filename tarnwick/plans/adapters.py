"""The engine's relations, read from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.vectors import large


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df dealt out to tasks of about so many rows: a table of few bytes makes one task, whatever its rows cost."""
    return df.repartition(max(1, -(-df.count() // rows)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, text, lang, doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", "lang", "doc_id")


FILE_SQL = "SELECT source || '/' || doc_id || '.md' AS path, text, lang, doc_id FROM documents"


def label_file(label) -> F.Column:
    """Labels as files; every fifth is a test."""
    return F.concat(F.when(label % 5 == 4, "tests/t").otherwise("src/l"), label.cast("string"), F.lit(".py"))


LABEL_FILE_SQL = "CASE WHEN label % 5 = 4 THEN 'tests/t' ELSE 'src/l' END || label || '.py'"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), label_file(F.col("label")).alias("file"), F.concat(F.lit("sym_"), F.col("vec_id").cast("string")).alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


CHUNK_SQL = f"SELECT vec_id AS id, {LABEL_FILE_SQL} AS file, embedding::DOUBLE[] AS vec FROM embeddings"


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's vector: the mean of its chunks', rounded, of length 1 before rounding again."""
    e = spread(table(spark, sf_dir, "embeddings")).select(label_file(F.col("label")).alias("path"), F.posexplode("embedding").alias("k", "x"))
    mean = e.groupBy("path", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return mean.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("l")).select("path", F.transform("l", lambda s: s["m"]).alias("skel_vec"))


SKELETON_SQL = f"""SELECT path, list(m ORDER BY k) AS skel_vec FROM (
  SELECT path, k, round(avg(x), 6) AS m FROM (SELECT {LABEL_FILE_SQL} AS path, unnest(range(1, 65)) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY path, k) GROUP BY path"""


def in_query_set(vec_id: str = "vec_id"):
    """The stated query set: every vector whose id is divisible by 20, so it grows with the table."""
    return F.col(vec_id) % 20 == 0


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(in_query_set())
    return e.select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("qvec"))


QUERY_SQL = "SELECT vec_id AS qid, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 20 = 0"


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that a line item ties, by line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_linestatus").alias("kind")).distinct()


SUPPLY_SQL = "SELECT DISTINCT 'supplier/' || l_suppkey AS src, 'part/' || l_partkey AS dst, l_linestatus AS kind FROM lineitem"


def label_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of imports between label files."""
    e = table(spark, sf_dir, "embeddings").select("label").distinct()
    return e.select(label_file(F.col("label")).alias("src"), label_file((F.col("label") * 3 + 1) % 10).alias("dst"), F.lit("import").alias("kind")).where("src <> dst")


LABEL_EDGE_SQL = f"SELECT * FROM (SELECT DISTINCT {LABEL_FILE_SQL} AS src, {LABEL_FILE_SQL.replace('label', '((label * 3 + 1) % 10)')} AS dst, 'import' AS kind FROM embeddings) WHERE src <> dst"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each line of a document is its symbol, up to the next line with one."""
    rows = files(spark, sf_dir).select("path", F.posexplode(T.lines("text")).alias("k", "l")).select(F.col("path").alias("file"), F.regexp_extract("l", "^([A-Za-z]{4,})", 1).alias("name"), (F.col("k") + 1).alias("line"))
    return rows.where("name <> ''").select("file", "name", F.lit("section").alias("kind"), "line", F.col("line").alias("end_line"), F.col("name").alias("signature"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, the next assistant turn as the answer; vectors from embeddings by conversation."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.min("turn").alias("t"))
    a = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return q.join(large(a), "conv_id").select(F.col("conv_id").alias("id"), "question", "text").join(large(v), "id").select("id", "question", "text", "vec", F.col("vec").alias("qvec"))


FLOW_SQL = """SELECT conv_id AS id, question, text, embedding::DOUBLE[] AS vec FROM
  (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)
  JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id)
  JOIN embeddings ON vec_id = conv_id"""
