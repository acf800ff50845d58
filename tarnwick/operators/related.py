"""What goes with an answer: documents, the change log, the tests that pin a mechanism, and questions to begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.vectors import small

# Names of change logs, in order of preference.
CHANGELOGS = ["CHANGES.md", "CHANGELOG.md", "CHANGES.rst", "CHANGELOG.rst", "HISTORY.md", "NEWS.md"]
# Templates of questions.
TEMPLATES = ["How does {} work?", "What calls {}?", "Where does {} fail?"]


def changelog(files: DataFrame) -> DataFrame:
    """The first change log that exists."""
    rank = F.array_position(F.lit(CHANGELOGS), F.col("path"))
    return files.where(rank > 0).orderBy(rank).limit(1)


def pinning_tests(chunks: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """names (qid, name) -> test files by how many they hold, ten more if named after one: (qid, file, score)."""
    words = chunks.where(T.is_test_path("file")).select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name")).distinct()
    hits = words.join(small(names), "name")
    own = F.max((F.instr(T.stem("file"), F.lower("name")) > 0).cast("int"))
    rows = hits.groupBy("qid", "file").agg((F.countDistinct("name") + 10 * own).alias("score"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "file"))).where(F.col("r") <= most).drop("r")


def related_docs(doc_chunks: DataFrame, most: int = 5) -> DataFrame:
    """Ranked document chunks (qid, file, start_line, end_line, score) -> the best files with the span of their best chunk."""
    best = doc_chunks.groupBy("qid", "file").agg(F.max(F.struct("score", "start_line", "end_line")).alias("b"))
    rows = best.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("b.score").desc(), "file"))).where(F.col("r") <= most)
    return rows.select("qid", "file", F.col("b.start_line").alias("start_line"), F.col("b.end_line").alias("end_line"), F.col("b.score").alias("score"))


def questions(authored: list[str], cached: list[str], central: list[str], most: int = 6) -> list[str]:
    """Authored questions, then those that were answered, then templates over central files with labels of their own."""
    labels: dict[str, str] = {}
    for path in central:
        parts = path.rsplit(".", 1)[0].split("/")
        for label in (parts[-1] if parts[-1] not in ("index", "__init__", "main", "mod") else "", *("/".join(parts[-k:]) for k in range(2, len(parts) + 1))):
            if label and label not in labels:
                labels[label] = path
                break
    made = [TEMPLATES[k % len(TEMPLATES)].format(x) for k, x in enumerate(labels)]
    return list(dict.fromkeys([*authored, *cached, *made]))[:most]


def refresh(stale: list[dict], exists: set[str], ask) -> tuple[list[int], list[int]]:
    """Stale flows {id, question, files}: asked again, or dropped if all they cite is gone: (asked, dropped)."""
    asked, dropped = [], []
    for f in stale:
        if not set(f["files"]) & exists:
            dropped.append(f["id"])
            continue
        ask(f["question"])
        asked.append(f["id"])
    return asked, dropped
