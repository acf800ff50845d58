"""Corpora from folders: any file system Spark reads."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text as T


#: Files with names that Spark's readers pass over, which are read by the driver, at most.
HIDDEN = 20_000
#: Patterns of a repository that are left out besides, a line each.
IGNORE_FILE = ".tarnwickignore"
#: Paths that a report lists, at most.
PATHS = 6000


def folder(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Files under root, of at most so many bytes: path relative to it, text with newlines as line breaks, sha."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = raw if most is None else raw.where(F.col("length") <= most)  # pushed to the reader, so larger ones aren't read
    unseen = [(p, bytearray(b)) for p, b in hidden(spark, root, most)]
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/"), f"^{_quoted(base)}/?", "")
    text = T.normalised(F.col("content").cast("string"))
    rows = raw.select(path.alias("path"), text.alias("text"))
    if unseen:
        rows = rows.unionByName(spark.createDataFrame(unseen, "path string, content binary").select("path", text.alias("text")))
    return rows.withColumn("sha", F.sha2("text", 256))


def hidden(spark: SparkSession, root: str, most: int | None = None) -> Iterator[tuple[str, bytes]]:
    """Files that Spark's readers pass over by their names, as __init__.py and .gitignore: path relative to root, content.

    They are few, and read by the driver, which walks the folders that aren't excluded by name; more than HIDDEN are refused.
    """
    from tarnwick.operators.corpus import EXCLUDED_DIRS

    n = 0
    plain = root.removeprefix("file://")
    if "://" not in plain and os.path.isdir(plain):
        for at, folders, names in os.walk(plain):
            folders[:] = sorted(x for x in folders if x not in EXCLUDED_DIRS)
            own = "" if os.path.samefile(at, plain) else os.path.relpath(at, plain).replace(os.sep, "/") + "/"
            for name in sorted(names):
                full = os.path.join(at, name)
                if not _passed_over(own + name) or not os.path.isfile(full) or (most is not None and os.path.getsize(full) > most):
                    continue
                n = _counted(n, root)
                with open(full, "rb") as f:
                    yield own + name, f.read()
        return
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    stack = [("", base)]
    while stack:
        own, at = stack.pop()
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in EXCLUDED_DIRS:
                    stack.append((f"{own}{name}/", s.getPath()))
            elif _passed_over(own + name) and (most is None or s.getLen() <= most):
                n = _counted(n, root)
                stream = fs.open(s.getPath())
                yield own + name, bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                stream.close()


def _passed_over(path: str) -> bool:
    return any(x[0] in "._" for x in path.split("/"))


def _counted(n: int, root: str) -> int:
    if n >= HIDDEN:
        raise ValueError(f"{root} has more than {HIDDEN} files with hidden names; exclude some, or load them as a table")
    return n + 1


def discovered(spark: SparkSession, root: str, exts: list[str] | None = None, patterns: list[str] | None = None, gitignore: bool = True) -> DataFrame:
    """folder() without what isn't indexed: excluded, ignored, vendored, generated and too large files, and other extensions.

    Files over the size limit are never read; patterns of a root's ignore file come with those given.
    """
    from tarnwick.operators import chunkers, corpus
    from tarnwick.params import DEFAULTS

    files = folder(spark, root, DEFAULTS.max_file_bytes)
    exts = exts or sorted({e for s in chunkers.builtin() for e in s.exts})
    own = [r["pattern"] for r in corpus.ignore_patterns(files.where(F.col("path") == IGNORE_FILE)).collect()]  # lines of one file
    rules = corpus.rules_of(files) if gitignore else []
    return corpus.discover(files, exts, [*(patterns or []), *own], rules)


def report(spark: SparkSession, root: str, patterns: list[str] | None = None) -> dict:
    """The census of a folder: files that would be indexed by extension and by the ten largest directories, flagged ones by reason, and what an ignore file might name."""
    from tarnwick.operators import chunkers, corpus

    files = folder(spark, root)
    exts = sorted({e for s in chunkers.builtin() for e in s.exts})
    judged = corpus.verdict(files, exts, patterns, corpus.rules_of(files), corpus.is_workspace(files)).persist()
    rows = corpus.census(judged).collect()  # a row an extension, top directory or reason
    by = lambda k: sorted(({"key": r["key"], "files": r["files"], "bytes": r["bytes"]} for r in rows if r["by"] == k), key=lambda x: (-x["files"], x["key"]))
    flagged = judged.where("reason in ('vendored', 'generated')").groupBy(T.top_dir("path").alias("dir")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dir").limit(10).collect()
    paths = [r["path"] for r in judged.where("reason is null").select("path").orderBy("path").limit(PATHS).collect()]
    judged.unpersist()
    return {"would_index": sum(x["files"] for x in by("ext")), "by_ext": by("ext"), "top_dirs": by("dir")[:10], "flagged": by("reason"), "paths": paths, "proposed_ignore": [f"{r['dir']}/" for r in flagged if r["dir"] != "."]}


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def documents(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A corpus from any table with paths and texts."""
    return df.select(F.col(path).alias("path"), T.normalised(text).alias("text")).withColumn("sha", F.sha2("text", 256))


def groups(lines: list[str] | None) -> list[tuple[str, str]]:
    """'prefix=name' lines, in order."""
    return [(a.strip(), b.strip()) for a, _, b in (x.partition("=") for x in lines or []) if b]
