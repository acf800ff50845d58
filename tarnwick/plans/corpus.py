"""Corpus queries: lines, chunks, checks, census, hashes, headings, incremental index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import corpus as C
from tarnwick.plans import adapters as A
from tarnwick.plans.lexical import LINES
from tarnwick.sources import store

BUDGET = 400


def lines(spark, sf_dir: str) -> DataFrame:
    return C.line_table(A.files(spark, sf_dir)).select("path", F.col("line").cast("long").alias("line"), F.length("text").cast("long").alias("n"))


def nws(spark, sf_dir: str) -> DataFrame:
    return A.files(spark, sf_dir).select("path", T.nws("text").cast("long").alias("nws"), F.size(T.lines("text")).cast("long").alias("lines"))


def pack_lines(spark, sf_dir: str) -> DataFrame:
    """Greedy line windows of every document."""
    return C.pack_lines(A.files(spark, sf_dir), BUDGET).select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "nws")


def partition_check(spark, sf_dir: str) -> DataFrame:
    """Violations of the line partition: none."""
    f = A.files(spark, sf_dir)
    return C.partition_violations(C.pack_lines(f, BUDGET), f)


BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|header|hr|html|li|main|nav|ol|p|section|table|td|th|tr|ul"
SPACE = r"[\s\x1C-\x1E\x{0085}\x{00A0}\x{2028}\x{2029}]+"


def plain_html(html):
    """Without tags, common entities read; blocks begin on a new line."""
    t = F.regexp_replace(F.regexp_replace(html, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n"), "</?[A-Za-z!][^>]*>", "")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
    return t


def markdown(html):
    """A whole page as markdown lines: h1 to h6 as headings, pre as fences, its other text as it is.

    Marks stand for the tags until the text is plain, so that a text's own number signs and fences
    can be told from them and escaped.
    """
    t = F.regexp_replace(html, "[\x01-\x03]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", ""), r"(?is)<(script|style|head|template)\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<h([1-6])\b[^>]*>", "\x01$1"), r"(?i)</h[1-6]\s*>", "\x02")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<pre\b[^>]*>", "\n\x03\n"), r"(?i)</pre\s*>", "\n\x03\n")
    body = lambda x: F.replace(F.regexp_replace(F.replace(plain_html(x), F.lit("\x02"), F.lit("\n")), r"(?m)^(\s*)(#|```|~~~)", r"$1\\$2"), F.lit("\x03"), F.lit("```"))

    def section(x):
        own = F.substring_index(x, "\x02", 1)
        title = F.trim(F.regexp_replace(plain_html(F.substring(own, 2, 1 << 30)), SPACE, " "))
        marks = F.repeat(F.lit("#"), F.substring(x, 1, 1).cast("int"))
        head = F.when(title != "", F.concat_ws(" ", marks, title, marks)).otherwise("")  # closed, so that a title's own last number signs stay
        return F.concat(F.lit("\n"), head, F.lit("\n"), body(F.substring(x, F.length(own) + 2, 1 << 30)))

    parts = F.split(t, "\x01", -1)
    return F.concat(body(parts[0]), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), section), ""))


def headings(spark, sf_dir: str) -> DataFrame:
    """Sections of pages: the headings of each whole page, at their lines as markdown."""
    own = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url")  # pages may share an address
    md = A.table(spark, sf_dir, "pages").select(own.alias("path"), markdown(F.col("html")).alias("text"))
    return C.heading_scan(md).select(F.regexp_replace("path", "^-?[0-9]* ", "").alias("path"), F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "crumb")


def census(spark, sf_dir: str) -> DataFrame:
    """By extension, directory and reason: copies of the corpus under excluded, vendored and generated paths."""
    f = A.files(spark, sf_dir)
    where = F.col("doc_id") % 5
    f = f.withColumn("path", F.when(where == 1, F.concat(F.lit("node_modules/"), "path")).when(where == 2, F.concat(F.lit("third_party/"), "path")).when(where == 3, F.regexp_replace("path", "[.]md$", ".pb.go")).otherwise(F.col("path")))
    return C.census(C.verdict(f, ["md", "py"], workspace=True))


def content_hash(spark, sf_dir: str) -> DataFrame:
    return A.files(spark, sf_dir).select("path", T.content_hash("text").alias("sha"))


def incremental(spark, sf_dir: str) -> DataFrame:
    """What an index pass does to each path: new, changed, same or orphan, against an older state of the corpus."""
    now = A.files(spark, sf_dir).select("path", T.content_hash("text").alias("sha"))
    n = F.regexp_extract("path", "/([0-9]+)[.]md$", 1).cast("long")
    old = now.where(n % 7 != 0).withColumn("sha", F.when(n % 5 == 0, F.lit("old")).otherwise(F.col("sha"))).unionByName(now.where(n % 11 == 0).select(F.concat(F.lit("gone/"), "path").alias("path"), "sha"))
    return store.changes(old, now).groupBy("change").agg(F.count("*").alias("n"))


def near_edges(spark, sf_dir: str) -> DataFrame:
    """Links between pages: href targets that are pages themselves."""
    p = A.table(spark, sf_dir, "pages")
    links = p.select(F.col("url").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("dst")).where("src <> dst")
    return links.groupBy("src").agg(F.count("*").alias("links"))


QUERIES = {"lines": lines, "nws": nws, "pack_lines": pack_lines, "partition_check": partition_check, "headings": headings, "census": census, "content_hash": content_hash, "incremental": incremental, "page_links": near_edges}

NWS = r"length(regexp_replace({t}, '[\s\x0B\x1C-\x1F\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g'))"
FILE = A.FILE_SQL
ORACLES = {
    "lines": f"SELECT path, line, length(text) AS n FROM ({LINES})",
    "nws": f"SELECT path, {NWS.format(t='text')} AS nws, coalesce(n, 0) AS lines FROM ({FILE}) LEFT JOIN (SELECT path, count(*) AS n FROM ({LINES}) GROUP BY path) USING (path)",
    "pack_lines": f"""WITH RECURSIVE l AS MATERIALIZED (SELECT path, line, {NWS.format(t='text')} AS n FROM ({LINES})),
      w AS (SELECT path, line, 1::BIGINT AS s, n AS total FROM l WHERE line = 1
        UNION ALL SELECT l.path, l.line, CASE WHEN w.total + l.n > {BUDGET} THEN l.line ELSE w.s END, CASE WHEN w.total + l.n > {BUDGET} THEN l.n ELSE w.total + l.n END FROM w JOIN l ON l.path = w.path AND l.line = w.line + 1)
      SELECT path, s AS start_line, max(line) AS end_line, max(total) AS nws FROM w GROUP BY path, s""",
    "partition_check": "SELECT '' AS path, '' AS reason WHERE false",
    "census": f"""WITH f AS (SELECT CASE doc_id % 5 WHEN 1 THEN 'node_modules/' || path WHEN 2 THEN 'third_party/' || path WHEN 3 THEN replace(path, '.md', '.pb.go') ELSE path END AS path, strlen(text) AS b, doc_id, substring(text, 1, 2048) AS head FROM ({FILE})),
      h AS (SELECT *, length(head) - length(replace(head, chr(10), '')) AS breaks FROM f),
      r AS (SELECT *, CASE doc_id % 5 WHEN 1 THEN 'excluded' WHEN 2 THEN 'vendored' WHEN 3 THEN 'generated' ELSE CASE WHEN regexp_matches(head, '(?i){C.GENERATED_MARKS}') OR (length(head) >= 2000 AND breaks <= 2) OR (breaks > 0 AND length(head) / (breaks + 1) > 400) THEN 'generated' WHEN b > 600000 THEN 'too-big' END END AS reason FROM h)
      SELECT by_ AS by, key, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT 'ext' AS by_, 'md' AS key, b FROM r WHERE reason IS NULL UNION ALL SELECT 'dir', split_part(path, '/', 1), b FROM r WHERE reason IS NULL UNION ALL SELECT 'reason', reason, b FROM r WHERE reason IS NOT NULL) GROUP BY by_, key""",
    "content_hash": f"SELECT path, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha FROM ({FILE})",
    "incremental": f"""WITH now_ AS (SELECT path, doc_id FROM ({FILE}))
      SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM now_ UNION ALL SELECT 'orphan' FROM now_ WHERE doc_id % 11 = 0) GROUP BY change""",
    "page_links": """SELECT url AS src, count(*) AS links FROM (SELECT url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS dst FROM pages) WHERE url <> dst GROUP BY url""",
}
