"""Scalar text functions as column expressions: all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\u0085\\u2028\\u2029]"
CAMEL_1, CAMEL_2 = "([A-Z]+)([A-Z][a-z])", "[A-Z]?[a-z]+|[A-Z]+"

# Words that don't make a topic.
STOP_WORDS = (
    "a an and are as at be been but by can do does doing done for from get gets had has have how i if in into is it its of on or our so than that "
    "the their then there these they this to under up upon use used uses was we what when where which while who why will with within work works would you your"
).split()

# Folders of tests and of demonstrations.
TEST_SEGMENTS = ["test", "tests", "spec", "specs", "__tests__", "testing", "fixtures"]
DEMO_SEGMENTS = ["example", "examples", "samples", "demo", "demos", "benchmarks", "typing-examples"]
TEST_TOKEN = "(^|[._-])(test|spec)s?([._-]|$)"

# Fence language by extension.
FENCE = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "rb": "ruby", "go": "go", "php": "php", "md": "markdown", "markdown": "markdown", "mdx": "markdown"}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text: Column | str) -> Column:
    """Lines as splitlines() gives them: all line breaks count, and none follows the last one."""
    parts = F.split(c(text), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normalised(text: Column | str) -> Column:
    """With newlines alone as line breaks, as files are read."""
    return F.regexp_replace(c(text), "\\r\\n?", "\n")


def content_hash(text: Column | str) -> Column:
    return F.sha2(normalised(text), 256)


def nws(text: Column | str) -> Column:
    """Number of characters that aren't white space, Unicode's included."""
    return F.length(F.regexp_replace(c(text), "(?U)\\s", ""))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(c(text), F.lit("[A-Za-z_]+"), F.lit(0))


def camel_parts(word: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(word, CAMEL_1, "$1 $2"), F.lit(CAMEL_2), F.lit(0))


def ident_tokens(text: Column | str) -> Column:
    """Distinct lower-cased parts, of at least 4 letters, of the identifiers in a text."""
    parts = F.flatten(F.transform(words(text), camel_parts))
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda t: F.length(t) >= 4))


def bm25_tokens(text: Column | str) -> Column:
    """Each word in lower case, followed by its camel and snake parts of more than one letter; a word of one part counts twice."""
    def own(w: Column) -> Column:
        plain = (F.lower(w) == w) & (F.instr(w, "_") == 0)  # most words: one part, no pattern needed
        parts = F.when(plain, F.array(w)).otherwise(F.transform(camel_parts(w), F.lower))
        return F.concat(F.array(F.lower(w)), F.filter(parts, lambda t: F.length(t) > 1))

    return F.flatten(F.transform(words(text), own))


def content_tokens(text: Column | str) -> Column:
    """Distinct words that tell the topic."""
    all_ = F.array_distinct(F.regexp_extract_all(F.lower(c(text)), F.lit("[a-z0-9_]+"), F.lit(0)))
    return F.filter(F.array_except(all_, F.lit(STOP_WORDS)), lambda t: F.length(t) > 1)


def covers(query: Column | str, question: Column | str, least: float) -> Column:
    """Whether the question holds this share of the query's topic words; a query without any is covered."""
    q = content_tokens(query)
    share = F.size(F.array_intersect(q, content_tokens(question))) / F.size(q)
    return F.when(F.size(q) == 0, F.lit(True)).otherwise(share >= least)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(c(path), "/"), -1), "\\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(c(path), "\\.([^./]+)$", 1))


def _folders(path: Column | str) -> Column:
    parts = F.split(F.lower(c(path)), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_test_path(path: Column | str) -> Column:
    named = F.exists(F.split(F.lower(c(path)), "/"), lambda s: F.regexp_replace(s, "\\.[^.]*$", "").rlike(TEST_TOKEN))
    return F.arrays_overlap(_folders(path), F.lit(TEST_SEGMENTS)) | named


def is_test(path: str) -> bool:
    """The same for one path on the driver."""
    parts = path.lower().split("/")
    return any(p in TEST_SEGMENTS for p in parts[:-1]) or any(re.search(TEST_TOKEN, p.rpartition(".")[0] or p) for p in parts)


def is_demo_path(path: Column | str) -> Column:
    return F.arrays_overlap(_folders(path), F.lit(DEMO_SEGMENTS))


def under_path(path: Column | str, scope: str) -> Column:
    scope = scope.strip("/")
    return (c(path) == scope) | c(path).startswith(scope + "/")


def top_dir(path: Column | str) -> Column:
    return F.when(F.instr(c(path), "/") > 0, F.split(c(path), "/")[0]).otherwise(F.lit("."))


def norm_rel(path: Column | str) -> Column:
    """A relative path without . and .. segments; one that leaves the root is null."""
    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.lit(None).cast("array<string>"))
        return F.when((s == ".") | (s == ""), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(c(path), "/"), F.array().cast("array<string>"), step), "/")


def lang_of(path: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in FENCE.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit(""))


def embed_text(breadcrumb: Column, part: Column, text: Column) -> Column:
    return F.concat(F.lit("# "), breadcrumb, F.when(part.isNotNull() & (part != ""), F.concat(F.lit(" (part "), part, F.lit(")"))).otherwise(F.lit("")), F.lit("\n"), text)


def cache_key(model: str, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(model), F.lit("\0"), text))


#: What a rendered answer adds to its prose, as operators.ask writes it: where a piece of code lies, and that it was shown.
SHOWN, SEEN = "**{where}**", "(see {where} above)"
CITATION, FENCED, BLANKS = "\\[\\[[^\\]]*\\]\\]", "(?s)```.*?```", "\\n{3,}"
CODE_HEAD, BACK_REFERENCE = (re.escape(x).replace(re.escape("{where}"), "[^\\s:]+:\\d+-\\d+").replace("\\ ", " ") for x in (SHOWN, SEEN))
# The same marks in answers that name files between ticks.
TICKED = ["\\*\\*`[^`\\n]+`\\s*L\\d+(?:-\\d+)?\\*\\*[^\\n]*", "\\*\\(see\\s+`[^`\\n]+`\\s*above\\)\\*"]


def strip_code(text: Column | str) -> Column:
    """An answer's prose: without fenced code, its headers, references to earlier code, citations and runs of blank lines."""
    t = c(text)
    for mark in (FENCED, CODE_HEAD, BACK_REFERENCE, *TICKED, CITATION):
        t = F.regexp_replace(t, mark, "")
    return F.trim(F.regexp_replace(t, BLANKS, "\n\n"))


def clean_inline(text: Column | str) -> Column:
    """Markdown without its marks."""
    t = F.regexp_replace(c(text), "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    t = F.regexp_replace(t, "[`*_]+", "")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def strip_frontmatter(text: Column | str) -> Column:
    return F.regexp_replace(c(text), "(?s)^---\\n.*?\\n---\\n", "")


def snippet(text: Column | str, size: int = 160) -> Column:
    body = clean_inline(F.regexp_replace(strip_frontmatter(text), "(?m)^#.*$", ""))
    return F.when(F.length(body) > size, F.concat(F.rtrim(F.substring(body, 1, size - 1)), F.lit("…"))).otherwise(body)


def slug(path: Column | str) -> Column:
    """A page's address: without extension and trailing index."""
    return F.regexp_replace(F.regexp_replace(c(path), "\\.(md|mdx|markdown)$", ""), "(^|/)(index|README)$", "")


def citations(text: Column | str) -> Column:
    """The insides of [[k]], [[k:lo-hi]] and [[k:lo-hi,lo-hi]], without blanks; numbers of lines may follow an L or l."""
    span = "\\s*[Ll]?[0-9]+\\s*(?:-\\s*[Ll]?[0-9]+\\s*)?"
    return F.transform(F.regexp_extract_all(c(text), F.lit(f"\\[\\[\\s*([0-9]+\\s*(?::{span}(?:,{span})*)?)\\]\\]"), F.lit(1)), lambda x: F.regexp_replace(x, "\\s", ""))


def parse_ranges(spec: Column | str) -> Column:
    """'3:10-20,L25' -> [{lo: 10, hi: 20}, {lo: 25, hi: 25}]; without ranges empty."""
    body = F.regexp_replace(F.when(F.instr(c(spec), ":") > 0, F.element_at(F.split(c(spec), ":"), 2)), "[Ll\\s]", "")
    parts = F.coalesce(F.split(body, ","), F.array().cast("array<string>"))
    return F.transform(parts, lambda p: F.struct(F.element_at(F.split(p, "-"), 1).cast("int").alias("lo"), F.element_at(F.split(p, "-"), -1).cast("int").alias("hi")))
