"""Headings of whole pages, against an HTML parser."""

from __future__ import annotations

from collections import defaultdict
from html.parser import HTMLParser
from pathlib import Path

import pytest

from tarnwick.plans import catalogue
from tests.test_queries import SF


class Plain(HTMLParser):
    def __init__(self, html: str):
        super().__init__()
        self.found, self.level, self.title, self.skip = [], 0, "", 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.level, self.title = int(tag[1]), ""
        elif tag in ("br", "p", "div"):
            self.title += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip -= 1
        elif self.level and tag == f"h{self.level}":
            if self.title.strip():
                self.found.append((self.level, " ".join(self.title.split())))
            self.level = 0

    def handle_data(self, data):
        if self.level and not self.skip:
            self.title += data


def crumbs(html: str) -> list[tuple[int, str]]:
    out, held = [], []
    for level, title in Plain(html).found:
        held = [x for x in held if x[0] < level] + [(level, title)]
        out.append((level, " > ".join(t for _, t in held)))
    return out


def got(spark, at: str) -> dict[str, list]:
    rows = defaultdict(list)
    for r in catalogue.queries()["headings"](spark, at).orderBy("line").collect():
        rows[r["path"]].append((r["level"], r["crumb"]))
    return rows


PAGES = {
    "deep": '<html><head><title>not me</title></head><body><h1 class="a">One</h1><p>text</p><h2>Two &amp; <b>more</b></h2><H3>Th\nree</H3><h2>Again<br>and</h2><h1>C #</h1></body></html>',
    "pre": "<h1>Code</h1><pre># no\n```\n## neither</pre><p># nor this</p><p>```</p><h2>After</h2><pre>x</pre><h6>Six</h6>",
    "none": "<p>nothing here</p><!-- <h1>gone</h1> --><script>'<h2>gone</h2>'</script>",
    "empty": "<h1></h1><h2> </h2><h3>a < b &lt;i&gt;</h3>",
    "first": "text # before\n# and here<h4>Four</h4>",
}


def test_awkward_pages(spark, tmp_path):
    spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(PAGES.items())] + [(99, "null", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert got(spark, str(tmp_path)) == {u: c for u, h in PAGES.items() if (c := crumbs(h))}


def test_pages_that_share_an_address(spark, tmp_path):
    pages = [(1, "u", "<h1>A</h1><h2>B</h2>"), (2, "u", "<h2>C</h2><pre>open"), (3, "u", "<p>x</p><h3>D</h3>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(got(spark, str(tmp_path))["u"]) == sorted(x for *_, h in pages for x in crumbs(h))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert got(spark, SF) == {p["url"]: c for p in pages if (c := crumbs(p["html"]))}
