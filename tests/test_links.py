"""Links, related material, the registry and the service."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from tarnwick import server
from tarnwick.operators import chunkers, links, related
from tarnwick.plans import indexer
from tarnwick.sources import registry

REPO = [
    ("core/engine.py", "class Engine:\n    def start(self):\n        return 1\n\n\ndef boot():\n    return Engine()\n"),
    ("app/main.py", "import json\nfrom core.engine import Engine, boot\n\n\ndef run():\n    e = Engine()\n    e.start()\n    json.dumps({})\n    return boot()\n"),
    ("tests/test_engine.py", "from core.engine import Engine\n\n\ndef test_start():\n    assert Engine().start()\n"),
    ("CHANGES.md", "# 1\n"),
]


@pytest.fixture(scope="module")
def repo(spark):
    return spark.createDataFrame(REPO, "path string, text string")


def test_use_sites_and_links(repo):
    sites = links.use_sites(repo).persist()
    got = {(r["src"], r["line"], r["name"], r["dst"]) for r in sites.where("said = 'call'").collect()}
    assert {("app/main.py", 6, "Engine", "core/engine.py"), ("app/main.py", 7, "Engine.start", "core/engine.py"), ("app/main.py", 9, "boot", "core/engine.py")} <= got
    assert not any(n == "dumps" for _, _, n, _ in got)
    symbols = chunkers.children(chunkers.parsed(repo))[2]
    at = {(r["name"], r["at"]) for r in links.file_links(sites, symbols).where("src = 'app/main.py'").collect()}
    assert {("Engine.start", 2), ("boot", 6), ("Engine", 1)} <= at
    assert links.hop_symbols(sites).where("src = 'app/main.py'").count() == 3


def test_orientation():
    e = {("a", "b"), ("c", "b"), ("x", "y"), ("y", "z")}
    assert links.oriented(["z", "y", "x"], e)["path"] == ["x", "y", "z"]
    assert links.oriented(["a", "b", "c"], e) == {"path": ["a", "b", "c"], "chain": False, "meet": "b", "kind": "callee"}
    assert links.snippet("\n".join(map(str, range(1, 101))), 50, 10)[0] == 45
    assert links.community_labels({0: ["a"], 1: ["b"]}, lambda p: "0: Auth\n9: no") == {0: "Auth", 1: "Community 1"}
    assert links.community_labels({0: ["a"]}, lambda p: 1 / 0) == {0: "Community 0"}


def test_related(spark, repo):
    assert related.changelog(repo).first()["path"] == "CHANGES.md"
    chunks = repo.withColumnRenamed("path", "file")
    names = spark.createDataFrame([(0, "Engine"), (0, "boot")], "qid int, name string")
    assert related.pinning_tests(chunks, names).first()["score"] == 11
    assert related.questions(["A?"], ["B?"], ["src/core/engine.py", "src/x/engine.py"], 4) == ["A?", "B?", "How does engine work?", "What calls x/engine?"]
    said = []
    assert related.refresh([{"id": 1, "question": "q", "files": ["a"]}, {"id": 2, "question": "r", "files": ["b"]}], {"a"}, said.append) == ([1], [2]) and said == ["q"]


def test_registry(tmp_path):
    r = registry.Registry(str(tmp_path / "r.json"))
    (tmp_path / "a" / ".tarnwick").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    r.register(str(tmp_path / "a"), files=1)
    r.register(str(tmp_path / "b"), files=2)
    assert [x["files"] for x in r.list()] == [2, 1]
    (tmp_path / "b").rmdir()
    assert [x["files"] for x in r.list()] == [1] and r.unregister(str(tmp_path / "a")) and not r.list()
    (tmp_path / "a" / "x").mkdir()
    assert registry.resolve_root(str(tmp_path / "a" / "x")) == (str((tmp_path / "a").resolve()), "x")


def test_service(spark, repo, tmp_path):
    indexer.index(spark, repo, str(tmp_path))
    s = server.serve(indexer.Engine(spark, str(tmp_path)))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}{p}"))
    assert get("/health") == {"ok": True}
    assert get("/search?q=engine+start")[0]["tier"] == 1
    assert {r["role"] for r in get("/grep?pattern=boot")} == {"defines", "reads", "config"}
    for path, code in (("/nope", 404), ("/search", 400)):
        with pytest.raises(urllib.error.HTTPError) as x:
            get(path)
        assert x.value.code == code
    s.shutdown()
    limit = server.RateLimiter(1, 10)
    assert limit.hit("a", 0) and not limit.hit("a", 1)
    limit.refund("a")
    assert limit.hit("a", 2) and limit.hit("a", 13)
