"""The tools behind every surface, over an index of a small repository on disk."""

from __future__ import annotations

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from tarnwick import cli, server, service
from tarnwick.plans import indexer
from tarnwick.sources import scan

FILES = {
    "src/login.py": 'from tokens import check_token\n\nLOGIN_LIMIT = 3\n\n\ndef login_user(name):\n    """Let a user in."""\n    return check_token(name)\n',
    "src/pkg/__init__.py": "START = 1\n",
    "src/tokens.py": 'def check_token(name):\n    """Whether a token is good."""\n    return bool(name)\n',
    "tests/test_login.py": "from login import login_user\n\n\ndef test_login():\n    assert login_user('x')\n",
    "examples/demo_login.py": "from login import login_user\n\nlogin_user('y')\n",
    "docs/guide.md": "# Guide\n\nHow login works: login_user calls check_token.\n",
    "CHANGELOG.md": "# Changes\n\n- login\n",
    "node_modules/pkg/index.js": "module.exports = 1\n",
    "build/out.py": "x = 1\n",
    "notes.log": "login\n",
    "keep/secret.py": "y = 2\n",
    "gen_pb2.py": "z = 3\n",
    ".gitignore": "*.log\nkeep/\n",
    ".tarnwickignore": "build # made\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)
    (at / "huge.py").write_text("# x\n" * 200_000)
    return str(at)


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    indexer.index(spark, scan.discovered(spark, root), at)
    return indexer.Engine(spark, at)


WANTED = {"src/pkg/__init__.py", "src/login.py", "src/tokens.py", "tests/test_login.py", "examples/demo_login.py", "docs/guide.md", "CHANGELOG.md"}


def test_what_is_indexed(spark, root, engine):
    assert {r["path"] for r in engine.tables["files"].select("path").collect()} == WANTED
    assert "keep/secret.py" in {r["path"] for r in scan.discovered(spark, root, gitignore=False).select("path").collect()}
    assert "docs/guide.md" not in {r["path"] for r in scan.discovered(spark, root, patterns=["docs"]).select("path").collect()}


def test_scan_report(spark, root):
    out = cli.run(cli.parser().parse_args(["scan", root]), spark)
    flagged = {x["key"]: x["files"] for x in out["flagged"]}
    assert flagged["excluded"] >= 1 and flagged["gitignored"] == 2 and flagged["generated"] == 1 and flagged["too-big"] == 1
    assert out["would_index"] == len(out["paths"]) and "src/login.py" in out["paths"] and len(out["top_dirs"]) <= 10


def test_search_and_prune(engine):
    out = service.search(engine, {"query": "login_user login"})
    core = [x for x in out["entries"] if x["tier"] == 1]
    assert core and all(x["chunks"] for x in core) and {x["file"] for x in out["entries"]} >= {"src/login.py", "src/tokens.py"}
    login = next(x for x in out["entries"] if x["file"] == "src/login.py")
    assert "login_user" in [s["name"] for s in login["outline"]] and login["doc"] == "Let a user in." and "src/login.py" in out["text"]
    pruned = service.prune(engine, {"query": "login_user check_token login"})
    assert pruned["counts"]["kept"] == len(pruned["kept"]) and pruned["changelog"] == "CHANGELOG.md" and pruned["docs_indexed"]
    assert "docs/guide.md" in [x["file"] for x in pruned["related_docs"]]
    assert service.docsearch(engine, {"query": "how login works", "groups": [["docs/", "Docs"]]})[0]["pct"] == 100


def test_grep(engine):
    out = service.grep(engine, {"pattern": "login_user"})
    assert {k: v["total"] for k, v in out["sections"].items()} == {"defines": 1, "tests": 2, "docs": 1, "config": 2} and "src/login.py:6" in out["text"]
    assert service.grep(engine, {"pattern": "nowhere_at_all"})["sections"] == {}


def test_map(engine):
    out = service.map_repo(engine, {"query": "where does login_user call check_token"})
    assert [x for x in out["files"] if x["part"] == "head"] and {d["said"] for d in out["defines"]} == {"login_user", "check_token"}
    assert {(t["said"], t["kind"]) for t in out["trail"]} >= {("check_token", "defines"), ("check_token", "reads"), ("login_user", "tests")}
    assert "DEFINES login_user  src/login.py:6" in out["text"]


def test_graph(engine):
    path = service.graph(engine, {"from": "tests/test_login.py", "to": "tokens.py"})
    assert path["path"] == ["tests/test_login.py", "src/login.py", "src/tokens.py"] and all(h["forward"] for h in path["hops"])
    node = service.graph(engine, {"node": "login.py"})
    assert node["node"] == "src/login.py" and node["reaches"] == ["src/tokens.py"] and "tests/test_login.py" in node["reached_from"]
    assert service.graph(engine, {"node": "nothing.py"})["node"] is None
    assert service.graph(engine, {})["hubs"][0]["file"] == "src/login.py"


def test_read(engine):
    rows = service.get(engine, {"specs": ["src/tokens.py#check_token", "src/login.py:3-3", "no.py"]})
    assert [r["status"] for r in rows] == ["ok", "ok", "missing"] and rows[1]["text"] == "LOGIN_LIMIT = 3"
    assert service.symbols(engine, {"name": "check_token"})[0]["file"] == "src/tokens.py"
    assert {r["relation"]: r["rows"] for r in service.stats(engine, {})}["files"] == len(WANTED)


def test_ask(engine):
    out = service.ask(engine, {"query": "how does login_user work"})
    assert not out["narrated"] and "src/login.py" in out["text"]
    told = list(service.ask_events(engine, "how does login_user work", lambda prompt: iter(["It checks [[1: 1 - 2]]", " and ends."])))
    assert [k for k, _ in told][:2] == ["bundle", "plan"] and told[-1][1]["narrated"] and "[[" not in "".join(x for k, x in told if k == "text")
    assert set(service.plan(engine, {"query": "login"})) == {"broad", "agents"}


def test_protocol(engine):
    said = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "symbols", "arguments": {"name": "login_user"}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {}}},
        {"jsonrpc": "2.0", "id": 5, "method": "nothing"},
    ]
    out = io.StringIO()
    service.stdio(engine, io.StringIO("\n".join(map(json.dumps, said)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, None]
    assert {t["name"] for t in got[1]["result"]["tools"]} == set(service.TOOLS) == set(service.NEEDS)
    assert "src/login.py" in got[2]["result"]["content"][0]["text"] and got[3]["error"]["code"] == -32602 and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700


def test_http(engine):
    s = server.serve(engine)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_address[1]}"

    def post(path: str, body: object) -> str:
        with urllib.request.urlopen(urllib.request.Request(at + path, json.dumps(body).encode())) as r:
            return r.read().decode()

    assert json.loads(post("/tools/symbols", {"name": "login_user"}))[0]["line"] == 6
    events = post("/ask", {"query": "how does login work"})
    assert [x.split(": ")[1] for x in events.splitlines() if x.startswith("event")][0] == "bundle" and "event: done" in events
    with pytest.raises(urllib.error.HTTPError) as x:
        post("/tools/nothing", {})
    assert x.value.code == 404
    with pytest.raises(urllib.error.HTTPError) as x:
        post("/tools/search", {})
    assert x.value.code == 400
    s.shutdown()
