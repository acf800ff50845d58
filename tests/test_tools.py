"""Command line and strategies from elsewhere."""

from __future__ import annotations

import pytest

from tarnwick import cli
from tarnwick.operators import chunkers, forge


def test_command_line(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("import b\n\n\ndef open_door():\n    return b.key()\n")
    (tmp_path / "r" / "b.py").write_text("def key():\n    return 1\n")
    run = lambda *a: cli.run(cli.parser().parse_args(["--index", str(tmp_path / "i"), *a]), spark)
    with pytest.raises(LookupError):
        run("stats")
    assert run("index", str(tmp_path / "r")) == {"new": 2}
    assert "a.py" in run("search", "open door")
    assert run("grep", "key")[0]["file"] in ("a.py", "b.py")
    assert run("graph", "--path", "a.py", "b.py") == {"path": ["a.py", "b.py"]}
    assert {r["file"] for r in run("graph", "--node", "a.py")} == {"a.py", "b.py"}
    assert {r["relation"]: r["rows"] for r in run("stats")}["files"] == 2
    assert run("chunks", "a.py")[0]["start_line"] == 1


SOURCE = """
from tarnwick.operators.chunkers import Parsed, Unit
class Ini:
    exts = ("ini",)
    def parse(self, path, text):
        return Parsed([Unit(k, k, "section") for k, x in enumerate(text.splitlines(), 1) if x.startswith("[")], [], path)
STRATEGY = Ini()
"""


class Lossy:
    exts = ("ini",)

    def chunk(self, path, text, budget):
        return {"parse_ok": True, "total_lines": len(text.splitlines()), "skeleton": "", "symbols": [], "chunks": [{"kind": "x", "name": "", "part": "", "start_line": 1, "end_line": 1, "text": "", "breadcrumb": ""}]}


def test_forge_and_trust(tmp_path):
    samples = [("x.ini", "[a]\nk=1\n[b]\nk=2\n")]
    assert forge.validate(Lossy(), samples)

    def load(source):
        scope: dict = {}
        exec(source, scope)
        return scope["STRATEGY"]

    said = []
    source, complaints = forge.forge("ini", samples, lambda ext, s, c: said.append(c) or ("STRATEGY = 1" if len(said) < 2 else SOURCE), load)
    assert source == SOURCE and not complaints and said[1]
    (tmp_path / "s").mkdir()
    path = tmp_path / "s" / "ini.py"
    path.write_text(SOURCE)
    trust = forge.Trust(str(tmp_path / "trust.json"))
    assert forge.load_strategies(str(tmp_path / "s"), trust) == ([], ["ini.py"])
    trust.add(str(path))
    own, skipped = forge.load_strategies(str(tmp_path / "s"), trust)
    assert chunkers.strategy_for("q.ini", own) is own[0] and not skipped
    path.write_text(SOURCE + "\n# changed\n")
    assert not trust.holds(str(path))
