"""The command line over one small repository."""
import json
import threading
import urllib.request

import pytest

from graphloom import __main__ as cli

FILES = {"src/a.py": "def handle_main():\n    helper()\n\ndef helper():\n    return deep()\n\ndef deep():\n    return 1\n"}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    old, cli.HOME = cli.HOME, top / "home"
    root = top / "work"
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    assert cli.main(["analyze", str(root)]) == 0
    yield root
    cli.HOME = old


def said(capsys, *args):
    capsys.readouterr()
    code = cli.main(list(args))
    return code, capsys.readouterr().out


def test_questions(repo, capsys):
    at = ["--path", str(repo)]
    assert "handle_main" in said(capsys, "query", "handle_main", *at)[1]
    assert "src/a.py::helper::4" in said(capsys, "context", "deep", *at)[1]
    assert "handle_main" in said(capsys, "impact", "deep", *at)[1]
    assert "deep" in said(capsys, "symbols", "--label", "fn", *at)[1]
    assert said(capsys, "status", str(repo))[1].splitlines()[1].split("\t")[1] == "3"
    assert "work" in said(capsys, "list")[1] and "work" in said(capsys, "setup")[1]
    assert cli.main(["impact", "deep", "--direction", "left", *at]) == 1
    assert cli.main(["status", str(repo / "src")]) == 1


def test_exports_and_page(repo, spark, tmp_path):
    at = ["--path", str(repo)]
    for form in ("html", "dot", "json"):
        assert cli.main(["export", "--format", form, "--output", str(tmp_path / form), *at]) == 0
    assert "digraph" in (tmp_path / "dot").read_text() and "handle_main" in (tmp_path / "html").read_text()
    from graphloom.plans.engine import Engine

    server = cli.page_server(Engine(spark, f"{cli.HOME}/graphs/work").graph, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    data = json.loads(urllib.request.urlopen(f"{base}/graph.json").read())
    assert {n["name"] for n in data["nodes"]} >= {"handle_main", "helper", "deep"} and len(data["links"]) >= 2
    assert b"<!DOCTYPE html>" in urllib.request.urlopen(base).read()
    server.shutdown()
