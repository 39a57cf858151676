"""The command line: python -m graphloom COMMAND ..."""
from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

HOME = Path(os.environ.get("GRAPHLOOM_HOME", Path.home() / ".graphloom"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *args: tuple) -> None:
        one = sub.add_parser(name, help=text)
        for flags, more in args:
            one.add_argument(*flags, **more)

    path = (("path",), {"nargs": "?", "default": "."})
    at = (("--path",), {"default": "."})
    limit = lambda n: (("--limit",), {"type": int, "default": n})
    add("analyze", "index a repository, or what changed in it", path, (("--verbose",), {"action": "store_true"}))
    add("query", "search symbols", (("text",), {}), at, limit(10))
    add("context", "a symbol's neighbours", (("name",), {}), at, limit(15))
    add("impact", "what depends on a symbol", (("name",), {}), at, (("-d", "--direction"), {"default": "up"}), (("-D", "--depth"), {"type": int, "default": 3}))
    add("status", "counts of a graph", path)
    add("symbols", "list symbols", at, (("--label",), {}), limit(20))
    add("export", "write a graph as html, json or dot", at, (("--format",), {"choices": ("html", "json", "dot"), "default": "html"}), (("--output",), {"required": True}), limit(None))
    add("serve", "a graph in the browser", at, (("--port",), {"type": int, "default": 4747}))
    add("diff", "what changed between two revisions", at, (("base",), {"nargs": "?", "default": "HEAD"}), (("head",), {"nargs": "?", "default": "WORKTREE"}), (("--format",), {"choices": ("text", "json", "html"), "default": "text"}), (("--output",), {}), limit(2000))
    add("benchmark", "time a first run, one without changes, and one after a change", path, (("--format",), {"choices": ("text", "json"), "default": "text"}), (("--sample-file",), {}))
    add("list", "the graphs that are known")
    add("clean", "forget a graph", path)
    add("setup", "how to use the tool server")
    add("mcp", "serve tools over standard input and output")
    return p


def table(df) -> None:
    """Rows of a bounded result, tab-separated."""
    print("\t".join(df.columns))
    for r in df.collect():
        print("\t".join("" if v is None else str(v) for v in r))


def setup_text(registry) -> str:
    server = {"mcpServers": {"graphloom": {"command": sys.executable, "args": ["-m", "graphloom", "mcp"]}}}
    return "\n".join(["Add this to the client's settings:", json.dumps(server, indent=2), "Graphs: " + (", ".join(e["name"] for e in registry.listing()) or "none; run analyze first")])


def page_server(graph, port: int, limit: int = 2000):
    """An HTTP server of /graph.json and, at any other path, the page; both are made once."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from .operators import export

    made = export.graph_data(graph, limit)
    data = json.dumps(made).encode()
    page = export.page(made, "Code graph", f"{len(made['nodes'])} symbols | {len(made['links'])} connections").encode()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body, kind = (data, "application/json") if self.path == "/graph.json" else (page, "text/html; charset=utf-8")
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    from .sources.store import Registry

    a = parser().parse_args(argv)
    registry = Registry(HOME / "registry.json")
    if a.command == "list":
        for e in registry.listing():
            print(f"{e['name']}\t{e['path']}\t{e['indexed_at']}" + "\tstale" * e["stale"])
        return 0
    if a.command == "setup":
        print(setup_text(registry))
        return 0

    from pyspark.sql import SparkSession

    from .config import Config
    from .errors import EngineError
    from .operators import export, traverse
    from .plans import engine, tools
    from .sources import store

    # graphs lie in a folder of their own; in local mode intermediate tables are beside them
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    root = os.path.abspath(getattr(a, "path", "."))
    out = registry.entries().get(os.path.basename(root), {}).get("store") or f"{HOME}/graphs/{os.path.basename(root)}"
    try:
        if a.command == "analyze":
            done = engine.analyze(spark, root, out, Config.from_env(), registry)
            print(f"{done.files_scanned} files parsed; {done.added} added, {done.modified} modified, {done.deleted} deleted, {done.unchanged} unchanged")
            table(engine.graph.status(done.graph))
        elif a.command == "clean":
            print("removed" if store.clean(spark, root, out, registry) else "nothing to remove")
        elif a.command == "benchmark":
            report = engine.benchmark(spark, root, f"{out}-benchmark", a.sample_file)
            print(json.dumps(report) if a.format == "json" else "\n".join(f"{k}: {r['seconds']} s, {r['files_scanned']} files" for k, r in report["runs"].items()))
        elif a.command == "diff":
            found = engine.diff_revisions(spark, root, a.base, a.head, a.limit)
            said = {"text": engine.diff_text, "json": engine.diff_json, "html": engine.diff_html}[a.format](found)
            export.write_text(said, a.output) if a.output else print(said)
        elif a.command == "mcp":
            tools.Server(spark, registry).serve()
        else:
            if not store.exists(spark, out):
                raise EngineError(f"no graph of {root}; run analyze first")
            e = engine.Engine(spark, out)
            if a.command == "query":
                table(e.query(a.text, a.limit))
            elif a.command == "context":
                table(e.context(a.name, a.limit))
            elif a.command == "impact":
                table(traverse.impact_shown(e.impact(a.name, a.direction, a.depth)).orderBy("start_id", "depth", "node_id"))
            elif a.command == "status":
                table(e.status())
            elif a.command == "symbols":
                table(e.symbols(a.label, a.limit))
            elif a.command == "export" and a.format == "json":
                export.write_json(e.graph, a.output, a.limit)
            elif a.command == "export":
                export.write_text(export.dot_text(e.graph, a.limit or 500) if a.format == "dot" else export.html_text(e.graph, a.limit or 3000), a.output)
            elif a.command == "serve":
                page_server(e.graph, a.port).serve_forever()
    except EngineError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
