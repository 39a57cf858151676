"""A JSON-RPC façade over stored graphs: four tools and two kinds of resources, one request a line."""
from __future__ import annotations

import json
import re
import sys
from typing import IO

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError
from ..functions.text import percent_decode, percent_encode
from ..operators import graph
from ..sources.store import Registry
from .engine import Engine

PARSE, METHOD, PARAMS, INTERNAL = -32700, -32601, -32602, -32603
SCHEME = "graphloom"


class Failure(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _clamp(args: dict, name: str, default: int, most: int) -> int:
    value = args.get(name, default)
    if isinstance(value, bool) or not isinstance(value, int):
        raise Failure(PARAMS, f"{name} is no whole number")
    return max(1, min(most, value))


def _text(args: dict, name: str) -> str:
    value = args.get(name)
    if not isinstance(value, str) or not value:
        raise Failure(PARAMS, f"{name} is missing")
    return value


_TEXT, _INT = {"type": "string"}, {"type": "integer"}
TOOLS = {
    "query": ("Symbols by name and path", {"query": _TEXT, "limit": _INT, "repo": _TEXT}, ["query"]),
    "context": ("A symbol's neighbours", {"name": _TEXT, "limit": _INT, "repo": _TEXT}, ["name"]),
    "impact": ("What depends on a symbol, or what it depends on", {"name": _TEXT, "direction": {"type": "string", "enum": ["up", "down", "both"]}, "depth": _INT, "limit": _INT, "repo": _TEXT}, ["name"]),
    "list_repos": ("The graphs that are known", {}, []),
}


class Server:
    def __init__(self, spark: SparkSession, registry: Registry):
        self.spark, self.registry, self.engines = spark, registry, {}

    def engine(self, name: str | None) -> Engine:
        repos = self.registry.entries()
        if name is None and len(repos) == 1:
            name = next(iter(repos))
        if name not in repos:
            raise Failure(PARAMS, f"no graph named {name}")
        if name not in self.engines:
            self.engines[name] = Engine(self.spark, repos[name]["store"])
        return self.engines[name]

    def tool(self, name: str, args: dict):
        if name == "list_repos":
            return self.registry.listing()
        if name not in TOOLS:
            raise Failure(PARAMS, f"no tool named {name}")
        if name == "query":
            text, limit = _text(args, "query"), _clamp(args, "limit", 10, 100)
            return _rows(self.engine(args.get("repo")).query(text, limit))
        if name == "context":
            return _rows(self.engine(args.get("repo")).context(_text(args, "name"), _clamp(args, "limit", 15, 100)))
        direction = args.get("direction", "up")
        if direction not in ("up", "upstream", "down", "downstream", "both"):
            raise Failure(PARAMS, "direction is up, down or both")
        hits = self.engine(args.get("repo")).impact(_text(args, "name"), direction, _clamp(args, "depth", 3, 20), _clamp(args, "limit", 100, 500))
        return _rows(hits)

    def resource(self, uri: str):
        if uri == f"{SCHEME}://repos":
            return self.registry.listing()
        m = re.fullmatch(rf"{SCHEME}://repo/([^/]+)/graph", uri)
        if not m:
            raise Failure(PARAMS, f"no resource {uri}")
        nodes, edges = graph.whole(self.engine(percent_decode(m[1])).graph)
        return {"nodes": _rows(nodes), "edges": _rows(edges)}

    def answer(self, request: dict):
        """The result of one request; None for a notification."""
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        if method == "initialize":
            return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "graphloom", "version": "0.1.0"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
        if method == "tools/call":
            found = self.tool(params.get("name", ""), params.get("arguments") or {})
            return {"content": [{"type": "text", "text": json.dumps(found)}]}
        if method == "resources/list":
            uris = [f"{SCHEME}://repos", *(f"{SCHEME}://repo/{percent_encode(n)}/graph" for n in sorted(self.registry.entries()))]
            return {"resources": [{"uri": u, "name": u, "mimeType": "application/json"} for u in uris]}
        if method == "resources/read":
            uri = params.get("uri", "")
            return {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(self.resource(uri))}]}
        raise Failure(METHOD, f"no method {method}")

    def line(self, text: str) -> str | None:
        """The answer to a line, None for a notification or a blank one."""
        if not text.strip():
            return None
        key = None
        try:
            request = json.loads(text)
            key = request.get("id") if isinstance(request, dict) else None
            if not isinstance(request, dict):
                raise Failure(PARSE, "no request")
            result = self.answer(request)
            return None if result is None else json.dumps({"jsonrpc": "2.0", "id": key, "result": result})
        except ValueError as e:
            error = {"code": PARSE, "message": str(e)}
        except Failure as e:
            error = {"code": e.code, "message": str(e)}
        except EngineError as e:
            error = {"code": PARAMS, "message": str(e)}
        except Exception as e:  # noqa: BLE001
            error = {"code": INTERNAL, "message": str(e)[:300]}
        return json.dumps({"jsonrpc": "2.0", "id": key, "error": error})

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        for text in lines:
            if (said := self.line(text)) is not None:
                print(said, file=out, flush=True)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
