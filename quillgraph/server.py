"""The engine's questions as tools of a JSON-RPC 2.0 server on standard input and output, one message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from .engine import Engine

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}


def _rows(df) -> str:
    return "\n".join(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in df.collect())


def tools(engine: Engine) -> dict[str, tuple[str, dict, Callable[[dict], str]]]:
    """name to (description, parameters, call)."""
    brief = ("score", "kind", "name", "file_path", "start_line")
    return {
        "context": ("Code that answers a question, packed into a token budget", {"query": _TEXT, "budget": _NUMBER}, lambda a: engine.context(a["query"], a.get("budget")).head()["formatted"]),
        "search": ("Symbols that match words or meaning", {"query": _TEXT, "limit": _NUMBER}, lambda a: _rows(engine.find(a["query"], a.get("limit", 12)).select(*brief))),
        "trace_flow": ("The calls a function makes, step by step", {"name": _TEXT, "depth": _NUMBER}, lambda a: "\n".join(map(json.dumps, engine.trace_flow(a["name"], a.get("depth", 6))))),
        "impact": ("What depends on a symbol", {"name": _TEXT, "depth": _NUMBER}, lambda a: _rows(engine.impact(a["name"], a.get("depth", 4)).select("depth", "kind", "name", "file_path"))),
        "routes": ("Web routes and their handlers", {}, lambda a: _rows(engine.routes())),
        "neighborhood": ("Symbols around a symbol", {"symbol": _TEXT, "depth": _NUMBER}, lambda a: _rows(engine.neighborhood(a["symbol"], a.get("depth", 1))[0].select("kind", "name", "file_path", "start_line"))),
        "reindex": ("Bring the index up to date", {}, lambda a: json.dumps(engine.index())),
        "repomap": ("The most important symbols", {"limit": _NUMBER}, lambda a: _rows(engine.important_symbols(a.get("limit", 25)))),
        "deadcode": ("Functions that nothing refers to", {}, lambda a: _rows(engine.dead_code())),
        "stats": ("Counts and quality of the index", {}, lambda a: json.dumps(engine.metrics())),
    }


def answer(engine: Engine, message: dict) -> dict | None:
    """The response to one request; None for a notification. A tool's failure is its result, marked as an error."""
    method, params = message.get("method"), message.get("params") or {}
    known = tools(engine)
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgraph", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        listed = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": [k for k in p if k in ("query", "name", "symbol")]}} for n, (d, p, _) in known.items()]
        return reply | {"result": {"tools": listed}}
    if method == "tools/call":
        name = params.get("name")
        if name not in known:
            return reply | {"error": {"code": -32602, "message": f"no tool {name}"}}
        try:
            text, failed = known[name][2](params.get("arguments") or {}), False
        except Exception as e:  # noqa: BLE001 - the client is told, the server goes on
            text, failed = f"{type(e).__name__}: {str(e)[:500]}", True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(engine: Engine, source: IO[str] = sys.stdin, out: IO[str] = sys.stdout, log: str | None = None) -> None:
    """Index, follow a change log if one is given, and answer until the input ends."""
    engine.index()
    if log:
        engine.follow(log, trigger={"processingTime": "1 second"})
    try:
        for line in source:
            if not line.strip():
                continue
            try:
                reply = answer(engine, json.loads(line))
            except ValueError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
    finally:
        engine.close()
