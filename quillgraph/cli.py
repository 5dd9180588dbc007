"""Command line over the engine: ``python -m quillgraph.cli COMMAND ...``. Query commands read what ``index`` stored."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import server
from .config import CONFIG_NAME
from .engine import Engine
from .session import local_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--root", default=".")
    p.add_argument("--state")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "index", "routes", "stats", "deadcode", "metrics"):
        sub.add_parser(name)
    for name, option, default in (("search", "--limit", 12), ("context", "--budget", None), ("trace", "--depth", 6), ("impact", "--depth", 4), ("neighborhood", "--depth", 1)):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument(option, type=int, default=default)
        if name == "context":
            c.add_argument("--format", choices=("markdown", "xml"), default="markdown")
    sub.add_parser("repomap").add_argument("--limit", type=int, default=25)
    sub.add_parser("watch").add_argument("log", help="folder of the change log")
    sub.add_parser("serve").add_argument("--log", help="folder of a change log to follow")
    e = sub.add_parser("export")
    e.add_argument("--format", choices=("html", "dot", "json"), default="html")
    e.add_argument("--focus")
    e.add_argument("--out")
    return p


def run(args: list[str], spark=None, out=sys.stdout) -> int:
    a = _parser().parse_args(args)
    if a.command == "init":
        path = os.path.join(a.root, CONFIG_NAME)
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                json.dump({"token_budget": 8000, "embeddings": "local"}, f, indent=2)
        print(path, file=out)
        return 0
    engine = Engine(spark or local_session(), a.root, state=a.state)
    say = lambda df: [print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False), file=out) for r in df.collect()]
    match a.command:
        case "index":
            print(json.dumps(engine.index()), file=out)
        case "search":
            say(engine.find(a.query, a.limit).select("score", "kind", "name", "file_path", "start_line"))
        case "context":
            print(engine.context(a.query, a.budget, a.format).head()["formatted"], file=out)
        case "trace":
            for s in engine.trace_flow(a.query, a.depth):
                print(f"{'  ' * s['depth']}{s['from']} -> {s['to']} ({s['kind']}, {s['confidence']:.2f})", file=out)
        case "impact":
            say(engine.impact(a.query, a.depth).select("depth", "kind", "name", "file_path", "start_line").orderBy("depth", "file_path", "start_line"))
        case "neighborhood":
            for df in engine.neighborhood(a.query, a.depth):
                say(df.drop("snippet"))
        case "routes":
            say(engine.routes())
        case "repomap":
            say(engine.important_symbols(a.limit))
        case "deadcode":
            say(engine.dead_code())
        case "stats":
            print(json.dumps(engine.stats()), file=out)
        case "metrics":
            print(json.dumps(engine.metrics()), file=out)
        case "watch":
            engine.follow(a.log, on_batch=lambda b: print(json.dumps(b), file=out, flush=True), trigger={"processingTime": "1 second"}).awaitTermination()
        case "serve":
            server.serve(engine, out=out, log=a.log)
        case "export":
            text = engine.render_graph(a.format, a.focus)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
