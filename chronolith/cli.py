"""Command line: python -m chronolith.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterable, Iterator

from .engine import Engine
from .session import session
from .tools import TOOLS, Tools


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronolith")
    p.add_argument("store", help="folder of the store; made by the first command that changes it")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="add a file or a folder")
    ingest.add_argument("path")
    ingest.add_argument("--pattern")
    ingest.add_argument("--no-graph", action="store_true")
    query = sub.add_parser("query", help="search")
    query.add_argument("question")
    query.add_argument("-k", type=int, default=5)
    query.add_argument("--reason", action="store_true")
    for name in ("stats", "sources"):
        sub.add_parser(name)
    save = sub.add_parser("save", help="copy the store to another folder")
    save.add_argument("path")
    sub.add_parser("repl", help="questions from standard input, an empty line ends")
    sub.add_parser("serve", help="JSON requests {name, arguments} from standard input, one a line")
    call = sub.add_parser("call", help="any tool, with JSON arguments")
    call.add_argument("tool", choices=sorted(TOOLS))
    call.add_argument("arguments", nargs="?", default="{}")
    return p


def _show(rows: Iterable) -> Iterator[str]:
    for h in rows:
        yield f"{h.score:.4f}  {h.source}: {h.text[:200]}"


def run(engine: Engine, args: argparse.Namespace, lines: Iterable[str] = ()) -> Iterator[str]:
    tools = Tools(engine)
    if args.command == "ingest":
        if os.path.isfile(args.path):
            failed = engine.ingest_directory(os.path.dirname(os.path.abspath(args.path)), os.path.basename(args.path))
        else:
            failed = engine.ingest_directory(args.path, args.pattern)
        yield from (f"not read: {r.path}: {r.error}" for r in failed.collect())
        if not args.no_graph and engine.store.revisions.limit(2).count() > 1:
            yield f"graph: {engine.build_graph()}"
        engine.save(args.store)
        yield f"store: {engine.stats()}"
    elif args.command == "query":
        found = engine.reason(args.question, k=args.k) if args.reason else None
        yield from found.trace if found else ()
        yield from _show(found.hits if found else engine.query(args.question, args.k))
    elif args.command == "stats":
        yield json.dumps(engine.stats())
    elif args.command == "sources":
        yield from (f"{r.source}: {r.chunks}" for r in engine.list_sources().toLocalIterator())
    elif args.command == "save":
        engine.save(args.path)
        yield f"saved to {args.path}"
    elif args.command == "repl":
        for line in lines:
            if not line.strip():
                break
            yield from _show(engine.ask(line.strip()).hits)
    elif args.command == "serve":
        for line in lines:
            try:
                request = json.loads(line)
                name, arguments = request["name"], request.get("arguments")
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                yield json.dumps({"error": f"bad request: {e}"})
                continue
            yield json.dumps({"result": tools.list_tools()} if name == "list_tools" else tools.call(name, arguments))
    else:
        yield json.dumps(tools.call(args.tool, json.loads(args.arguments)))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session("chronolith")
    engine = Engine.load(spark, args.store) if os.path.isdir(args.store) else Engine(spark)
    for line in run(engine, args, sys.stdin):
        print(line, flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
