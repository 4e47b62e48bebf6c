"""Command line: index, inspect, query, explore, repl."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loomgraph").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build an index of a source tree")
    i.add_argument("source"), i.add_argument("output")
    i.add_argument("--name"), i.add_argument("--exclude", action="append", default=[])
    i.add_argument("--max-bytes", type=int), i.add_argument("--unit-chars", type=int)
    i.add_argument("--generic", action="store_true", help="read definitions of other languages by line patterns")
    i.add_argument("--enrich", action="store_true", help="let the model describe some symbols")
    for name in ("--provider", "--model", "--key-name", "--embedding-provider", "--embedding-model", "--dimensions"):
        i.add_argument(name)
    i.add_argument("--no-docs", action="store_true"), i.add_argument("--no-config", action="store_true")
    s = sub.add_parser("inspect", help="show an entity, its relations, or counts")
    s.add_argument("index"), s.add_argument("--entity"), s.add_argument("--relations", action="store_true")
    for name, text in (("query", "answer a question"), ("explore", "answer with tools")):
        q = sub.add_parser(name, help=text)
        q.add_argument("index"), q.add_argument("question"), q.add_argument("--json", action="store_true")
        q.add_argument("--mode"), q.add_argument("--trace", action="store_true")
    r = sub.add_parser("repl", help="ask again and again; /trace shows the last steps, /exit ends")
    r.add_argument("index")
    return p


def options(args):
    from .plans.index import Options
    from .plans.units import MOST
    from .sources.files import EXCLUDE_GLOBS, MAX_BYTES, Discovery

    found = Discovery(exclude=[*EXCLUDE_GLOBS, *args.exclude], max_bytes=args.max_bytes or int(os.environ.get("LOOMGRAPH_MAX_BYTES", MAX_BYTES)))
    name = args.name or os.path.basename(os.path.abspath(args.source))
    return Options(repo=name, most=args.unit_chars or MOST, include_config=not args.no_config, include_docs=not args.no_docs, generic=args.generic, discovery=found)


def repl(ix, lines, out) -> None:
    """Questions from lines until /exit; the last exchange stays for /trace."""
    from .plans.agent import ask

    last = None
    for line in lines:
        text = line.strip()
        if text in ("/exit", "/quit"):
            return
        if text == "/trace":
            out("\n".join(f"{s}: {p}" for s, p in last.trace.events) if last else "nothing asked yet")
        elif text:
            last = ask(ix, text)
            out(last.answer or last.error or "")


def main(argv: list[str] | None = None, spark=None, out=print) -> int:
    args = parser().parse_args(argv)
    from .plans.providers import logger

    logger(verbose=args.verbose)
    spark = spark or session()
    if args.command == "index":
        from .plans.providers import Settings
        from .plans.workflow import build_index

        settings = Settings.assembled(vars(args))
        if settings.problems():
            out("error: " + "; ".join(settings.problems()))
            return 2
        out(json.dumps(asdict(build_index(spark, args.source, args.output, options(args), settings=settings, enrich=args.enrich))))
        return 0
    from .plans.answers import Index

    ix = Index(spark, args.index)
    if args.command == "inspect":
        from .operators import lookup

        if not args.entity:
            out(ix.answer("", "overview").text)
            return 0
        for r in lookup.best(ix.entities, args.entity, limit=5).collect():
            out(f"{r['qualified_name']} ({r['type']}) {r['location']}\n  {r['description']}")
        if args.relations:
            one = lookup.best(ix.entities, args.entity)
            for word, outgoing in (("→", True), ("←", False)):
                for r in lookup.neighbours(ix.relations, ix.entities, one, outgoing=outgoing).orderBy("first").limit(40).collect():
                    out(f"  {word} {r['qualified_name']} ({r['type']})")
        return 0
    if args.command == "repl":
        repl(ix, sys.stdin, out)
        return 0
    if args.command == "explore":
        from .plans.agent import ask

        got = ask(ix, args.question)
        out(json.dumps({"answer": got.answer, "rounds": got.rounds, "trace": got.trace.events if args.trace else []}) if args.json else got.answer)
        return int(got.error is not None)
    got = ix.answer(args.question, args.mode)
    out(json.dumps(asdict(got), default=str) if args.json else got.text or f"error: {got.error}")
    return int(got.error is not None)


if __name__ == "__main__":
    sys.exit(main())
