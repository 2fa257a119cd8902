"""Command line: index a folder of documents, ask questions, show figures."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from docloom.plans.engine import Config, Engine


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom")
    parser.add_argument("--config", help="JSON file of settings")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a Parquet table of documents")
    index.add_argument("documents")
    index.add_argument("folder")
    for name in ("query", "interactive", "info"):
        c = commands.add_parser(name)
        c.add_argument("folder")
        if name == "query":
            c.add_argument("question")
        if name != "info":
            c.add_argument("--level", type=int, choices=(1, 2, 3, 4))
            c.add_argument("--format", default="toon", choices=("toon", "json", "markdown"))
    args = parser.parse_args(argv)
    settings = json.load(open(args.config)) if args.config else {}
    if getattr(args, "format", None):
        settings["formatter"] = args.format
    engine = Engine(SparkSession.builder.appName("docloom").getOrCreate(), Config.merged(settings))
    if args.command == "index":
        engine.index(engine.spark.read.parquet(args.documents)).save(args.folder)
        return 0
    engine.load(args.folder)
    if args.command == "info":
        engine.statistics().show(truncate=False)
    elif args.command == "query":
        print(engine.ask(args.question, args.level))
    else:
        level = args.level
        for line in sys.stdin:
            question = line.strip()
            if question == "!stats":
                engine.statistics().show(truncate=False)
            elif question.startswith("!level"):
                level = int(question.split()[1]) if len(question.split()) > 1 else None
            elif question in ("!quit", "exit"):
                break
            elif question:
                print(engine.ask(question, level))
    return 0


if __name__ == "__main__":
    sys.exit(main())
