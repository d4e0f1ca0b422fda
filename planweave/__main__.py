"""python -m planweave build|query|summary|repair ...: the engine from the command line."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession

from planweave.operators import graph
from planweave.plans import pipeline
from planweave.session import ship
from planweave.sources import providers, readers, sinks


def print_lists(lists: dict[str, DataFrame]) -> None:
    """One JSON object with a list of rows by name, however many: rows are written as they come, a partition at a time on the driver."""
    sep = "{"
    for name, df in lists.items():
        print(f"{sep}{json.dumps(name)}: [", end="")
        for k, r in enumerate(df.toLocalIterator()):
            print(", " * (k > 0) + json.dumps(r.asDict(), ensure_ascii=False, default=str), end="")
        print("]", end="")
        sep = ", "
    print("}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="planweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="rules to a graph")
    build.add_argument("--rules", required=True, help="JSON file or glob")
    build.add_argument("--provider", default="offline", choices=sorted(providers.REGISTRY))
    build.add_argument("--url", default="", help="service of the http provider")
    build.add_argument("--entailment-url", default="", help="text-pair classifier of the http provider; without one the chat model is asked")
    build.add_argument("--classifier", default="", help="folder of the classifier provider's model")
    build.add_argument("--model", default="")
    build.add_argument("--out", help="folder for results by document, embeddings, trace and report")
    for name in ("query", "summary", "repair"):
        commands.add_parser(name)
    for name, sub in commands.choices.items():
        sub.add_argument("--graph", required=True, help="folder of the graph")
        if name == "query":
            sub.add_argument("--name")
            sub.add_argument("--relation")
            sub.add_argument("--direction", default="both", choices=["in", "out", "both"])
        if name == "summary":
            sub.add_argument("--top", type=int, default=20)
            sub.add_argument("--out")
            sub.add_argument("--tables", help="folder for the lists that grow with the data, whole")
        sub.add_argument("--log", help="file for the log, beside the console")
    args = parser.parse_args(argv)
    handlers = [logging.StreamHandler()] + ([logging.FileHandler(args.log, encoding="utf-8")] if args.log else [])
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=handlers, force=True)
    spark = SparkSession.builder.appName("planweave").getOrCreate()
    ship(spark)
    store = graph.GraphStore(spark, args.graph)
    if args.command == "build":
        settings = {"http": {"url": args.url, "model": args.model, "entailment_url": args.entailment_url}, "classifier": {"path": args.classifier}}.get(args.provider, {})
        built = pipeline.build(spark, readers.read_rules(spark, args.rules), providers.create(args.provider, **settings))
        version = store.write(built.nodes, built.edges)
        logging.info("version %d of %s", version, args.graph)
        if args.out:
            pipeline.write_outputs(built, args.out)
        print(built.report)
        return 0
    tables = store.read()
    if tables is None:
        logging.error("no graph in %s", args.graph)
        return 1
    nodes, edges = tables
    if args.command == "query" and args.name:
        print_lists({"nodes": graph.lookup_entity(nodes, args.name), "relations": graph.lookup_relations(edges, args.name, args.direction, args.relation).orderBy("subject", "predicate", "object")})
    elif args.command == "query":
        print(json.dumps([r.asDict() for r in graph.statistics(nodes, edges).collect()], ensure_ascii=False))
    elif args.command == "summary":
        got = graph.summary(nodes, edges, args.top, tables=args.tables)
        if args.out:
            sinks.save_json(got, args.out)
        print(json.dumps(got, ensure_ascii=False, default=str))
    else:
        fixed, before, after = graph.repair(nodes, edges)
        missing = [sum(r["missing"] for r in df.collect()) for df in (before, after)]
        store.write(nodes, fixed)
        print(json.dumps({"missing_before": missing[0], "missing_after": missing[1]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
