"""Commands: ``python -m spanweave <command>``."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embed
from .operators.datasets import trivial
from .plans import tuner
from .plans.strategies import REGISTRY, params_label
from .schema import TYPES, USE_CASES, Config
from .sources.readers import read_files, read_queries
from .sources.workspace import FORMATS, Workspace
from .sources.writers import said, write_report


def _documents(spark: SparkSession, args: argparse.Namespace, workspace: Workspace) -> DataFrame:
    """The first documents by path, as many as are asked for."""
    docs = read_files(spark, args.path, kind=args.type)
    return docs.orderBy("path").limit(args.max_docs or workspace.max_docs)


def _type(docs: DataFrame) -> str:
    """The most common content type, by name if several are."""
    row = docs.groupBy("content_type").count().orderBy(F.desc("count"), "content_type").first()
    if row is None:
        raise SystemExit("no supported files there")
    return row["content_type"]


def _configs(docs: DataFrame, args: argparse.Namespace) -> tuple[DataFrame, list[Config]]:
    kind = args.type or _type(docs)
    names = REGISTRY.selected(args.strategies) if args.strategies else None
    return docs.where(F.col("content_type") == kind), REGISTRY.configs(kind, names)


def _analyze(spark, args, workspace):
    return tuner.analyze(_documents(spark, args, workspace)), None


def _estimate(spark, args, workspace):
    docs, configs = _configs(_documents(spark, args, workspace), args)
    return tuner.estimate(docs, len(configs)), None


def _ranking(spark, args, workspace, configs=None):
    docs, every = _configs(_documents(spark, args, workspace), args)
    queries = read_queries(spark, args.queries) if args.queries else trivial(docs)
    ranking = tuner.recommend(docs, configs or every, queries, args.use_case or workspace.use_case, budget=workspace.context_budget_tokens)
    if args.report:
        write_report(ranking, args.report)
    return ranking


def _recommend(spark, args, workspace):
    return _ranking(spark, args, workspace), "is_best"


def _evaluate(spark, args, workspace):
    config = REGISTRY.check(Config(args.strategy, json.loads(args.params)))
    return _ranking(spark, args, workspace, [config]), None


def _compare(spark, args, workspace):
    names = REGISTRY.selected(args.strategies, all_text=not args.strategies)
    return _ranking(spark, args, workspace, [Config(n, REGISTRY.get(n).grid[0]) for n in names]), None


def _preview(spark, args, workspace):
    text = _documents(spark, args, workspace).first()
    if text is None:
        raise SystemExit("no supported files there")
    return tuner.preview(spark, text["content"], Config(args.strategy, json.loads(args.params))), None


def _cache(spark, args, workspace):
    path = args.path or workspace.cache()
    if args.clear:
        return spark.createDataFrame([(path, embed.cache_clear(spark, path))], "path string, cleared boolean"), None
    return embed.cache_stats(embed.opened(spark, path)), None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanweave", description="Find out how a corpus should be split for retrieval.")
    commands = top.add_subparsers(dest="command")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--format", choices=FORMATS, default="table")
    shared.add_argument("--workspace")
    corpus = argparse.ArgumentParser(add_help=False, parents=[shared])
    corpus.add_argument("path")
    corpus.add_argument("--type", choices=TYPES)
    corpus.add_argument("--max-docs", type=int)
    corpus.add_argument("--strategies", help="names, separated by commas")
    ranking = argparse.ArgumentParser(add_help=False, parents=[corpus])
    ranking.add_argument("--queries", help="a dataset file of JSON or YAML")
    ranking.add_argument("--use-case", choices=USE_CASES)
    ranking.add_argument("--report", help="a markdown file to write")
    one = argparse.ArgumentParser(add_help=False)
    one.add_argument("--strategy", default="recursive_character")
    one.add_argument("--params", default="{}", help="JSON")

    def add(name: str, run: Callable | None, says: str, *parents: argparse.ArgumentParser) -> argparse.ArgumentParser:
        command = commands.add_parser(name, help=says, parents=list(parents))
        command.set_defaults(run=run)
        return command

    add("init", None, "write a workspace file with the defaults")
    add("analyze", _analyze, "structure of each document and the strategy to start with", corpus)
    add("estimate", _estimate, "tokens, cost and time of a grid", corpus)
    add("evaluate", _evaluate, "metrics of one configuration", ranking, one)
    add("recommend", _recommend, "rank the whole grid", ranking)
    add("compare", _compare, "the first configuration of each strategy", ranking)
    add("preview", _preview, "chunks of the first document", corpus, one)
    cache = add("cache", _cache, "entries and size of the cache of vectors, or clear it", shared)
    cache.add_argument("path", nargs="?")
    cache.add_argument("--clear", action="store_true")
    return top


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(words)
    if not args.command:
        parser().print_help()
        return 2
    if args.command == "init":
        print(Workspace.write_defaults())
        return 0
    workspace = Workspace.read(args.workspace)
    spark = spark or SparkSession.builder.appName("spanweave").getOrCreate()
    start = time.perf_counter()
    result, best = args.run(spark, args, workspace)
    if "config_id" in result.columns and args.command in ("recommend", "compare", "evaluate"):
        ids = [r["config_id"] for r in result.select("config_id").distinct().collect()]
        labels = {i: params_label(Config(i.partition(":")[0], json.loads(i.partition(":")[2]))) for i in ids}
        named = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
        result = result.withColumn("label", F.element_at(named, F.col("config_id"))).orderBy(F.col("rank").asc_nulls_last())
    print(said(result, args.format, best), end="")
    logging.getLogger(__name__).info("%s took %.0f ms", args.command, (time.perf_counter() - start) * 1000)
    return 0


if __name__ == "__main__":
    sys.exit(main())
