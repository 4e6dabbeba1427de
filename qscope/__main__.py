"""Command line: python -m qscope analyze --table NAME=PATH ... --query SQL [--oracle SQL].

Exit codes: 0 done, 1 the oracle found wrong rows, 2 the arguments or the query are wrong."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from qscope.operators.debug import Watchpoint
from qscope.operators.lineage import Lineage
from qscope.operators.spectrum import localize
from qscope.operators.steps import decompose
from qscope.plans.adapter import UnsupportedOperator
from qscope.sources.io import read

TOOLS = ("result", "steps", "lineage", "suspects", "watch")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("qscope")
    a = top.add_subparsers(dest="command", required=True).add_parser("analyze", help="run a query with debugging tools")
    a.add_argument("--table", action="append", default=[], metavar="NAME=PATH", required=True)
    a.add_argument("--schema", action="append", default=[], metavar="NAME=DDL")
    a.add_argument("--format", help="format of all tables; by extension where left out")
    text = a.add_mutually_exclusive_group(required=True)
    text.add_argument("--query")
    text.add_argument("--query-file")
    a.add_argument("--oracle", help="SQL predicate that a wrong output row satisfies")
    a.add_argument("--watch", help="SQL predicate on rows of --step")
    a.add_argument("--tool", action="append", choices=TOOLS, help="repeatable; all that the arguments allow where left out")
    a.add_argument("--step", type=int, help="number of a step; the last where left out")
    a.add_argument("--limit", type=int, default=20, help="rows shown")
    a.add_argument("--master", default="local[*]")
    return top


def pairs(values: list[str], flag: str) -> dict[str, str]:
    bad = [v for v in values if "=" not in v]
    if bad:
        raise ValueError(f"{flag} takes NAME=VALUE, not {bad[0]}")
    return dict(v.split("=", 1) for v in values)


def analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    schemas = pairs(args.schema, "--schema")
    for name, path in pairs(args.table, "--table").items():
        read(spark, path, schemas.get(name), args.format).createOrReplaceTempView(name)
    if args.query_file:
        with open(args.query_file) as f:
            args.query = f.read()
    tools = args.tool or ["result", "steps", *(["lineage", "suspects"] if args.oracle else []), *(["watch"] if args.watch else [])]
    if not args.oracle and {"lineage", "suspects"} & set(tools) or not args.watch and "watch" in tools:
        raise ValueError("lineage and suspects need --oracle, watch needs --watch")
    result, steps = spark.sql(args.query), decompose(spark, args.query)
    wrong = bool(args.oracle) and not result.where(args.oracle).isEmpty()
    if "result" in tools:
        result.show(args.limit, False)
    if "steps" in tools:
        for s in steps:
            print(f"{s.id} {s.operator} {s.detail} {s.children}")
            for b in s.branches:
                print(f"    {'NOT ' if b.negated else ''}{b.condition}: {b.data.count()} rows")
    if "lineage" in tools and wrong:
        found = Lineage(spark, args.query)
        for source, rows in zip(found.sources, found.all_sources(args.oracle).values(), strict=True):
            print(f"behind wrong rows, in {source.name}:")
            rows.show(args.limit, False)
    if "suspects" in tools and wrong:
        for x in localize(spark, args.query, args.oracle)[: args.limit]:
            print(f"{x.score:.3f} step {x.step} {x.operation} (wrong {x.failing}, right {x.passing})")
    if "watch" in tools:
        at = len(steps) - 1 if args.step is None else args.step
        if not 0 <= at < len(steps):
            raise ValueError(f"no step {at}; there are {len(steps)}")
        seen = Watchpoint(steps[at].data, args.watch, args.limit)
        print(f"watch: {seen.hits} rows")
        seen.captured.show(args.limit, False)
    return int(wrong)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.master(args.master).appName("qscope").getOrCreate()
    try:
        return analyze(spark, args)
    except (ValueError, OSError, UnsupportedOperator, PySparkException) as e:
        print(f"qscope: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
