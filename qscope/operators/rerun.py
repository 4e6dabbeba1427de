"""Swap the data under a query: sources of a DataFrame's plan by name, or the views of SQL text."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qscope.plans.adapter import Plans, UnsupportedOperator, as_query


@contextmanager
def views(spark: SparkSession, data: dict[str, DataFrame]):
    """Temp views for a while; temp views that were there before come back, and tables of
    these names are seen again."""
    before = {n: spark.table(n) for n in data if any(t.isTemporary and t.name.lower() == n.lower() for t in spark.catalog.listTables(pattern=n))}
    try:
        for name, df in data.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in data:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def substitutable(spark: SparkSession, query: str | DataFrame) -> list[str]:
    """Names of the sources that can be swapped."""
    p = Plans(spark)
    return sorted({n.alias() for n in p.everywhere(p.analyzed(as_query(spark, query))) if p.kind(n) == "SubqueryAlias"})


def require_substitutable(spark: SparkSession, query: str | DataFrame, names) -> None:
    missing = sorted(set(names) - set(substitutable(spark, query)))
    if missing:
        raise UnsupportedOperator("source", f"the query has none named {missing}")


def with_data(spark: SparkSession, query: str | DataFrame, data: dict[str, DataFrame]) -> DataFrame:
    """The query over other data. Columns go by name and are cast to the source's types; the
    outermost source of a name is replaced, and nothing below it is looked at."""
    p = Plans(spark)
    if isinstance(query, str):
        with views(spark, data):
            return spark.sql(query)
    require_substitutable(spark, query, data)
    return _swapped(p, p.analyzed(query), lambda node: data.get(node.alias()) if p.kind(node) == "SubqueryAlias" else None)


def with_scans(spark: SparkSession, query: DataFrame, rows: dict[tuple[int, ...], DataFrame]) -> DataFrame:
    """The query over other rows of single scans, which their attributes tell apart: of a
    view, what it reads; of a self-join, one side."""
    p = Plans(spark)
    return _swapped(p, p.analyzed(query), lambda node: None if p.children(node) else rows.get(tuple(a.exprId().id() for a in p.output(node))))


def _swapped(p: Plans, plan, replacement) -> DataFrame:
    """The plan with some nodes replaced; attributes keep their identity."""

    def swap(node):
        new = replacement(node)
        if new is not None:
            old = p.output(node)
            base = new.select(*[F.col(f"`{a.name()}`").cast(a.dataType().json().strip('"')).alias(a.name()) if a.dataType().simpleString().isalpha() else F.col(f"`{a.name()}`") for a in old])
            plan = p.analyzed(base)
            names = [p.jvm.org.apache.spark.sql.catalyst.expressions.Alias(x, a.name(), a.exprId(), a.qualifier(), p.none(), p.seq([])) for x, a in zip(p.output(plan), old, strict=True)]
            return p.project(names, plan)
        kids = p.children(node)
        changed = [swap(c) for c in kids]
        node = p.with_children(node, changed) if any(a is not b for a, b in zip(kids, changed, strict=True)) else node
        return p.with_subqueries(node, swap)

    return p.frame(swap(plan))
