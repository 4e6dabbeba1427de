"""Influence provenance: how much each input row of the topmost aggregate mattered to the
output rows that satisfy a predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qscope.operators.lineage import Lineage, Part, paired
from qscope.plans.adapter import as_query, items

MODELLED = {"Max", "Min", "Sum", "Average", "Count"}
NUMERIC = ("byte", "short", "integer", "long", "float", "double")


def _aggregates(e) -> list:
    if e.getClass().getSimpleName() == "AggregateExpression":
        return [e]
    return [x for c in items(e.children()) for x in _aggregates(c)]


def _topmost(below: list, path: list[Part]) -> list[Part] | None:
    """The parts from the output down to the first aggregate."""
    for b in below:
        if isinstance(b, Part):
            if b.operator == "Aggregate":
                return [*path, b]
            found = _topmost(b.inside, [*path, b])
            if found:
                return found
    return None


def influence(spark: SparkSession, query: str | DataFrame, where: str) -> DataFrame:
    """The aggregate's input rows in the groups that `where` selects, plus score and reason.

    The groups are those behind the selected rows of the query's final output, whatever
    filters and projections stand above the aggregate.
    MAX and MIN: rows at the extremum share 1, others 0. SUM and AVG: abs(v) / sum(abs(v)),
    null 0; all zero: equal shares. COUNT: equal shares. Several: the greatest score and its
    reason. Rows that an aggregate's FILTER leaves out score 0 for it. Without a modelled
    function: equal shares; without an aggregate: 1 / n of the matching rows.

    Totals are aggregated for the selected groups only and joined back to their rows."""
    df = as_query(spark, query)
    hit = df.where(where)
    if not hit.limit(1).count():
        raise ValueError(f"no output row satisfies {where!r}; columns are {df.columns}")
    lin = Lineage(spark, df, strict=False)
    p, path = lin.plans, _topmost(lin.below, [])
    if path is None:
        n = hit.count()
        return hit.withColumn("score", F.lit(1.0 / n)).withColumn("reason", F.lit("matches the predicate; no aggregate"))
    rows = lin.annotated.where(where)
    for part in path:
        rows = lin.down(rows, part)
    top, keys = path[-1], path[-1].keys
    plain = [c for c in rows.columns if c not in top.hidden]
    # First the values, then the totals of each group, then of the rows at an extremum.
    values: list[Column] = []
    totals: list[Column] = [F.count(F.lit(1)).alias("__n")]
    ties: list[Column] = []
    scores: list[tuple[Column, str]] = []
    for a in (x for e in items(top.node.aggregateExpressions()) for x in _aggregates(e)):
        fn = a.aggregateFunction()
        kind = fn.getClass().getSimpleName()
        if kind not in MODELLED:
            continue
        i, argument = len(scores), fn.children().apply(0)
        type_name = argument.dataType().typeName()
        keep = p.column(a.filter().get()) if a.filter().isDefined() else F.lit(True)
        if kind == "Count":
            values.append(F.coalesce(keep, F.lit(False)).alias(f"__v{i}"))
            totals.append(F.count_if(f"__v{i}").alias(f"__t{i}"))
            score = F.when(F.col(f"__v{i}"), 1.0 / F.col(f"__t{i}"))
        elif type_name not in NUMERIC and "decimal" not in type_name:
            continue
        else:
            values.append(F.when(keep, p.column(argument)).cast("double").alias(f"__v{i}"))
            if kind in ("Max", "Min"):
                totals.append((F.max if kind == "Max" else F.min)(f"__v{i}").alias(f"__t{i}"))
                best = F.coalesce(F.col(f"__v{i}") == F.col(f"__t{i}"), F.lit(False))
                ties.append(F.count_if(best).alias(f"__e{i}"))
                score = F.when(best, 1.0 / F.col(f"__e{i}"))
            else:
                totals.append(F.sum(F.abs(f"__v{i}")).alias(f"__t{i}"))
                nothing = F.coalesce(F.col(f"__t{i}"), F.lit(0.0)) == 0
                score = F.when(nothing, 1.0 / F.col("__n")).otherwise(F.abs(f"__v{i}") / F.col(f"__t{i}"))
        scores.append((F.coalesce(score, F.lit(0.0)), f"{kind.upper()} of {argument.sql()}"))
    rows = rows.select(*plain, *keys, *values)
    rows = paired(rows, rows.groupBy(*keys).agg(*totals), keys)
    if ties:
        rows = paired(rows, rows.groupBy(*keys).agg(*ties), keys)
    scores = scores or [(1.0 / F.col("__n"), "equal share; no modelled aggregate")]
    best = F.array_max(F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("i"), F.lit(r).alias("reason")) for i, (s, r) in enumerate(scores)]))
    return rows.withColumn("__best", best).select(*plain, F.col("__best.score").alias("score"), F.col("__best.reason").alias("reason"))


def most_influential(spark: SparkSession, query: str | DataFrame, where: str, k: int = 10) -> DataFrame:
    """The k rows that mattered most; equal scores in the order of their values."""
    found = influence(spark, query, where)
    plain = [F.to_json(F.struct(*[c for c in found.columns if c not in ("score", "reason")]))]
    return found.orderBy(F.desc("score"), *plain).limit(k)


def as_json(found: DataFrame) -> DataFrame:
    """(json): row, score and reason of each scored row."""
    row = F.struct(*[c for c in found.columns if c not in ("score", "reason")])
    return found.select(F.to_json(F.struct(row.alias("row"), "score", "reason")).alias("json"))
