"""Interactive primitives: watchpoints, breakpoints, crash culprits, per-record cost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from qscope.operators.lineage import Lineage


class Watchpoint:
    """Counts every row of a DataFrame that satisfies a guard and keeps up to `capacity` of
    them, with all columns."""

    def __init__(self, df: DataFrame, guard: str | Column, capacity: int = 1000):
        if capacity < 0:
            raise ValueError("capacity must not be negative")
        self.guard = F.expr(guard) if isinstance(guard, str) else guard
        self.capacity, self.df, self._hits = capacity, df, None
        self.captured: DataFrame = df.where(self.guard).limit(capacity)

    @property
    def hits(self) -> int:
        if self._hits is None:
            self._hits = self.df.where(self.guard).count()
        return self._hits

    @property
    def truncated(self) -> bool:
        return self.hits > self.capacity

    def captured_json(self) -> DataFrame:
        return self.captured.select(F.to_json(F.struct(*self.df.columns)).alias("row"))

    def reset(self) -> None:
        self._hits = None


class Breakpoint:
    """A named point in a query: state, count, and going on with another function."""

    def __init__(self, df: DataFrame):
        self.df, self.schema, self._kept = df, df.schema, False

    def state(self, limit: int = 20) -> list[Row]:
        return self.df.limit(limit).collect()

    def count(self) -> int:
        return self.df.count()

    def materialize(self) -> Breakpoint:
        self.df.persist()
        self._kept = True
        return self

    @property
    def is_materialized(self) -> bool:
        return self._kept

    def release(self) -> None:
        self.df.unpersist()
        self._kept = False

    def resume_with(self, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return fn(self.df)


@dataclass(frozen=True)
class Culprit:
    row: Row
    partition: int
    index: int
    error: str


def crash_culprit(source: DataFrame, then: Callable[[DataFrame], DataFrame]) -> Culprit | None:
    """The first source row (by partition and place in it) that makes `then` fail: bisection
    over the partitions, then over the rows of the first that fails, so about
    log2(partitions) + log2(its rows) runs, each of which throws away its result. None if
    nothing fails. The source is kept while this runs, so that places hold."""
    kept = source.withColumn("__at", F.monotonically_increasing_id()).persist()
    plain = [c for c in kept.columns if c != "__at"]

    def error(low: int, high: int) -> str | None:
        try:
            then(kept.where(F.col("__at").between(low, high)).select(*plain)).write.format("noop").mode("overwrite").save()
        except Exception as e:
            return str(e)
        return None

    def first(fails: Callable[[int], bool], low: int, high: int) -> int:
        """The least place up to which it fails; it does up to high."""
        while low < high:
            mid = (low + high) // 2
            if fails(mid):
                high = mid
            else:
                low = mid + 1
        return low

    try:
        held = sorted((r[0], r[1]) for r in kept.groupBy(F.shiftright("__at", 33).alias("p")).count().collect())
        if not held or error(0, (held[-1][0] << 33) + held[-1][1]) is None:
            return None
        i = first(lambda m: error(0, (held[m][0] << 33) + held[m][1] - 1) is not None, 0, len(held) - 1)
        start, n = held[i][0] << 33, held[i][1]
        at = first(lambda m: error(start, start + m) is not None, 0, n - 1)
        found = kept.where(F.col("__at") == start + at).select(*plain).first()
        return Culprit(found, held[i][0], at, (error(start + at, start + at) or "").splitlines()[0][:500])
    finally:
        kept.unpersist()


class Profile:
    """Nanoseconds that an expression takes for each row: clock readings around it, in the
    order of a CASE that Spark evaluates from left to right. record_level is False where a
    batched Python UDF below makes the readings those of batches."""

    def __init__(self, df: DataFrame, expression: str | Column, top: int = 20):
        e = F.expr(expression) if isinstance(expression, str) else expression
        clock = "reflect('java.lang.System', 'nanoTime')"
        start = df.withColumn("__t0", F.expr(clock))
        value = start.withColumn("__value", e)
        self.rows = value.withColumn("__t1", F.when(F.col("__value").isNull(), F.expr(clock)).otherwise(F.expr(clock)))
        nanos = F.col("__t1").cast("long") - F.col("__t0").cast("long")
        self.rows = self.rows.withColumn("nanos", nanos).withColumn("__pos", F.monotonically_increasing_id())
        plan = df._jdf.queryExecution().executedPlan().toString()
        self.record_level = "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        self.top = top
        # The first record of a task pays for starting up and is not counted.
        self.counted = self.rows.where(F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1)) > 0)

    def summary(self) -> Row:
        return self.counted.agg(F.count("*").alias("records"), F.sum("nanos").alias("total"), F.avg("nanos").alias("mean"), (F.max("nanos") / F.avg("nanos")).alias("skew"), F.count("__value").alias("values")).first()

    def slowest(self) -> DataFrame:
        return self.counted.orderBy(F.desc("nanos")).limit(self.top).drop("__t0", "__t1", "__pos")


@dataclass(frozen=True)
class OperatorCost:
    """A physical operator and what it reported: rows, sizes and times by name."""

    depth: int
    operator: str
    metrics: dict[str, int]


def operator_costs(df: DataFrame) -> list[OperatorCost]:
    """The query is run once, without keeping its rows; each operator of the plan that ran,
    outermost first, with its own metrics."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    out: list[OperatorCost] = []

    def visit(node, depth: int) -> None:
        name = node.nodeName()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan(), depth)
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return visit(node.plan(), depth)
        if not node.getClass().getSimpleName() in ("WholeStageCodegenExec", "InputAdapter"):
            found, each = {}, node.metrics().iterator()
            while each.hasNext():
                pair = each.next()
                found[pair._1()] = int(pair._2().value())
            out.append(OperatorCost(depth, name, found))
            depth += 1
        kids = node.children()
        for i in range(kids.size()):
            visit(kids.apply(i), depth)
        return None

    visit(run.executedPlan(), 0)
    return out


def blame(lineage: Lineage, where: str, costs: DataFrame, source: int | str = 0, top: int = 10) -> DataFrame:
    """Source rows behind chosen output rows by their profiled cost. costs carries the rid of
    the source's rows, as the profile of `lineage.source(source).rows` does."""
    if "rid" not in costs.columns:
        raise ValueError("costs need the source's rid: profile lineage.source(...).rows")
    behind = lineage.witnesses(lineage.annotated.where(where), lineage.source(source))
    return costs.join(behind, "rid", "left_semi").orderBy(F.desc("nanos"), "rid").limit(top)
