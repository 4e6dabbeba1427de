"""The one place that touches Spark's private plan classes: walking analyzed plans, turning
sub-plans into DataFrames and building nodes. Works on classic sessions only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession


class UnsupportedOperator(ValueError):
    """A query shape that can't be answered exactly; names the operator."""

    def __init__(self, operator: str, why: str = ""):
        super().__init__(f"unsupported operator {operator}" + (f": {why}" if why else ""))
        self.operator = operator


def as_query(spark: SparkSession, query: str | DataFrame) -> DataFrame:
    """A query is SQL text, resolved anew at each call, or a DataFrame."""
    if isinstance(query, str):
        return spark.sql(query)
    if not hasattr(query, "_jdf"):
        raise UnsupportedOperator(type(query).__name__, "a classic (not Connect) DataFrame or SQL text is needed")
    return query


def holds_plan(expression) -> bool:
    """Whether an expression holds a plan."""
    return expression.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class Plans:
    def __init__(self, spark: SparkSession):
        if not hasattr(spark, "_jsparkSession"):
            raise UnsupportedOperator("Spark Connect session", "its client holds no plan")
        self.spark, self.jvm = spark, spark._jvm
        self._rules = spark._jvm.org.apache.spark.sql.catalyst.optimizer

    def seq(self, values: list):
        return self.jvm.PythonUtils.toSeq(values)

    def analyzed(self, df: DataFrame):
        return df._jdf.queryExecution().analyzed()

    def optimized(self, df: DataFrame):
        return df._jdf.queryExecution().optimizedPlan()

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def column(self, expression) -> Column:
        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def parse(self, sql: str):
        """A named expression from SQL text; the analyzer resolves it where it is put."""
        return self.spark._jsparkSession.sessionState().sqlParser().parseExpression(sql)

    def children(self, node) -> list:
        return items(node.children())

    def output(self, node) -> list:
        return items(node.output())

    def attribute(self, node, name: str):
        return next(a for a in reversed(self.output(node)) if a.name() == name)

    def name(self, node) -> str:
        return node.nodeName().split(" ")[0]

    def kind(self, node) -> str:
        return node.getClass().getSimpleName()

    def walk(self, node) -> Iterator:
        """Post-order, children first."""
        for c in self.children(node):
            yield from self.walk(c)
        yield node

    def everywhere(self, node) -> Iterator:
        """walk, with the plans of subquery expressions."""
        for n in self.walk(node):
            for sub in self.subqueries(n):
                yield from self.everywhere(sub)
            yield n

    def with_subqueries(self, node, change):
        """The node with the plans of its subquery expressions changed."""

        def inside(e):
            if holds_plan(e):
                return e.withNewPlan(change(e.plan()))
            kids = items(e.children())
            new = [inside(c) for c in kids]
            return e.withNewChildren(self.seq(new)) if any(a is not b for a, b in zip(kids, new, strict=True)) else e

        if not self.subqueries(node):
            return node
        kind, child = self.kind(node), self.children(node)[0]
        if kind == "Filter":
            return self.filter(inside(node.condition()), child)
        if kind == "Project":
            return self.project([inside(e) for e in items(node.projectList())], child)
        if kind == "Aggregate":
            return self.aggregate([inside(e) for e in items(node.groupingExpressions())], [inside(e) for e in items(node.aggregateExpressions())], child)
        raise UnsupportedOperator(kind, "a subquery")

    def with_children(self, node, children: list):
        return node.withNewChildren(self.seq(children))

    def inline(self, plan):
        """CTEs inlined; subquery predicates and set operations as joins."""
        kinds = {self.kind(n) for n in self.walk(plan)}
        if kinds & {"WithCTE", "CTERelationDef", "CTERelationRef"}:
            plan = self._rules.InlineCTE(True, False).apply(plan)
        if any(self.subqueries(n) for n in self.walk(plan)):
            plan = self._rules.PullupCorrelatedPredicates.apply(plan)
            plan = self._rules.RewritePredicateSubquery.apply(plan)
            if any(self.subqueries(n) for n in self.walk(plan)):
                plan = self._rules.RewriteCorrelatedScalarSubquery.apply(plan)
        if kinds & {"Intersect", "Except"}:
            plan = self._rules.ReplaceIntersectWithSemiJoin.apply(plan)
            plan = self._rules.ReplaceExceptWithAntiJoin.apply(plan)
        return plan

    def subqueries(self, node) -> list:
        return items(node.subqueries())

    def project(self, expressions: list, child):
        return self.jvm.org.apache.spark.sql.catalyst.plans.logical.Project(self.seq(expressions), child)

    def filter(self, condition, child):
        return self.jvm.org.apache.spark.sql.catalyst.plans.logical.Filter(condition, child)

    def alias(self, expression, name: str):
        """The expression under a name of its own."""
        catalyst = self.jvm.org.apache.spark.sql.catalyst.expressions
        return catalyst.Alias(expression, name, catalyst.NamedExpression.newExprId(), self.seq([]), self.none(), self.seq([]))

    def negate(self, condition):
        return getattr(self.jvm.org.apache.spark.sql.catalyst.expressions, "Not")(condition)

    def none(self):
        return self.jvm.scala.Option.empty()

    def aggregate(self, grouping: list, expressions: list, child):
        return self.jvm.org.apache.spark.sql.catalyst.plans.logical.Aggregate(self.seq(grouping), self.seq(expressions), child, self.none())

    def expand(self, projections: list[list], output: list, child):
        return self.jvm.org.apache.spark.sql.catalyst.plans.logical.Expand(self.seq([self.seq(p) for p in projections]), self.seq(output), child)
