"""Step-through decomposition: a query's operators and conditional branches, each with the
rows that flow out of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from qscope.plans.adapter import Plans, UnsupportedOperator, as_query, items

TRANSPARENT = {"SubqueryAlias", "View"}


@dataclass
class Branch:
    condition: str
    negated: bool
    expression: object
    data: DataFrame


@dataclass
class Step:
    id: int
    operator: str
    detail: str
    children: list[int]
    schema: object
    plan: str
    node: object
    branches: list[Branch] = field(default_factory=list)
    _plans: Plans | None = None

    @property
    def data(self) -> DataFrame:
        try:
            return self._plans.frame(self.node)
        except Exception as e:
            raise UnsupportedOperator(self.operator, f"it can't run by itself: {str(e).splitlines()[0][:200]}") from e


def _detail(p: Plans, node, name: str | None) -> str:
    kind = p.kind(node)
    sqls = lambda seq: ", ".join(e.sql() for e in items(seq))
    if kind == "Filter":
        return node.condition().sql()
    if kind == "Join":
        on = node.condition()
        return node.joinType().sql() + (f" ON {on.get().sql()}" if on.isDefined() else "")
    if kind == "Aggregate":
        keys = sqls(node.groupingExpressions())
        return sqls(node.aggregateExpressions()) + (f" GROUP BY {keys}" if keys else "")
    if kind == "Project":
        return sqls(node.projectList())
    if kind == "Sort":
        return sqls(node.order())
    if kind in ("GlobalLimit", "LocalLimit"):
        return node.limitExpr().sql()
    if kind == "Window":
        return sqls(node.windowExpressions())
    if kind == "Union":
        return "UNION ALL"
    if kind == "Deduplicate":
        return sqls(node.keys())
    return name or ""


def conditions(p: Plans, node) -> list:
    """(condition, negated): a filter's condition and its negation, every IF's and CASE arm's."""
    out = []

    def inside(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "CaseWhen":
            out.extend((b._1(), False) for b in items(e.branches()))
        elif kind == "If":
            out.extend([(e.predicate(), False), (e.predicate(), True)])
        for c in items(e.children()):
            inside(c)

    if p.kind(node) == "Filter":
        out += [(node.condition(), False), (node.condition(), True)]
    for e in items(node.expressions()):
        inside(e)
    return out


def conjuncts(expression) -> list:
    """An AND refined to itself and its sides, recursively; anything else to itself."""
    if expression.getClass().getSimpleName() == "And":
        return [expression, *conjuncts(expression.left()), *conjuncts(expression.right())]
    return [expression]


def decompose(spark: SparkSession, query: str | DataFrame) -> list[Step]:
    """The steps of the analyzed plan, children first, equal sub-plans once."""
    p = Plans(spark)
    root = p.analyzed(as_query(spark, query))
    if any(p.kind(n) == "WithCTE" for n in p.walk(root)):
        root = p.inline(root)
    steps: list[Step] = []
    seen: dict[str, int] = {}

    def visit(node, name: str | None) -> int:
        kind = p.kind(node)
        if kind in TRANSPARENT:
            here = node.alias() if kind == "SubqueryAlias" else None
            return visit(p.children(node)[0], f"{here} AS {name}" if here and name and here != name else name or here)
        key = str(node.canonicalized().hashCode()) + node.canonicalized().toString()
        if key in seen:
            return seen[key]
        kids = [visit(c, None) for c in p.children(node)]
        for s in p.subqueries(node):
            if not any("outer(" in x.toString() for x in p.walk(s)):
                kids.append(visit(s, None))
        operator = "Relation" if kind.endswith("Relation") else kind
        step = Step(len(steps), operator, _detail(p, node, name), kids, node.schema(), node.treeString(), node, [], p)
        if len(p.children(node)) == 1:
            child, child_ids = p.children(node)[0], {a.exprId().id() for a in p.output(p.children(node)[0])}
            for e, negated in conditions(p, node):
                refs = {a.exprId().id() for a in items(e.references().toSeq())}
                if e.dataType().simpleString() != "boolean" or not e.deterministic() or not refs <= child_ids or p.subqueries(node):
                    continue
                cond = p.negate(e) if negated else e
                step.branches.append(Branch(e.sql(), negated, e, p.frame(p.filter(cond, child))))
        steps.append(step)
        seen[key] = step.id
        return step.id

    visit(root, None)
    return steps


def counts(spark: SparkSession, query: str | DataFrame) -> list[tuple[int, str, int]]:
    """(step, operator, rows) of every step."""
    return [(s.id, s.operator, s.data.count()) for s in decompose(spark, query)]
