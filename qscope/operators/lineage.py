"""Record lineage by rewriting: a query is cut into segments at its aggregates, windows and
semi joins. Within a segment every row carries the id of one row of each source, as a pair of
file and row; where a segment ends, its rows have the key of the group, partition or row they
go into. Tracing is then a chain of semi joins by key, from the chosen output rows down to
source rows or back up; no group's ids are ever gathered, and nothing is captured at run time.

Sources and sub-plans are read again by each trace, so they must give the same rows: bare
limits and samples are refused, and ties under an ordered limit should be broken."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qscope.plans.adapter import Plans, UnsupportedOperator, as_query, items

PASS = {"Filter", "Sort", "GlobalLimit", "LocalLimit", "Repartition", "RepartitionByExpression", "RebalancePartitions", "ResolvedHint", "Sample", "Generate", "BatchEvalPython", "ArrowEvalPython", "Offset", "Tail"}
LEAVES = {"LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "InMemoryRelation", "OneRowRelation", "ExternalRDD"}
LIMITS = {"GlobalLimit", "LocalLimit", "Tail", "Offset", "Sample"}
JOINS = {"Inner", "LeftOuter", "RightOuter", "FullOuter", "Cross"}


@dataclass
class Source:
    """A scan: its names, its column of ids, its rows with `rid`, and the parts that lie
    between it and the output."""

    names: list[str]
    column: str
    rows: DataFrame
    #: Its attributes, by which the same scan is known in sub-plans.
    attributes: tuple[int, ...] = ()
    route: list[Part] = field(default_factory=list)
    # An anti join's right side: nothing of it stands behind a row.
    silent: bool = False

    @property
    def name(self) -> str:
        return self.names[0] if self.names else self.column


@dataclass
class Part:
    """What goes into a group, partition or matched row. `keys` are columns of `rows` and of
    the segment above, where `present` marks the rows that come from here."""

    operator: str
    present: str
    keys: list[str]
    rows: DataFrame
    #: Sources and parts directly behind its rows.
    inside: list[Source | Part]
    #: The operator in the analyzed plan.
    node: object = None

    @property
    def hidden(self) -> list[str]:
        """Columns of `rows` that the operator's input does not have."""
        return [*self.keys, *id_columns(self.inside)]


def id_columns(below: list[Source | Part]) -> list[str]:
    return [c for b in below for c in ([b.column] if isinstance(b, Source) else [b.present, *b.keys])]


@dataclass
class Segment:
    plan: object
    #: Columns that identify rows below, in this plan's output.
    ids: list[str]
    #: Sources and parts met here, in order.
    below: list[Source | Part]


class Lineage:
    """The lineage of one query. strict refuses bare limits and samples, whose rows depend on
    the run."""

    def __init__(self, spark: SparkSession, query: str | DataFrame, strict: bool = True):
        self.spark, self.plans = spark, Plans(spark)
        self.result = as_query(spark, query)
        self.sources: list[Source] = []
        self.strict = strict
        self._parts = 0
        plan = self.plans.inline(self.plans.analyzed(self.result))
        top = self._segment(plan, ordered=False)
        self.below, self.ids = top.below, top.ids
        #: The query's rows and the ids of what is directly behind them.
        self.annotated = self.plans.frame(top.plan)
        self._routes(top.below, [])

    def _routes(self, below: list[Source | Part], route: list[Part]) -> None:
        for b in below:
            if isinstance(b, Source):
                b.route = route
            else:
                self._routes(b.inside, [*route, b])

    # ---- rewriting

    def _leaf(self, plan) -> Segment:
        p, i = self.plans, len(self.sources)
        df = p.frame(plan)
        column = f"__rid_{i}"
        number = F.monotonically_increasing_id()
        file = F.lit(0).cast("long")
        if p.kind(plan) == "LogicalRelation" and "HadoopFsRelation" in plan.relation().getClass().getName():
            file = F.xxhash64(F.col("_metadata.file_path"))
            if plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
                number = F.col("_metadata.row_index")
        # Other numbers are stable while the source's partitions are: files, or data that is
        # already there.
        rid = F.struct(file.alias("f"), number.alias("r"))
        self.sources.append(Source([], column, df.select("*", rid.alias("rid")), tuple(a.exprId().id() for a in p.output(plan))))
        return Segment(p.analyzed(df.select("*", rid.alias(column))), [column], [self.sources[-1]])

    def _done(self, plan):
        """The plan, analyzed, so that its attributes can be referred to."""
        return self.plans.analyzed(self.plans.frame(plan))

    def _part(self, operator: str, keys: list[str], rows, inside: list, node=None) -> Part:
        self._parts += 1
        return Part(operator, f"__in_{self._parts - 1}", keys, self.plans.frame(rows), inside, node)

    def _cut(self, node, child: Segment, keys: list, upper) -> Segment:
        """A part whose rows are the child's, keyed by expressions over it. upper: the plan
        above from the aliased keys."""
        p = self.plans
        names = [f"__key_{self._parts}_{i}" for i in range(len(keys))]
        rows = self._done(p.project([*p.output(child.plan), *[p.alias(k, n) for k, n in zip(keys, names, strict=True)]], child.plan))
        part = self._part(p.kind(node), names, rows, child.below, node)
        plan = self._done(upper([p.alias(k, n) for k, n in zip(keys, names, strict=True)]))
        return Segment(self._flagged(plan, part), [part.present, *names], [part])

    def _flagged(self, plan, part: Part):
        return self.plans.analyzed(self.plans.frame(plan).select("*", F.lit(True).alias(part.present)))

    def _segment(self, node, ordered: bool) -> Segment:
        found = self._operator(node, ordered)
        for sub in self.plans.subqueries(node):
            # A value for all rows: everything behind it is behind each of them.
            inner = self._segment(sub, False)
            part = self._part("ScalarSubquery", [], inner.plan, inner.below)
            found = Segment(self._flagged(found.plan, part), [*found.ids, part.present], [*found.below, part])
        return found

    def _operator(self, node, ordered: bool) -> Segment:
        p, kind = self.plans, self.plans.kind(node)
        if any("outer(" in n.toString() for s in p.subqueries(node) for n in p.walk(s)):
            raise UnsupportedOperator(kind, "a correlated subquery that isn't a join")
        if kind in ("SubqueryAlias", "View"):
            before = len(self.sources)
            found = self._segment(p.children(node)[0], ordered)
            if kind == "SubqueryAlias" and len(self.sources) == before + 1:
                self.sources[-1].names.insert(0, node.alias())
            return found
        if kind in LEAVES:
            return self._leaf(node)
        if self.strict and kind in LIMITS and not ordered and not self._sorted_below(node):
            raise UnsupportedOperator(kind, "its rows depend on the run; order them or use strict=False")
        if kind == "Union":
            return self._union(node)
        if kind == "Join":
            return self._join(node)
        kids = p.children(node)
        if len(kids) != 1:
            raise UnsupportedOperator(kind)
        child, plain = self._segment(kids[0], ordered or kind in LIMITS), kids[0]
        attrs = [p.attribute(child.plan, c) for c in child.ids]
        if kind == "Project":
            return Segment(self._done(p.project([*items(node.projectList()), *attrs], child.plan)), child.ids, child.below)
        if kind in PASS:
            return Segment(self._done(p.with_children(node, [child.plan])), child.ids, child.below)
        if kind == "Expand":
            rows = [[*items(x), *attrs] for x in items(node.projections())]
            return Segment(self._done(p.expand(rows, [*p.output(node), *attrs], child.plan)), child.ids, child.below)
        if kind == "Aggregate":
            keys = items(node.groupingExpressions())
            return self._cut(node, child, keys, lambda named: p.aggregate(keys, [*items(node.aggregateExpressions()), *named], plain))
        if kind == "Distinct":
            return self._cut(node, child, p.output(plain), lambda named: p.project([*p.output(node), *named], node))
        if kind == "Deduplicate":
            return self._cut(node, child, items(node.keys()), lambda named: p.project([*p.output(node), *named], node))
        if kind == "Window":
            return self._cut(node, child, items(node.partitionSpec()), lambda named: p.project([*p.output(node), *named], node))
        raise UnsupportedOperator(kind)

    def _sorted_below(self, node) -> bool:
        while self.plans.kind(node) in {*LIMITS, "Project", "SubqueryAlias"} and self.plans.children(node):
            node = self.plans.children(node)[0]
        return self.plans.kind(node) == "Sort"

    def _union(self, node) -> Segment:
        p = self.plans
        parts = [self._segment(c, False) for c in p.children(node)]
        types = {c: p.attribute(s.plan, c).dataType().sql() for s in parts for c in s.ids}
        plans = []
        for s in parts:
            keep = [a for a in p.output(s.plan) if a.name() not in s.ids]
            more = [p.attribute(s.plan, c) if c in s.ids else p.parse(f"CAST(NULL AS {t}) AS {c}") for c, t in types.items()]
            plans.append(self._done(p.project([*keep, *more], s.plan)))
        return Segment(self._done(p.with_children(node, plans)), list(types), [b for s in parts for b in s.below])

    def _join(self, node) -> Segment:
        p = self.plans
        plain = p.children(node)[1]
        left = self._segment(p.children(node)[0], False)
        before = len(self.sources)
        right = self._segment(plain, False)
        how = node.joinType().toString().split("(")[0]
        if how in JOINS:
            return Segment(self._done(p.with_children(node, [left.plan, right.plan])), left.ids + right.ids, left.below + right.below)
        if how not in ("LeftSemi", "LeftAnti", "ExistenceJoin"):
            raise UnsupportedOperator(f"Join {how}")
        kept = self._done(p.with_children(node, [left.plan, plain]))
        if how == "LeftAnti":
            # What made the row is that nothing on the right matched: no witness there.
            for s in self.sources[before:]:
                s.silent = True
            return Segment(kept, left.ids, left.below)
        logical = p.jvm.org.apache.spark.sql.catalyst.plans.logical
        inner = p.jvm.org.apache.spark.sql.catalyst.plans.JoinType.apply("inner")
        matched = self._done(logical.Join(left.plan, right.plan, inner, node.condition(), node.hint()))
        part = self._part(how, left.ids, matched, right.below)
        return Segment(self._flagged(kept, part), [*left.ids, part.present], [*left.below, part])

    # ---- tracing

    def source(self, which: int | str) -> Source:
        """A source by its number or by one of its names, which must be that of one only."""
        if isinstance(which, int):
            return self.sources[which]
        found = [s for s in self.sources if any(n == which or n.endswith("." + which) for n in s.names)]
        if len(found) != 1:
            raise KeyError(f"{'no source' if not found else 'several sources'} {which}; there are {[s.names for s in self.sources]}")
        return found[0]

    def down(self, rows: DataFrame, part: Part) -> DataFrame:
        """The rows of a part that went into some rows of the segment above."""
        return match(part.rows, rows.where(F.col(part.present)), part.keys)

    def witnesses(self, rows: DataFrame, source: Source) -> DataFrame:
        """(rid): the ids of a source behind some annotated output rows."""
        if source.silent:
            return source.rows.select("rid").limit(0)
        for part in source.route:
            rows = self.down(rows, part)
        return rows.where(F.col(source.column).isNotNull()).select(F.col(source.column).alias("rid")).distinct()

    def backward(self, where: str | Column, source: int | str = 0) -> DataFrame:
        """Rows of one source behind the output rows that satisfy `where`."""
        s = self.source(source)
        return s.rows.join(self.witnesses(self.annotated.where(where), s), "rid", "left_semi").drop("rid")

    def all_sources(self, where: str | Column) -> dict[str, DataFrame]:
        """Witnesses at every scan."""
        return {s.column: self.backward(where, i) for i, s in enumerate(self.sources)}

    def forward(self, where: str | Column, source: int | str = 0) -> DataFrame:
        """Output rows that the source rows satisfying `where` contributed to."""
        s = self.source(source)
        return self.plain(self.reached(s.rows.where(where).select("rid"), s))

    def reached(self, rids: DataFrame, source: Source) -> DataFrame:
        """Annotated output rows that some source rows (rid) contributed to."""
        if source.silent:
            return self.annotated.limit(0)
        frames = [self.annotated, *[p.rows for p in source.route]]
        now = frames[-1].join(rids.select(F.col("rid").alias(source.column)).distinct(), source.column, "left_semi")
        for part, above in zip(reversed(source.route), reversed(frames[:-1]), strict=True):
            now = match(above.where(F.col(part.present)), now, part.keys)
        return now

    def plain(self, rows: DataFrame) -> DataFrame:
        return rows.drop(*self.ids)

    def chain(self, source: Source) -> DataFrame:
        """(keys of the first part, rid), distinct: what of a source is in each group below
        the output."""
        now = None
        for i in range(len(source.route) - 1, -1, -1):
            part = source.route[i]
            if now is None:
                now = part.rows.where(F.col(source.column).isNotNull()).select(*part.keys, F.col(source.column).alias("rid")).distinct()
            else:
                under = source.route[i + 1]
                now = paired(part.rows.where(F.col(under.present)), now, under.keys).select(*part.keys, "rid").distinct()
        return now

    def edges(self, source: int | str = 0) -> DataFrame:
        """(output columns..., rid): the lineage as a table that any writer can store."""
        s = self.source(source)
        if not s.route:
            rows = self.annotated.where(F.lit(False)) if s.silent else self.annotated.where(F.col(s.column).isNotNull())
            return self.plain(rows.withColumn("rid", F.col(s.column) if not s.silent else F.lit(None).cast("struct<f: bigint, r: bigint>")))
        return self.plain(paired(self.annotated.where(F.col(s.route[0].present)), self.chain(s), s.route[0].keys))

    def capture(self) -> list[DataFrame]:
        """The query's lineage at its least cost: for every part, its keys and the ids of what
        lies in it, and the ids of the output rows."""
        parts = {id(p): p for s in self.sources for p in s.route}.values()
        return [self.annotated, *[p.rows.select(*dict.fromkeys(p.hidden)) for p in parts]]

    def witness_counts(self) -> DataFrame:
        """The output with n_<i>: how many rows of source i are behind each row."""
        out = self.annotated
        together: dict[int, list[int]] = {}
        for i, s in enumerate(self.sources):
            if s.silent:
                out = out.withColumn(f"n_{i}", F.lit(0).cast("long"))
            elif not s.route:
                out = out.withColumn(f"n_{i}", F.col(s.column).isNotNull().cast("long"))
            else:
                together.setdefault(id(s.route[0]), []).append(i)
        for group in together.values():
            part = self.sources[group[0]].route[0]
            direct = [i for i in group if len(self.sources[i].route) == 1]
            counts = [part.rows.groupBy(*part.keys).agg(*[F.count_distinct(self.sources[i].column).alias(f"n_{i}") for i in direct])] if direct else []
            counts += [self.chain(self.sources[i]).groupBy(*part.keys).agg(F.count("*").alias(f"n_{i}")) for i in group if i not in direct]
            for c in counts:
                out = paired(out, c, part.keys, "left", part.present)
        numbers = [F.coalesce(f"n_{i}", F.lit(0)).cast("long").alias(f"n_{i}") for i in range(len(self.sources))]
        attributes = [c for c in out.columns if c not in self.ids and c not in {f"n_{i}" for i in range(len(self.sources))}]
        return out.select(*attributes, *numbers)

    # ---- tracing by rows

    def collect(self, limit: int | None = None) -> list[Traced]:
        """The output with each row's id, which `trace` takes."""
        rows = self.annotated if limit is None else self.annotated.limit(limit)
        hidden = [c in self.ids for c in self.annotated.columns]
        make = Row(*self.plain(self.annotated).columns)
        return [Traced(make(*[v for v, h in zip(r, hidden, strict=True) if not h]), tuple(v for v, h in zip(r, hidden, strict=True) if h)) for r in rows.collect()]

    def trace(self, ids: Iterable[tuple]) -> Cursor:
        """A cursor on the output rows with some ids."""
        names = [c for c in self.annotated.columns if c in self.ids]
        schema = StructType([self.annotated.schema[c] for c in names])
        wanted = self.spark.createDataFrame([tuple(i) for i in ids], schema)
        return Cursor(self, match(self.annotated, wanted, names))


@dataclass(frozen=True)
class Traced:
    row: Row
    id: tuple


class Cursor:
    """A place on the way from output rows to source rows."""

    def __init__(self, lineage: Lineage, rows: DataFrame):
        self.lineage = lineage
        self._path: list[tuple[str, DataFrame, list[Source | Part], list[str]]] = [("output", rows, lineage.below, lineage.ids)]

    @property
    def branches(self) -> list[str]:
        """What can be gone back to from here."""
        return [b.name if isinstance(b, Source) else b.operator for b in self._path[-1][2]]

    def go_back(self, branch: int = 0) -> Cursor:
        """To the rows directly behind the present ones: a source's, or what went into a
        group, partition or semi join."""
        _, rows, below, _ = self._path[-1]
        if not below:
            raise ValueError("the cursor is at source rows")
        if not 0 <= branch < len(below):
            raise ValueError(f"there is no branch {branch}; there are {self.branches}")
        b = below[branch]
        if isinstance(b, Source):
            rids = rows.where(F.col(b.column).isNotNull()).select(F.col(b.column).alias("rid")).distinct()
            step = (b.name, b.rows.join(rids, "rid", "left_semi"), [], ["rid"])
        else:
            step = (b.operator, self.lineage.down(rows, b), b.inside, b.hidden)
        self._path.append(step)
        return self

    def go_next(self) -> Cursor:
        """Back towards the output by one step."""
        if len(self._path) == 1:
            raise ValueError("the cursor is at the output")
        self._path.pop()
        return self

    @property
    def place(self) -> str:
        return self._path[-1][0]

    def show(self, full: bool = False) -> DataFrame:
        """The rows here; full keeps the columns of ids."""
        _, rows, _, hidden = self._path[-1]
        return rows if full else rows.drop(*hidden)


def match(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys stand in other, nulls compared as values."""
    if not keys:
        return rows.join(F.broadcast(other.select(F.lit(1).alias("__one")).limit(1)), F.lit(True), "left_semi")
    named = other.select(*[F.col(k).alias(f"{k}__other") for k in keys]).distinct()
    return rows.join(named, _equal(keys), "left_semi")


def paired(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", present: str | None = None) -> DataFrame:
    """rows joined with other's columns by key, nulls compared as values."""
    named = other.select(*[F.col(k).alias(f"{k}__other") for k in keys], *[c for c in other.columns if c not in keys])
    on = _equal(keys) if keys else F.lit(True)
    return rows.join(named, on & F.col(present) if present else on, how).drop(*[f"{k}__other" for k in keys])


def _equal(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__other"))
    return on


def lineage(spark: SparkSession, query: str | DataFrame, strict: bool = True) -> Lineage:
    return Lineage(spark, query, strict)
