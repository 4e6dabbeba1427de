"""Operation isolation: which operator or branch is most at fault, by how many source rows
behind wrong and right outputs pass through it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qscope.operators.isolation import narrowed
from qscope.operators.lineage import Lineage
from qscope.operators.oracles import Wrong, condition
from qscope.operators.steps import decompose
from qscope.plans.adapter import UnsupportedOperator, as_query


def tarantula(ef: int, ep: int, failing: int, passing: int) -> float:
    f, p = ef / failing if failing else 0.0, ep / passing if passing else 0.0
    return f / (f + p) if f + p else 0.0


def ochiai(ef: int, ep: int, failing: int, passing: int) -> float:
    d = math.sqrt(failing * (ef + ep))
    return ef / d if d else 0.0


FORMULAS = {"tarantula": tarantula, "ochiai": ochiai}


@dataclass(frozen=True)
class Suspect:
    step: int
    operation: str
    branch: bool
    failing: int
    passing: int
    score: float


def localize(spark: SparkSession, query: str | DataFrame, wrong: Wrong, formula: str = "tarantula", table: str | int = 0, narrow: bool = False) -> list[Suspect]:
    """Operations by suspicion. The source rows behind wrong and right outputs are marked;
    how many of them reach each step and branch is counted for all of them in one job. Rows
    behind both count on either side. narrow: of the rows behind wrong outputs, only those
    that delta debugging keeps are marked as such."""
    score = FORMULAS[formula.lower()]
    df = as_query(spark, query)
    lin = Lineage(spark, df)
    source = lin.source(table)
    bad = F.coalesce(condition(lin.result, wrong), F.lit(False))
    behind = narrowed(spark, df, lin, source, wrong) if narrow else lin.witnesses(lin.annotated.where(bad), source)
    marks = behind.withColumn("f", F.lit(True)).withColumn("p", F.lit(False)).unionAll(lin.witnesses(lin.annotated.where(~bad), source).withColumn("f", F.lit(False)).withColumn("p", F.lit(True)))
    marks = marks.groupBy("rid").agg(F.bool_or("f").alias("f"), F.bool_or("p").alias("p")).persist()
    try:
        total = marks.agg(F.count_if("f").alias("f"), F.count_if("p").alias("p")).first()
        if not total.f:
            raise ValueError("the oracle rejects no output row")
        places, reach = [], None
        for step in decompose(spark, df):
            if not step.children:
                continue
            for data, name, branch in [(step.data, f"{step.operator} {step.detail}", False), *((b.data, ("NOT " if b.negated else "") + b.condition, True) for b in step.branches)]:
                try:
                    part = Lineage(spark, data, strict=False)
                except UnsupportedOperator:
                    continue
                same = next((s for s in part.sources if s.attributes == source.attributes), None)
                if same is None:
                    continue
                rows = part.witnesses(part.annotated, same).select("rid", F.lit(len(places)).alias("place"))
                reach = rows if reach is None else reach.unionAll(rows)
                places.append((step.id, name, branch))
        if reach is None:
            return []
        counted = {r.place: r for r in reach.join(marks, "rid").groupBy("place").agg(F.count_if("f").alias("f"), F.count_if("p").alias("p")).collect()}
    finally:
        marks.unpersist()
    out = []
    for i, (step_id, name, branch) in enumerate(places):
        f, p = (counted[i].f, counted[i].p) if i in counted else (0, 0)
        out.append(Suspect(step_id, name, branch, f, p, score(f, p, total.f, total.p)))
    return sorted(out, key=lambda s: (-s.score, not s.branch, s.step))
