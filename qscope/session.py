"""Everything in one place: tools over one query, and revisions of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from qscope.functions.udf_reader import Profile, analyze
from qscope.operators import debug, influence, isolation, pathtests, recall, rerun, spectrum, steps
from qscope.operators.incremental import Incremental, Run
from qscope.operators.lineage import Lineage
from qscope.operators.oracles import Wrong
from qscope.plans.adapter import Plans, as_query


@dataclass(frozen=True)
class Settings:
    """strict refuses lineage of rows that depend on the run; capacity bounds what a
    watchpoint keeps, paths and iterations what tests try."""

    strict: bool = True
    capacity: int = 1000
    max_paths: int = 32
    iterations: int = 20
    seed: int = 0


@dataclass
class Version:
    """A revision of a query."""

    number: int
    query: str | DataFrame
    run: Run


@dataclass
class Session:
    """Tools over queries of one Spark session. Python functions that queries call are made
    known by `udf`, so that tests and fuzzing see inside them."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    udfs: dict[str, Profile] = field(default_factory=dict)
    versions: list[Version] = field(default_factory=list)

    def __post_init__(self):
        Plans(self.spark)  # refuses sessions whose plans can't be read
        self._incremental = Incremental(self.spark)

    def udf(self, name: str, fn: Callable, returns: str) -> None:
        """Register a Python function for SQL, and read it."""
        self.spark.udf.register(name, fn, returns)
        self.udfs[name] = analyze(fn, name)

    def lineage(self, query: str | DataFrame) -> Lineage:
        return Lineage(self.spark, query, self.settings.strict)

    def steps(self, query: str | DataFrame) -> list[steps.Step]:
        return steps.decompose(self.spark, query)

    def sources(self, query: str | DataFrame) -> list[str]:
        return rerun.substitutable(self.spark, query)

    def rerun(self, query: str | DataFrame, data: dict[str, DataFrame]) -> DataFrame:
        return rerun.with_data(self.spark, query, data)

    def watch(self, query: str | DataFrame, guard: str | Column, step: int | None = None) -> debug.Watchpoint:
        """A watchpoint on the output, or on the rows of a step."""
        return debug.Watchpoint(self._at(query, step), guard, self.settings.capacity)

    def breakpoint(self, query: str | DataFrame, step: int | None = None) -> debug.Breakpoint:
        return debug.Breakpoint(self._at(query, step))

    def profile(self, query: str | DataFrame, expression: str | Column, step: int | None = None) -> debug.Profile:
        """What an expression costs for each row of the output, or of a step."""
        return debug.Profile(self._at(query, step), expression)

    def costs(self, query: str | DataFrame) -> list[debug.OperatorCost]:
        return debug.operator_costs(as_query(self.spark, query))

    def _at(self, query: str | DataFrame, step: int | None) -> DataFrame:
        return as_query(self.spark, query) if step is None else self.steps(query)[step].data

    def crash_culprit(self, source: DataFrame, then: Callable[[DataFrame], DataFrame]) -> debug.Culprit | None:
        return debug.crash_culprit(source, then)

    def influence(self, query: str | DataFrame, where: str, top: int | None = None) -> DataFrame:
        if top is None:
            return influence.influence(self.spark, query, where)
        return influence.most_influential(self.spark, query, where, top)

    def isolate(self, query: str | DataFrame, table: str, wrong: Wrong) -> isolation.Isolated:
        return isolation.isolate(self.spark, query, table, wrong)

    def localize(self, query: str | DataFrame, wrong: Wrong, formula: str = "tarantula", table: str | int = 0, narrow: bool = False) -> list[spectrum.Suspect]:
        return spectrum.localize(self.spark, query, wrong, formula, table, narrow)

    def recall(self, query: str | DataFrame, where: str = "true") -> tuple[int, int]:
        return recall.recall(self.spark, query, where)

    def tests(self, query: str | DataFrame, seeds: dict[str, DataFrame], declared: dict[str, str] | None = None) -> list[pathtests.PathCase]:
        return pathtests.generate_tests(self.spark, query, seeds, self.settings.max_paths, seed=self.settings.seed, declared=declared, udfs=self.udfs)

    def verify(self, query: str | DataFrame, seeds: dict[str, DataFrame], case: pathtests.PathCase) -> str:
        return pathtests.verify(self.spark, query, seeds, case, self.udfs)

    def fuzz(self, query: str | DataFrame, seeds: dict[str, DataFrame], strategy: str = "co-dependent") -> pathtests.FuzzResult:
        return pathtests.fuzz(self.spark, query, seeds, self.settings.iterations, strategy=strategy, seed=self.settings.seed, udfs=self.udfs)

    # ---- revisions

    def revise(self, query: str | DataFrame) -> Version:
        """The next revision of a query, over what earlier ones left."""
        self.versions.append(Version(len(self.versions) + 1, query, self._incremental.run(query)))
        return self.versions[-1]

    def between(self, first: int, last: int) -> list[Version]:
        """Revisions by number, both ends included."""
        if not 1 <= first <= last <= len(self.versions):
            raise ValueError(f"revisions {first} to {last}; there are {len(self.versions)}")
        return self.versions[first - 1 : last]

    def changed(self, first: int, last: int) -> tuple[DataFrame, DataFrame]:
        """Rows that only the one revision gives, and that only the other does."""
        a, b = (self.between(i, i)[0].run.df for i in (first, last))
        return a.exceptAll(b), b.exceptAll(a)

    def close(self) -> None:
        """Drop what revisions left."""
        self._incremental.clear()
        self.versions.clear()
