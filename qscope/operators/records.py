"""A record-oriented way to write queries, key by key, whose lineage is that of the DataFrame
they build. Functions are of columns, so they run in the JVM; Python functions go in as UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qscope.operators.lineage import Lineage

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}


class Records:
    """Rows with one column `value`, or with `key` and `value`."""

    def __init__(self, df: DataFrame):
        if df.columns not in (["value"], ["key", "value"]):
            raise ValueError(f"records have the columns value, or key and value, not {df.columns}")
        self.df = df

    @classmethod
    def text(cls, spark: SparkSession, path: str) -> Records:
        """Lines of text files."""
        return cls(spark.read.text(path))

    @classmethod
    def of(cls, spark: SparkSession, values: list, schema: str) -> Records:
        """Given values, of a type or a `key ..., value ...` schema."""
        if " " in schema:
            return cls(spark.createDataFrame(values, schema))
        return cls(spark.createDataFrame([(v,) for v in values], f"value {schema}"))

    @property
    def paired(self) -> bool:
        return "key" in self.df.columns

    def _pairs(self) -> DataFrame:
        if not self.paired:
            raise ValueError("these records have no key; use key_by")
        return self.df

    # ---- record by record

    def map(self, fn: Callable[[Column], Column]) -> Records:
        return Records(self.df.select(fn(F.col("value")).alias("value")))

    def filter(self, fn: Callable[[Column], Column]) -> Records:
        return Records(self.df.where(fn(F.col("value"))))

    def flat_map(self, fn: Callable[[Column], Column]) -> Records:
        """fn gives an array; each of its elements is a record."""
        return Records(self.df.select(F.explode(fn(F.col("value"))).alias("value")))

    def key_by(self, fn: Callable[[Column], Column]) -> Records:
        return Records(self.df.select(fn(F.col("value")).alias("key"), "value"))

    def map_pairs(self, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Records:
        return Records(self.df.select(key(F.col("value")).alias("key"), value(F.col("value")).alias("value")))

    def map_values(self, fn: Callable[[Column], Column]) -> Records:
        return Records(self._pairs().select("key", fn(F.col("value")).alias("value")))

    def flat_map_values(self, fn: Callable[[Column], Column]) -> Records:
        return Records(self._pairs().select("key", F.explode(fn(F.col("value"))).alias("value")))

    def keys(self) -> Records:
        return Records(self._pairs().select(F.col("key").alias("value")))

    def values(self) -> Records:
        return Records(self._pairs().select("value"))

    # ---- by key

    def reduce_by_key(self, how: str | Callable[[Column, Column], Column]) -> Records:
        """One record a key: by an aggregate's name, which combines before it shuffles, or by
        a function of two values, which takes a key's values as an array in no set order."""
        if isinstance(how, str):
            if how not in AGGREGATES:
                raise ValueError(f"unknown aggregate {how}; there are {sorted(AGGREGATES)}")
            return Records(self._pairs().groupBy("key").agg(AGGREGATES[how]("value").alias("value")))
        every = self._pairs().groupBy("key").agg(F.collect_list("value").alias("all"))
        first, rest = F.get("all", F.lit(0)), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
        return Records(every.select("key", F.aggregate(rest, first, how).alias("value")))

    def group_by_key(self) -> Records:
        return Records(self._pairs().groupBy("key").agg(F.collect_list("value").alias("value")))

    def count_by_key(self) -> Records:
        return Records(self._pairs().groupBy("key").agg(F.count("*").alias("value")))

    def distinct(self) -> Records:
        return Records(self.df.distinct())

    # ---- two sets of records

    def union(self, other: Records) -> Records:
        return Records(self.df.unionAll(other.df))

    def intersection(self, other: Records) -> Records:
        return Records(self.df.intersect(other.df))

    def subtract(self, other: Records) -> Records:
        return Records(self.df.subtract(other.df))

    def join(self, other: Records, how: str = "inner") -> Records:
        """Values in pairs (left, right) for equal keys; how: inner, left, right or full."""
        a, b = self._pairs().alias("a"), other._pairs().alias("b")
        both = a.join(b, F.col("a.key") == F.col("b.key"), how)
        key = F.coalesce("a.key", "b.key")
        return Records(both.select(key.alias("key"), F.struct(F.col("a.value").alias("left"), F.col("b.value").alias("right")).alias("value")))

    def cogroup(self, other: Records) -> Records:
        """For each key of either, the values of both as arrays."""
        one, two = self.group_by_key().df.alias("a"), other.group_by_key().df.alias("b")
        both = one.join(two, F.col("a.key") == F.col("b.key"), "full")
        kind = self.df.schema["value"].dataType.simpleString(), other.df.schema["value"].dataType.simpleString()
        left, right = (F.coalesce(F.col(f"{s}.value"), F.array().cast(f"array<{k}>")) for s, k in zip("ab", kind, strict=True))
        return Records(both.select(F.coalesce("a.key", "b.key").alias("key"), F.struct(left.alias("left"), right.alias("right")).alias("value")))

    # ---- order

    def sort_by(self, fn: Callable[[Column], Column], ascending: bool = True) -> Records:
        order = fn(F.col("value"))
        return Records(self.df.orderBy(order.asc() if ascending else order.desc()))

    def sort_by_key(self, ascending: bool = True) -> Records:
        return Records(self._pairs().orderBy(F.asc("key") if ascending else F.desc("key")))

    def top_by_key(self, n: int) -> Records:
        """The n greatest values of each key."""
        w = Window.partitionBy("key").orderBy(F.desc("value"))
        return Records(self._pairs().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("key", "value"))

    # ---- results

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list:
        return [tuple(r) if self.paired else r.value for r in self.df.collect()]

    def take(self, n: int) -> list:
        return [tuple(r) if self.paired else r.value for r in self.df.take(n)]

    def save_text(self, path: str) -> None:
        """A line a record; key and value with a tab between them."""
        self.df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in self.df.columns]).alias("value")).write.text(path)

    def lineage(self) -> Lineage:
        return Lineage(self.df.sparkSession, self.df)
