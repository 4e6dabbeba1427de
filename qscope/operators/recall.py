"""Is lineage complete? A query runs again over nothing but the witnesses of some of its rows;
all of these must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qscope.operators.lineage import Lineage
from qscope.operators.rerun import with_scans
from qscope.plans.adapter import as_query

#: How far apart two results of one sum may be, for the order of its terms: as a share of the
#: larger one, or of 1 where both are smaller.
APART = {"double": 1e-9, "float": 1e-6}


def _near(x: Column, y: Column, apart: float) -> Column:
    """Equal, or finite and no further apart than allowed."""
    most, inf = F.greatest(F.abs(x), F.abs(y), F.lit(1.0)), F.lit(float("inf"))
    return x.eqNullSafe(y) | F.coalesce((most < inf) & (F.abs(x - y) <= most * apart), F.lit(False))


def lost(wanted: DataFrame, again: DataFrame) -> int:
    """How many rows of wanted again lacks, with repeats. Doubles that are near each other are
    one value, in columns of their own; inside of arrays and structs they must be equal. Both
    are read once, as sums may differ from one reading to the next."""
    kinds = [f.dataType.typeName() for f in wanted.schema]
    names = [f"c{i}" for i in range(len(kinds))]
    plain = [n for n, k in zip(names, kinds, strict=True) if k not in APART]
    sides = wanted.toDF(*names).withColumn("n", F.lit(1)).unionAll(again.toDF(*names).withColumn("n", F.lit(-1)))
    rows = sides.groupBy(*names).agg(F.sum("n").alias("n")).where("n != 0")
    for n, k in zip(names, kinds, strict=True):
        if k in APART:
            # Within rows that agree in the other columns, a gap starts the next value.
            x, order = F.col(n).cast("double"), Window.partitionBy(*plain).orderBy(n)
            rows = rows.withColumn(f"{n}_new", (~_near(x, F.lag(x).over(order), APART[k])).cast("long"))
            rows = rows.withColumn(f"{n}_value", F.sum(f"{n}_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    values = [n if n in plain else f"{n}_value" for n in names]
    return rows.groupBy(*values).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0))).first()[0]


def recall(spark: SparkSession, query: str | DataFrame, where: str = "true") -> tuple[int, int]:
    """(output rows that `where` selects, how many of them the witnesses give). Sources that a
    row depends on by what they lack, as under an anti join, stay whole."""
    df = as_query(spark, query)
    lin = Lineage(spark, df)
    data = {s.attributes: s.rows.join(lin.witnesses(lin.annotated.where(where), s), "rid", "left_semi").drop("rid") for s in lin.sources if not s.silent}
    wanted = df.where(where)
    total = wanted.count()
    return total, total - lost(wanted, with_scans(spark, df, data))


#: (name, query, selected rows): one of each shape that lineage answers.
CORPUS = [
    ("filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000", "o_orderkey < 500"),
    ("aggregate", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY o_orderstatus", "o_orderstatus = 'F'"),
    ("join aggregate", "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", "c_mktsegment = 'MACHINERY'"),
    ("expression keys", "SELECT o_custkey % 7 AS g, upper(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY o_custkey % 7, upper(o_orderstatus)", "g = 3"),
    ("global aggregate", "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders", "true"),
    ("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", "true"),
    ("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "o_orderstatus = 'F' AND o_orderpriority IS NOT NULL"),
    ("count distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", "o_orderstatus = 'P'"),
    ("distinct", "SELECT DISTINCT o_orderpriority FROM orders", "o_orderpriority = '5-LOW'"),
    ("left join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "c_custkey < 50"),
    ("full join", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) x FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) y ON c_custkey = o_custkey", "o_orderkey < 500"),
    ("three-way join", "SELECT n_name, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000", "n_name = 'NATION_3'"),
    ("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", "c_custkey < 500"),
    ("in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)", "true"),
    ("not exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", "c_custkey < 500"),
    ("scalar subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", "true"),
    ("correlated scalar", "SELECT o_orderkey FROM orders a WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)", "true"),
    ("window rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders", "o_orderkey = 5"),
    ("window share", "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderdate) AS share FROM orders", "o_orderkey < 20"),
    ("top rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "true"),
    ("union all", "SELECT user_id AS k FROM events WHERE event_type = 'click' UNION ALL SELECT o_custkey FROM orders", "k < 20"),
    ("union", "SELECT user_id AS k FROM events UNION SELECT o_custkey FROM orders", "k < 20"),
    ("intersect", "SELECT user_id AS k FROM events INTERSECT SELECT o_custkey FROM orders", "k < 20"),
    ("except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events WHERE event_type = 'click'", "true"),
    ("explode", "SELECT w, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS w FROM documents) t GROUP BY w", "w = 'the'"),
    ("aggregate of aggregate", "SELECT c_mktsegment, max(s) AS m FROM (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) t JOIN customer ON k = c_custkey GROUP BY c_mktsegment", "c_mktsegment = 'BUILDING'"),
    ("common table twice", "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT a.k, b.k AS other FROM t a JOIN t b ON a.k = b.k + 1", "k < 30 AND other < 30"),
    ("case in aggregate", "SELECT c_mktsegment, sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS big FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", "big > 0"),
    ("filter on aggregate", "SELECT k FROM (SELECT o_custkey AS k, avg(o_totalprice) AS a FROM orders GROUP BY o_custkey) t WHERE a > 300000", "true"),
    ("ranked aggregate", "SELECT * FROM (SELECT c_nationkey, c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_mktsegment)) t WHERE r = 1", "c_nationkey < 5"),
]
