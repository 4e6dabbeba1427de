"""Registered queries of the debugging and testing engine, with equivalent DuckDB SQL. Each
runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qscope.functions import udf_reader
from qscope.operators import debug, influence, isolation, oracles, pathtests, recall, rerun, spectrum, steps
from qscope.operators.incremental import Incremental
from qscope.operators.lineage import Lineage
from qscope.operators.records import Records
from qscope.session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, tables=TABLES) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def register(name: str, oracle: str | None = None):
    def put(fn: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            load(spark, sf_dir)
            return fn(spark)

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return put


def same(name: str, sql: str, oracle: str | None = None) -> None:
    """A relational query whose SQL both engines run (oracle: DuckDB's where it differs)."""
    register(name, oracle or sql)(lambda spark: spark.sql(sql))


# ---------------------------------------------------------------- the relational surface

same("scan_filter_project", "SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    same(f"join_{kind.lower()}", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c {kind} JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey")
same("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
same("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
same("join_theta", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey")
same("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS t, round(stddev_samp(o_totalprice), 4) AS s FROM orders")
same("agg_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
same("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
for kind in ("ROLLUP", "CUBE"):
    same(f"agg_{kind.lower()}", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {kind} (o_orderstatus, o_orderpriority)")
same("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same("window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders")
same("window_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS t FROM orders")
same("window_lag_lead", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
same("window_share", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders")
same("set_union_all", "SELECT user_id AS k FROM events WHERE event_type = 'click' UNION ALL SELECT o_custkey FROM orders")
same("set_union", "SELECT user_id AS k FROM events UNION SELECT o_custkey FROM orders")
same("set_intersect", "SELECT user_id AS k FROM events INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
same("set_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events WHERE event_type = 'click'")
same("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
same("explode_words", "SELECT w AS word, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS w FROM documents) t WHERE w <> '' GROUP BY w", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t WHERE w <> '' GROUP BY w")
same("expr_case_cast_string", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CAST(substring(o_orderpriority, 1, 1) AS INT) AS p, upper(o_orderstatus) AS s, length(o_orderpriority) AS n, coalesce(nullif(o_orderstatus, 'F'), 'x') AS c FROM orders")
same("subquery_in_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 480000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
same("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
same("cte_two_level", "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_mktsegment, round(max(s), 2) AS m FROM t JOIN customer ON k = c_custkey GROUP BY c_mktsegment")

# ---------------------------------------------------------------- lineage

SEGMENTS = "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus")


@register("lineage_backward_agg", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark):
    return Lineage(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus").backward("o_orderstatus = 'F'").select(*ORDER_COLUMNS)


@register("lineage_backward_join_left", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def _(spark):
    return Lineage(spark, SEGMENTS).backward("c_mktsegment = 'MACHINERY'", "orders").select(*ORDER_COLUMNS)


@register("lineage_backward_join_right", "SELECT DISTINCT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def _(spark):
    return Lineage(spark, SEGMENTS).backward("c_mktsegment = 'MACHINERY'", "customer").select("c_custkey")


@register("lineage_forward_row", "SELECT DISTINCT c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey < 3")
def _(spark):
    return Lineage(spark, SEGMENTS).forward("o_orderkey < 3", "orders").select("c_mktsegment")


@register("lineage_all_sources", "SELECT 0 AS source, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 1, count(DISTINCT c_custkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(spark):
    found = Lineage(spark, SEGMENTS).all_sources("c_mktsegment = 'BUILDING'")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("source"), "n") for i, df in enumerate(found.values())]
    return parts[0].unionAll(parts[1])


@register("lineage_witness_counts", "SELECT c_mktsegment, count(*) AS n_0, count(DISTINCT c_custkey) AS n_1 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(spark):
    return Lineage(spark, SEGMENTS).witness_counts().select("c_mktsegment", "n_0", "n_1")


@register("lineage_distinct", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW'")
def _(spark):
    return Lineage(spark, "SELECT DISTINCT o_orderpriority FROM orders").backward("o_orderpriority = '5-LOW'").select(*ORDER_COLUMNS)


@register("lineage_union_branch", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 14")
def _(spark):
    return Lineage(spark, "SELECT user_id AS k FROM events WHERE event_type = 'click' UNION ALL SELECT o_custkey FROM orders").backward("k = 14", "events").select("event_id")


@register("lineage_window_peers", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 5)")
def _(spark):
    return Lineage(spark, "SELECT o_orderkey AS k, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders").backward("k = 5").select(*ORDER_COLUMNS)


@register("lineage_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n_0 FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(spark):
    return Lineage(spark, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)").witness_counts().drop("n")


@register("lineage_topk", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def _(spark):
    return Lineage(spark, "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7").backward("true").select(*ORDER_COLUMNS)


@register("lineage_semi", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 450000 AND o_custkey < 20")
def _(spark):
    return Lineage(spark, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)").backward("c_custkey < 20", "orders").select(*ORDER_COLUMNS)


@register("lineage_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(spark):
    return Lineage(spark, "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 450000)").backward("true", "c").select("c_custkey")


@register("lineage_explode", "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def _(spark):
    return Lineage(spark, "SELECT explode(split(text, ' ')) AS w FROM documents").backward("w = 'the'").select("doc_id")


@register("lineage_global_agg", "SELECT count(*) AS n_0 FROM orders")
def _(spark):
    return Lineage(spark, "SELECT max(o_totalprice) AS m FROM orders").witness_counts().select("n_0")


@register("lineage_multihop", "SELECT n_name, count(*) AS n_0, count(DISTINCT c_custkey) AS n_1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark):
    q = "SELECT n_name, sum(s) AS t FROM (SELECT c_nationkey, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) x JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    return Lineage(spark, q).witness_counts().select("n_name", "n_0", "n_1")


@register("lineage_intersect", "SELECT DISTINCT event_id FROM events WHERE user_id = 14")
def _(spark):
    return Lineage(spark, "SELECT user_id AS k FROM events INTERSECT SELECT o_custkey FROM orders").backward("k = 14", "events").select("event_id")


@register("lineage_edges", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark):
    return Lineage(spark, "SELECT o_orderstatus, sum(o_totalprice) AS t FROM orders GROUP BY o_orderstatus").edges().groupBy("o_orderstatus").agg(F.count("*").alias("n"))


for side, n_0, n_1 in (("LEFT", "1", "CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END"), ("RIGHT", "CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END", "1"), ("FULL", "CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END", "CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END")):
    OUTER = f"FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c {side} JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey"

    @register(f"lineage_outer_{side.lower()}", f"SELECT c_custkey, o_orderkey, CAST({n_0} AS BIGINT) AS n_0, CAST({n_1} AS BIGINT) AS n_1 {OUTER}")
    def _(spark, q=f"SELECT c_custkey, o_orderkey {OUTER}"):
        return Lineage(spark, q).witness_counts()


for name, grouping in (("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):

    @register(f"lineage_{name}", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n_0 FROM orders GROUP BY {grouping}")
    def _(spark, q=f"SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS t FROM orders GROUP BY {grouping}"):
        return Lineage(spark, q).witness_counts().drop("t")


@register("lineage_count_distinct", "SELECT o_orderstatus, count(*) AS n_0 FROM orders GROUP BY o_orderstatus")
def _(spark):
    return Lineage(spark, "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus").witness_counts().drop("n")


@register("lineage_having", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)")
def _(spark):
    return Lineage(spark, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12").backward("true").select(*ORDER_COLUMNS)


@register("lineage_union_distinct", "SELECT o_orderkey FROM orders WHERE o_custkey = 14")
def _(spark):
    return Lineage(spark, "SELECT user_id AS k FROM events UNION SELECT o_custkey FROM orders").backward("k = 14", "orders").select("o_orderkey")


@register("lineage_except", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def _(spark):
    return Lineage(spark, "SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events WHERE event_type = 'click'").backward("true", "orders").select("o_orderkey")


@register("lineage_cte_twice", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, b.k AS other, a.n AS n_0, b.n AS n_1 FROM t a JOIN t b ON a.k = b.k + 1")
def _(spark):
    return Lineage(spark, "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT a.k, b.k AS other FROM t a JOIN t b ON a.k = b.k + 1").witness_counts()


@register("lineage_scalar_subquery", "SELECT o_orderkey, CAST(1 AS BIGINT) AS n_0, (SELECT count(*) FROM orders) AS n_1 FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def _(spark):
    return Lineage(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)").witness_counts()


@register("lineage_correlated_scalar", "SELECT o_orderkey, CAST(1 AS BIGINT) AS n_0, (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey) AS n_1 FROM orders a WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)")
def _(spark):
    return Lineage(spark, "SELECT o_orderkey FROM orders a WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)").witness_counts()


@register("lineage_exists_or", "SELECT c_custkey, CAST(1 AS BIGINT) AS n_0, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS n_1 FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(spark):
    return Lineage(spark, "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)").witness_counts()


@register("lineage_drop_duplicates", "SELECT o_custkey, count(*) AS n_0 FROM orders GROUP BY o_custkey")
def _(spark):
    return Lineage(spark, spark.table("orders").dropDuplicates(["o_custkey"])).witness_counts().select("o_custkey", "n_0")


@register("lineage_theta", "SELECT r_name, n_name, CAST(1 AS BIGINT) AS n_0, CAST(1 AS BIGINT) AS n_1 FROM region JOIN nation ON r_regionkey < n_regionkey")
def _(spark):
    return Lineage(spark, "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey").witness_counts()


@register("lineage_self_join", "SELECT DISTINCT b.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_totalprice > 490000")
def _(spark):
    q = "SELECT a.o_orderkey, a.o_totalprice AS p FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"
    return Lineage(spark, q).backward("p > 490000", "b").select("o_orderkey")


@register("lineage_python_udf", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def _(spark):
    big = F.udf(lambda x: x is not None and x > 400000, "boolean")
    out = spark.table("orders").where(big("o_totalprice")).groupBy("o_orderstatus").count()
    return Lineage(spark, out).backward("o_orderstatus = 'F'").select("o_orderkey")


@register("lineage_window_of_aggregate", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def _(spark):
    q = "SELECT c_nationkey, c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY t) AS r FROM (SELECT c_nationkey, c_mktsegment, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_mktsegment)"
    return Lineage(spark, q).backward("c_nationkey = 3 AND r = 1", "orders").agg(F.count("*").alias("n"))


@register("trace_rows", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE'")
def _(spark):
    lin = Lineage(spark, SEGMENTS)
    chosen = [t.id for t in lin.collect() if t.row.c_mktsegment == "FURNITURE"]
    return lin.trace(chosen).go_back().go_back(0).show().select("o_orderkey")


@register("trace_back_and_next", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(spark):
    lin = Lineage(spark, SEGMENTS)
    cursor = lin.trace([t.id for t in lin.collect()]).go_back(0).go_back(1).go_next().go_next()
    return cursor.show().select("c_mktsegment", "n")


def _recall_sql() -> str:
    """What complete lineage gives: all selected rows come back."""
    parts = [f"SELECT '{name}' AS query, count(*) AS wanted, count(*) AS found FROM ({q}) q WHERE {where}" for name, q, where in recall.CORPUS]
    return " UNION ALL ".join(parts).replace("explode(split(text, ' '))", "unnest(string_split(text, ' '))")


@register("lineage_recall", _recall_sql())
def _(spark):
    found = [(name, *recall.recall(spark, q, where)) for name, q, where in recall.CORPUS]
    return spark.createDataFrame(found, "query string, wanted long, found long")


# ---------------------------------------------------------------- decomposition and rerun

CASES = "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS s FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 500"


@register("steps_row_counts", "SELECT 0 AS step, 'Relation' AS operator, count(*) AS n FROM orders UNION ALL SELECT 1, 'Relation', count(*) FROM customer UNION ALL SELECT 2, 'Join', count(*) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 3, 'Aggregate', count(DISTINCT c_mktsegment) FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark):
    return spark.createDataFrame(steps.counts(spark, SEGMENTS), "step int, operator string, n long")


@register("branch_row_counts", "SELECT 'yes' AS side, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 500 UNION ALL SELECT 'no', count(*) FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey < 500)")
def _(spark):
    found = [b for s in steps.decompose(spark, CASES) if s.operator == "Filter" for b in s.branches]
    return spark.createDataFrame([("no" if b.negated else "yes", b.data.count()) for b in found], "side string, n long")


@register("branch_case_arms", "SELECT 1 AS arm, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 500 AND o_totalprice > 250000 UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 500 AND o_totalprice > 100000")
def _(spark):
    found = [b for s in steps.decompose(spark, CASES) if s.operator == "Project" for b in s.branches]
    return spark.createDataFrame([(i + 1, b.data.count()) for i, b in enumerate(found)], "arm int, n long")


@register("branch_conjuncts", "SELECT 3 AS n")
def _(spark):
    e = next(b.expression for s in steps.decompose(spark, CASES) if s.operator == "Filter" for b in s.branches)
    return spark.createDataFrame([(len(steps.conjuncts(e)),)], "n int")


@register("rerun_substituted", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 GROUP BY c_mktsegment")
def _(spark):
    return rerun.with_data(spark, spark.sql(SEGMENTS), {"orders": spark.table("orders").where("o_totalprice > 300000")}).select("c_mktsegment", "n")


# ---------------------------------------------------------------- influence and oracles

SUMS = "SELECT o_orderstatus, {f} AS v FROM orders GROUP BY o_orderstatus"


def _influence(name: str, f: str, score: str) -> None:
    @register(f"influence_{name}", f"SELECT o_orderkey, round({score}, 9) AS score FROM (SELECT *, CASE WHEN o_totalprice = max(o_totalprice) OVER (PARTITION BY o_orderstatus) THEN 1 ELSE 0 END AS top, CASE WHEN o_totalprice = min(o_totalprice) OVER (PARTITION BY o_orderstatus) THEN 1 ELSE 0 END AS low FROM orders) t WHERE o_orderstatus = 'F'")
    def _(spark):
        return influence.influence(spark, SUMS.format(f=f), "o_orderstatus = 'F'").select("o_orderkey", F.round("score", 9).alias("score"))


_influence("sum", "sum(o_totalprice)", "abs(o_totalprice) / sum(abs(o_totalprice)) OVER (PARTITION BY o_orderstatus)")
_influence("avg", "avg(o_totalprice)", "abs(o_totalprice) / sum(abs(o_totalprice)) OVER (PARTITION BY o_orderstatus)")
_influence("count", "count(*)", "1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus)")
_influence("max", "max(o_totalprice)", "top::DOUBLE / sum(top) OVER (PARTITION BY o_orderstatus)")
_influence("min", "min(o_totalprice)", "low::DOUBLE / sum(low) OVER (PARTITION BY o_orderstatus)")
_influence("multi", "max(o_totalprice) + sum(o_totalprice)", "greatest(top::DOUBLE / sum(top) OVER (PARTITION BY o_orderstatus), abs(o_totalprice) / sum(abs(o_totalprice)) OVER (PARTITION BY o_orderstatus))")


@register("influence_having", "SELECT o_orderkey, round(greatest(abs(o_totalprice) / sum(abs(o_totalprice)) OVER (PARTITION BY o_custkey), 1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey)), 9) AS score FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)")
def _(spark):
    # The count of HAVING is an aggregate like the sum, so the greater share decides.
    q = "SELECT k, s * 2 AS y FROM (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 12) t"
    return influence.influence(spark, q, "y > 0").select("o_orderkey", F.round("score", 9).alias("score"))


@register("influence_top", "SELECT o_orderkey, round(abs(o_totalprice) / (SELECT sum(abs(o_totalprice)) FROM orders WHERE o_orderstatus = 'F'), 9) AS score FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC LIMIT 10")
def _(spark):
    return influence.most_influential(spark, SUMS.format(f="sum(o_totalprice)"), "o_orderstatus = 'F'", 10).select("o_orderkey", F.round("score", 9).alias("score"))


@register("oracle_max", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders)")
def _(spark):
    o = spark.table("orders")
    return o.where(oracles.at_least_max(o, "o_totalprice")).select("o_orderkey")


@register("oracle_min", "SELECT o_orderkey FROM orders WHERE o_totalprice <= (SELECT min(o_totalprice) FROM orders)")
def _(spark):
    o = spark.table("orders")
    return o.where(oracles.at_most_min(o, "o_totalprice")).select("o_orderkey")


@register("oracle_ksigma", "WITH s AS (SELECT stddev_pop(value) AS s, list_sort(list(value))[least(floor(0.5 * count(*))::BIGINT, count(*) - 1) + 1] AS m FROM events) SELECT event_id FROM events, s WHERE value < m - 1.2 * s.s OR value > m + 1.2 * s.s")
def _(spark):
    e = spark.table("events")
    return e.where(oracles.beyond_sigmas(e, "value", 1.2)).select("event_id")


@register("oracle_nan_null", "SELECT event_id FROM events WHERE event_type = 'error'")
def _(spark):
    e = spark.table("events").withColumn("v", F.expr("if(event_type = 'error', null, value)"))
    return e.where(oracles.nan_or_null("v")).select("event_id")


@register("oracle_differential", "SELECT o_orderkey FROM orders WHERE o_totalprice > 490000")
def _(spark):
    wrong = spark.sql("SELECT o_orderkey, if(o_totalprice > 490000, -o_totalprice, o_totalprice) AS p FROM orders")
    return oracles.differential(wrong, spark.sql("SELECT o_orderkey, o_totalprice AS p FROM orders")).select("o_orderkey")


# ---------------------------------------------------------------- isolation, spectra, debugging

NEGATED = "SELECT c_mktsegment, sum(CASE WHEN o_totalprice > 499000 THEN -o_totalprice * 1000000 ELSE o_totalprice END) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


@register("isolate_ddmin", "SELECT o_orderkey FROM orders WHERE o_orderkey = 77")
def _(spark):
    q = "SELECT o_orderpriority, sum(CASE WHEN o_orderkey = 77 THEN -1000000000000 ELSE o_totalprice END) AS t FROM orders GROUP BY o_orderpriority"
    found = isolation.isolate(spark, q, "orders", "t < 0")
    return isolation.culprits(spark, found, spark.table("orders").schema).select("o_orderkey")


@register("isolate_by_function", "SELECT o_orderkey FROM orders WHERE o_orderkey = 77")
def _(spark):
    q = "SELECT o_orderpriority, max(CASE WHEN o_orderkey = 77 THEN 1000000000000 ELSE o_totalprice END) AS m FROM orders GROUP BY o_orderpriority"
    found = isolation.isolate(spark, q, "orders", lambda row: row.m > 1_000_000_000)
    return isolation.culprits(spark, found, spark.table("orders").schema).select("o_orderkey")


@register("spectrum_tarantula", "SELECT 1.0::DOUBLE AS score, count(*) AS failing FROM orders WHERE o_totalprice > 499000")
def _(spark):
    top = spectrum.localize(spark, NEGATED, "t < 0")[0]
    return spark.createDataFrame([(top.score, top.failing)], "score double, failing long")


@register("spectrum_ochiai", "WITH m AS (SELECT c_mktsegment AS s, bool_or(o_totalprice > 499000) AS bad FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), f AS (SELECT count(*) AS f FROM orders JOIN customer ON o_custkey = c_custkey JOIN m ON s = c_mktsegment WHERE bad) SELECT round(count(*) / sqrt(any_value(f.f) * count(*)), 9) AS score FROM orders, f WHERE o_totalprice > 499000")
def _(spark):
    top = next(s for s in spectrum.localize(spark, NEGATED, "t < 0", "ochiai") if s.branch)
    return spark.createDataFrame([(round(top.score, 9),)], "score double")


@register("watch_hits", "SELECT count(*) AS hits FROM orders WHERE o_totalprice > 450000")
def _(spark):
    return spark.createDataFrame([(debug.Watchpoint(spark.table("orders"), "o_totalprice > 450000").hits,)], "hits long")


@register("watch_captured", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 495000")
def _(spark):
    return debug.Watchpoint(spark.table("orders"), "o_totalprice > 495000", 100_000).captured.select("o_orderkey", "o_totalprice")


@register("breakpoint_state", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def _(spark):
    return debug.Breakpoint(spark.table("customer").where("c_acctbal > 0")).resume_with(lambda d: d.groupBy("c_mktsegment").agg(F.count("*").alias("n")))


@register("crash_culprit", "SELECT o_orderkey FROM orders WHERE o_orderkey = 777")
def _(spark):
    found = debug.crash_culprit(spark.table("orders"), lambda d: d.select(F.expr("1 div (o_orderkey - 777)").alias("x")))
    return spark.createDataFrame([(found.row.o_orderkey,)], "o_orderkey long")


@register("profile_latency")
def _(spark):
    return debug.Profile(spark.table("documents"), "sha2(upper(text), 512)").slowest().select("doc_id", "nanos")


@register("blame")
def _(spark):
    lin = Lineage(spark, "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
    return debug.blame(lin, "lang = 'de'", debug.Profile(lin.source(0).rows, "sha2(upper(text), 512)").counted).select("doc_id", "nanos")


@register("incremental_answer", "SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 460000")
def _(spark):
    inc = Incremental(spark)
    q = "SELECT c_name, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > {}) o JOIN customer ON o_custkey = c_custkey"
    inc.run(q.format(450000))
    return inc.run(q.format(460000)).df


@register("fuzz_path_vectors", "SELECT concat(CASE WHEN o_totalprice > 250000 THEN '1' ELSE '0' END, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END) AS path, count(*) AS n FROM orders GROUP BY 1")
def _(spark):
    return pathtests.path_vectors(spark.table("orders"), ["o_totalprice > 250000", "o_orderstatus = 'F'"]).groupBy("path").agg(F.count("*").alias("n"))


@register("fuzz_minimised_sizes", "SELECT path, least(3, count(*)) AS n FROM (SELECT concat(CASE WHEN o_totalprice > 250000 THEN '1' ELSE '0' END, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END) AS path FROM orders) t GROUP BY path")
def _(spark):
    return pathtests.minimised(spark.table("orders"), ["o_totalprice > 250000", "o_orderstatus = 'F'"]).groupBy("path").agg(F.count("*").alias("n"))


@register("fuzz_join_constraints")
def _(spark):
    return spark.createDataFrame(pathtests.join_constraints(spark, SEGMENTS), "a string, b string")


@register("fuzz_coverage")
def _(spark):
    r = pathtests.fuzz(spark, CASES, {"orders": spark.table("orders")}, iterations=8, seed=1)
    return spark.createDataFrame([(r.iterations, r.jobs, r.branches, r.coverage)], "iterations int, jobs int, branches int, coverage double")


@register("fuzz_guided", "SELECT 4 AS branches, 1.0::DOUBLE AS coverage")
def _(spark):
    r = pathtests.fuzz(spark, CASES, {"orders": spark.table("orders")}, iterations=24, strategy="guided", seed=1)
    return spark.createDataFrame([(r.branches, r.coverage)], "branches int, coverage double")


@register("testgen_solutions")
def _(spark):
    seeds = {"orders": spark.table("orders")}
    cases = pathtests.generate_tests(spark, CASES, seeds)
    return spark.createDataFrame([("".join("1" if m else "0" for m in c.mask), c.note, pathtests.verify(spark, CASES, seeds, c)) for c in cases], "path string, note string, verdict string")


def grade(price):
    if price is None:
        return "none"
    if price > 400000:
        return "high"
    return "mid" if price > 100000 else "low"


@register("testgen_through_udf", "SELECT path, 'verified' AS verdict FROM (VALUES ('high'), ('not high')) t(path)")
def _(spark):
    """Inputs for either side of a comparison with a Python UDF's result, read from its source."""
    spark.udf.register("grade", grade, "string")
    seeds, q = {"orders": spark.table("orders")}, "SELECT o_orderkey FROM orders WHERE grade(o_totalprice) = 'high'"
    known = {"grade": udf_reader.analyze(grade)}
    cases = pathtests.generate_tests(spark, q, seeds, max_paths=1, udfs=known)
    sides = [(c, "high" if c.mask[0] else "not high") for c in cases if c.mask[0] is not None]
    return spark.createDataFrame([(side, pathtests.verify(spark, q, seeds, c, known)) for c, side in sides], "path string, verdict string")


# ---------------------------------------------------------------- records


def _words(spark):
    lines = Records(spark.table("documents").select(F.col("text").alias("value")))
    return lines.flat_map(lambda v: F.split(v, " ")).filter(lambda v: v != "").map_pairs(lambda v: v, lambda v: F.lit(1))


@register("records_reduce_by_key", "SELECT w AS key, CAST(count(*) AS BIGINT) AS value FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t WHERE w <> '' GROUP BY w")
def _(spark):
    return _words(spark).reduce_by_key("sum").df


@register("records_join", "SELECT c_custkey AS key, c_name AS left_value, o_orderkey AS right_value FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(spark):
    names = Records(spark.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")))
    orders = Records(spark.table("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")))
    return names.join(orders, "left").df.select("key", F.col("value.left").alias("left_value"), F.col("value.right").alias("right_value"))


@register("records_cogroup", "SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k")
def _(spark):
    orders = Records(spark.table("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")))
    events = Records(spark.table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value")))
    return orders.cogroup(events).df.select("key", F.size("value.left").cast("long").alias("n_left"), F.size("value.right").cast("long").alias("n_right"))


@register("records_lineage", "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def _(spark):
    return _words(spark).reduce_by_key("sum").lineage().backward("key = 'the'").select("doc_id")


@register("revisions_changed", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000 AND o_totalprice <= 460000")
def _(spark):
    s = Session(spark)
    for least in (450000, 460000):
        s.revise(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {least}")
    return s.changed(1, 2)[0]


# ---------------------------------------------------------------- subject programs on the test data

same("subject_commute_type", "SELECT CASE WHEN o_totalprice / 1000 > 300 THEN 'car' WHEN o_totalprice / 1000 > 100 THEN 'public' ELSE 'onfoot' END AS type, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY 1")
same("subject_commute_full", "SELECT c_mktsegment, CASE WHEN o_totalprice > 300000 THEN 'car' ELSE 'onfoot' END AS type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1, 2")
same("subject_student_grade", "SELECT CASE WHEN p_size > 40 THEN 'A' WHEN p_size > 20 THEN 'B' ELSE 'C' END AS grade, count(*) AS n FROM part GROUP BY 1")
same("subject_movie_rating", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part WHERE p_size >= 10 GROUP BY p_brand")
same("subject_income", "SELECT CASE WHEN c_acctbal < 0 THEN 'a' WHEN c_acctbal < 3000 THEN 'b' WHEN c_acctbal < 6000 THEN 'c' ELSE 'd' END AS band, round(avg(c_acctbal), 2) AS a, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1")
same("subject_find_salary", "SELECT CAST(sum(CASE WHEN substring(o_orderpriority, 1, 1) = '$' THEN CAST(substring(o_orderpriority, 2, 1) AS INT) ELSE CAST(substring(o_orderpriority, 1, 1) AS INT) END) AS BIGINT) AS s FROM orders WHERE o_totalprice > 1000")
same("subject_word_count", "SELECT w AS word, count(*) AS n FROM (SELECT explode(split(lower(text), ' ')) AS w FROM documents) t WHERE length(w) > 3 GROUP BY w", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) t WHERE length(w) > 3 GROUP BY w")
same("subject_weather", "SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id")


def _planted(name: str, table: str, key: str, culprit: int, q: str, wrong: str) -> None:
    """A subject program with a fault in one row, which isolation must find."""

    @register(f"subject_{name}_isolated", f"SELECT {key} FROM {table} WHERE {key} = {culprit}")
    def _(spark):
        found = isolation.isolate(spark, q, table, wrong)
        return isolation.culprits(spark, found, spark.table(table).schema).select(key)


_planted("student_grade", "part", "p_partkey", 23, "SELECT CASE WHEN p_size > 40 THEN 'A' ELSE 'B' END AS grade, max(CASE WHEN p_partkey = 23 THEN 9999 ELSE p_size END) AS top FROM part GROUP BY 1", "top > 100")
_planted("movie_rating", "part", "p_partkey", 17, "SELECT p_brand, sum(CASE WHEN p_partkey = 17 THEN 100000 ELSE p_size END) AS total FROM part GROUP BY p_brand", "total > 99999")
_planted("weather", "events", "event_id", 41, "SELECT user_id, max(CASE WHEN event_id = 41 THEN 9999.0 ELSE value END) - min(value) AS spread FROM events WHERE value IS NOT NULL GROUP BY user_id", "spread > 5000")
