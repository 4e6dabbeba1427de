"""Small exact cases of the engine's operators."""

import pytest
from pyspark.sql import functions as F

from qscope.functions import distributions, udf_reader
from qscope.operators import debug, influence, pathtests, recall, rerun, spectrum
from qscope.operators.incremental import Incremental
from qscope.operators.isolation import ddmin, isolate
from qscope.operators.lineage import Lineage
from qscope.operators.records import Records
from qscope.plans.adapter import UnsupportedOperator
from qscope.session import Session, Settings


@pytest.fixture
def sales(spark):
    rows = [("a", 1), ("a", 5), ("b", 7), ("b", None), ("c", 9)]
    df = spark.createDataFrame(rows, "k string, v int")
    df.createOrReplaceTempView("sales")
    return df


def counts(lin):
    n = len(lin.sources)
    return sorted((tuple(r) for r in lin.witness_counts().collect()), key=str), n


def test_lineage_of_null_groups_and_outer_rows(spark, sales):
    lin = Lineage(spark, "SELECT v, count(*) AS n FROM sales GROUP BY v")
    assert [tuple(r) for r in lin.backward("v IS NULL").collect()] == [("b", None)]
    q = "SELECT k, n FROM (SELECT k, count(*) AS n FROM sales WHERE v > 4 GROUP BY k) x UNION ALL SELECT CAST(NULL AS STRING), v FROM sales WHERE k = 'c'"
    assert counts(Lineage(spark, q))[0] == [("a", 1, 1, 0), ("b", 1, 1, 0), ("c", 1, 1, 0), (None, 9, 0, 1)]


def test_sources_keep_their_aliases_and_ambiguity_is_refused(spark, sales):
    sales.select("k", (sales.v + 1).alias("w")).createOrReplaceTempView("shifted")
    lin = Lineage(spark, "SELECT a.k, b.w FROM shifted a JOIN shifted b ON a.k = b.k AND a.w < b.w")
    assert [s.name for s in lin.sources] == ["a", "b"]
    assert [r.v for r in lin.backward("true", "b").collect()] == [5]
    with pytest.raises(KeyError, match="several sources"):
        lin.source("shifted")


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_lineage_of_file_formats(spark, tmp_path, fmt):
    from qscope.sources.io import read, with_row_id

    path = str(tmp_path / f"t.{fmt}")
    rows = [("a", 1), ("a", 5), ("b", 7), ("b", None), ("c", 9)] * 3
    out = spark.createDataFrame(rows, "k string, v int").repartition(3).write
    (out.option("header", True) if fmt == "csv" else out).format(fmt).save(path)
    read(spark, path).createOrReplaceTempView("stored")
    lin = Lineage(spark, "SELECT k, sum(v) AS s FROM stored GROUP BY k")
    assert sorted(r.v or 0 for r in lin.backward("k = 'b'").collect()) == [0, 0, 0, 7, 7, 7]
    assert sorted(r.k for r in lin.forward("v = 9").collect()) == ["c"]
    ids = with_row_id(read(spark, path)).select("rid").distinct()
    assert ids.count() == 15
    edges = lin.edges()
    assert edges.count() == 15 and edges.join(ids, "rid", "left_semi").count() == 15


def test_lineage_of_nothing_and_of_cached_rows(spark, sales):
    none = sales.where("false")
    assert Lineage(spark, none.groupBy("k").count()).witness_counts().collect() == []
    assert [tuple(r) for r in Lineage(spark, none.groupBy().count()).witness_counts().collect()] == [(0, 0)]
    kept = sales.where("v > 4").cache()
    assert counts(Lineage(spark, kept.groupBy("k").count()))[0] == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]


def test_refused_shapes(spark, sales):
    made = sales.mapInPandas(lambda parts: parts, sales.schema)
    with pytest.raises(UnsupportedOperator, match="MapInPandas"):
        Lineage(spark, made)


def test_cursor_goes_back_and_next(spark, sales):
    lin = Lineage(spark, "SELECT k, count(*) AS n FROM (SELECT k, v, rank() OVER (PARTITION BY k ORDER BY v) AS r FROM sales) t WHERE r = 1 GROUP BY k")
    found = lin.collect()
    cursor = lin.trace([t.id for t in found if t.row.k == "a"])
    assert cursor.place == "output" and cursor.branches == ["Aggregate"]
    assert cursor.go_back().branches == ["Window"]
    assert [tuple(r) for r in cursor.show().collect()] == [("a", 1, 1)]
    assert cursor.show(full=True).columns != cursor.show().columns
    assert sorted(r.v for r in cursor.go_back().go_back().show().collect()) == [1, 5]
    with pytest.raises(ValueError, match="source rows"):
        cursor.go_back()
    assert cursor.go_next().go_next().place == "Aggregate"
    assert [r.n for r in cursor.go_next().show().collect()] == [1]
    with pytest.raises(ValueError, match="at the output"):
        cursor.go_next()


def test_influence_knows_filters_above_the_aggregate(spark, sales):
    q = "SELECT k, x * 2 AS y FROM (SELECT k, sum(v) AS x FROM sales GROUP BY k HAVING count(*) > 1) t"
    got = influence.influence(spark, q, "y > 0")
    assert sorted(r.k for r in got.collect()) == ["a", "a", "b", "b"]
    assert influence.most_influential(spark, "SELECT sum(v) AS s FROM sales", "s > 0", 1).first().v == 9
    assert influence.as_json(got).first().json.startswith('{"row":{"k":')


def test_influence_of_null_groups_ties_and_filters(spark):
    spark.createDataFrame([(None, 4), (None, 4), (None, 1), ("x", 0), ("x", 0)], "k string, v int").createOrReplaceTempView("tied")
    got = {(r.k, r.v): r.score for r in influence.influence(spark, "SELECT k, max(v) AS m FROM tied GROUP BY k", "m > 0").collect()}
    assert got == {(None, 4): 0.5, (None, 1): 0.0}
    got = [r.score for r in influence.influence(spark, "SELECT k, sum(v) AS s FROM tied GROUP BY k", "k = 'x'").collect()]
    assert got == [0.5, 0.5]
    got = sorted(r.score for r in influence.influence(spark, "SELECT count(*) FILTER (WHERE v > 1) AS n FROM tied", "n = 2").collect())
    assert got == [0.0, 0.0, 0.0, 0.5, 0.5]


def test_blame_tells_equal_and_null_rows_apart(spark, sales):
    lin = Lineage(spark, "SELECT k, count(*) AS n FROM sales GROUP BY k")
    costs = lin.source(0).rows.selectExpr("*", "coalesce(v, 100) AS nanos")
    assert [r.v for r in debug.blame(lin, "k = 'b'", costs).collect()] == [None, 7]
    with pytest.raises(ValueError, match="rid"):
        debug.blame(lin, "k = 'b'", sales)


def test_crash_culprit_by_partition_and_place(spark):
    rows = spark.range(0, 40, 1, 5)
    found = debug.crash_culprit(rows, lambda d: d.selectExpr("1 div ((id - 21) * (id - 33)) AS x"))
    assert (found.row.id, found.partition, found.index) == (21, 2, 5)
    assert debug.crash_culprit(rows, lambda d: d) is None


def test_isolation_narrows_many_rows_where_they_are(spark):
    spark.range(3000).selectExpr("id", "id % 2 AS g").createOrReplaceTempView("many")
    q = "SELECT g, sum(CASE WHEN id IN (77, 1301) THEN 1 ELSE 0 END) AS s FROM many GROUP BY g"
    found = isolate(spark, q, "many", "s > 1")
    assert sorted(r[0] for r in found.rows) == [77, 1301] and found.provenance == 1500
    assert found.outputs.count() == 1
    found = isolate(spark, q, "many", lambda row: row.s > 1)
    assert sorted(r[0] for r in found.rows) == [77, 1301]


def test_localize_narrowed(spark, sales):
    q = "SELECT k, sum(CASE WHEN v = 5 THEN -100 ELSE v END) AS s FROM sales GROUP BY k"
    wide, narrow = (spectrum.localize(spark, q, "s < 0", narrow=n)[0] for n in (False, True))
    assert (wide.failing, narrow.failing) == (1, 1) and narrow.branch and narrow.score == 1.0


def test_stored_sub_plans_know_their_files(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for path, n in ((one, 3), (two, 5)):
        spark.range(n).write.parquet(path)
    inc, q = Incremental(spark), "SELECT count(*) AS n FROM (SELECT id FROM parquet.`{}` WHERE id >= 0) t"
    try:
        assert inc.run(q.format(one)).df.first().n == 3
        assert inc.run(q.format(one)).reused
        other = inc.run(q.format(two))
        assert other.df.first().n == 5 and not other.reused
        spark.range(7).write.mode("overwrite").parquet(one)
        again = inc.run(q.format(one))
        assert again.df.first().n == 7 and not again.reused
    finally:
        inc.clear()


def test_records_and_their_lineage(spark):
    lines = Records.of(spark, ["a b a", "b c", "a"], "string")
    words = lines.flat_map(lambda v: F.split(v, " ")).map_pairs(lambda v: v, lambda v: F.lit(1))
    counts = words.reduce_by_key("sum")
    assert sorted(counts.collect()) == [("a", 3), ("b", 2), ("c", 1)]
    assert sorted(words.reduce_by_key(lambda x, y: x + y).collect()) == sorted(counts.collect())
    behind = counts.lineage().backward("key = 'b'")
    assert sorted(r.value for r in behind.collect()) == ["a b a", "b c"]
    names = Records.of(spark, [("a", "x"), ("d", "y")], "key string, value string")
    assert sorted(counts.join(names).collect()) == [("a", (3, "x"))]
    assert sorted(k for k, _ in counts.join(names, "full").collect()) == ["a", "b", "c", "d"]
    assert dict(counts.cogroup(names).collect())["d"] == ([], ["y"])
    assert [r.value for r in counts.join(names).lineage().backward("key = 'a'", 1).collect()] == ["x"]
    assert sorted(words.keys().distinct().collect()) == ["a", "b", "c"]
    assert words.count_by_key().sort_by_key(False).take(1) == [("c", 1)]
    assert sorted(words.values().map(lambda v: v + 1).union(words.values()).filter(lambda v: v > 1).collect()) == [2] * 6
    assert sorted(names.map_values(F.upper).top_by_key(1).collect()) == [("a", "X"), ("d", "Y")]
    with pytest.raises(ValueError, match="key_by"):
        lines.reduce_by_key("sum")


def test_records_of_files(spark, tmp_path):
    path = str(tmp_path / "lines")
    Records.of(spark, [("k", 1), ("m", 2)], "key string, value int").save_text(path)
    back = Records.text(spark, path)
    assert sorted(back.collect()) == ["k\t1", "m\t2"]
    kept = back.key_by(lambda v: F.substring(v, 1, 1)).count_by_key()
    assert [r.value for r in kept.lineage().backward("key = 'm'").collect()] == ["m\t2"]


def test_session(spark, sales):
    s = Session(spark, Settings(capacity=2))
    q = "SELECT k, sum(v) AS t FROM sales WHERE v > 0 GROUP BY k"
    assert s.sources(q) == ["sales"] and [x.operator for x in s.steps(q)][-1] == "Aggregate"
    watch = s.watch(q, "v > 4", step=1)
    assert watch.hits == 3 and watch.truncated and watch.captured.count() == 2
    assert s.breakpoint(q, 0).count() == 5 and s.recall(q) == (3, 3)
    costs = s.costs(q)
    assert any("Aggregate" in c.operator for c in costs) and any(c.metrics.get("numOutputRows") == 3 for c in costs)
    assert s.influence(q, "t > 0", top=1).count() == 1
    s.udf("sized_again", sized, "string")
    case = next(c for c in s.tests("SELECT k FROM sales WHERE sized_again(v) = 'big'", {"sales": sales}) if c.rows and c.mask[0])
    assert s.verify("SELECT k FROM sales WHERE sized_again(v) = 'big'", {"sales": sales}, case) in ("verified", "path not reached")
    s.revise(q)
    s.revise(q.replace("> 0", "> 4"))
    assert [v.number for v in s.between(1, 2)] == [1, 2]
    gone, come = s.changed(1, 2)
    assert [r.k for r in gone.collect()] == ["a"] and [(r.k, r.t) for r in come.collect()] == [("a", 5)]
    with pytest.raises(ValueError, match="there are 2"):
        s.between(1, 3)
    s.close()


def test_ddmin_pair():
    assert ddmin(list(range(20)), lambda s: 3 in s and 17 in s) == [3, 17]


def test_ddmin_passing_input_unchanged():
    assert ddmin([1, 2], lambda s: False) == [1, 2]


def test_formulas():
    assert spectrum.tarantula(2, 0, 2, 5) == 1.0
    assert spectrum.tarantula(0, 0, 0, 0) == 0.0
    assert spectrum.ochiai(1, 3, 4, 9) == 0.25


def test_recall_of_witnesses(spark, sales):
    q = "SELECT k, sum(v) AS s FROM sales GROUP BY k"
    some = Lineage(spark, q).backward("k = 'a'")
    again = rerun.with_data(spark, spark.sql(q), {"sales": some}).collect()
    assert [tuple(r) for r in again] == [("a", 6)]


def test_recall_where_sums_are_rounded(spark, tmp_path):
    path = str(tmp_path / "paid")
    spark.range(200_000).selectExpr("id % 5 AS g", "id % 7 AS k", "1e10 + id * 1.1D AS v").repartition(7).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("paid")
    spark.range(7).selectExpr("id AS j").createOrReplaceTempView("kinds")
    assert recall.recall(spark, "SELECT g, sum(v) AS t, avg(v) AS a FROM paid JOIN kinds ON k = j GROUP BY g", "g < 4") == (4, 4)


def test_rows_lost_among_near_doubles(spark):
    def frame(*rows):
        return spark.createDataFrame(list(rows), "k string, x double, y double")

    inf, nan = float("inf"), float("nan")
    big = 7.5e11
    assert recall.lost(frame(("a", big, 1.0)), frame(("a", big + 1e-3, 1.0), ("b", big, 1.0))) == 0
    assert recall.lost(frame(("a", big, 1.0)), frame(("a", big + 1e5, 1.0))) == 1
    assert recall.lost(frame(("a", big, 1.0)), frame(("a", big, 1.001), ("b", big, 1.0))) == 1
    assert recall.lost(frame(("a", big, 1.0), ("a", big + 1e-3, 1.0)), frame(("a", big + 2e-3, 1.0))) == 1
    odd = [(None, None, nan), ("a", inf, None), ("a", -inf, 0.0), ("a", 1e40, -0.0)]
    assert recall.lost(frame(*odd), frame(*odd)) == 0
    assert recall.lost(frame(*odd), frame(("a", 5.0, nan), ("a", nan, None), ("a", -1e300, 0.0), (None, 1e40, 0.0))) == 4
    assert recall.lost(frame(), frame(*odd)) == 0


def test_bare_limit_refused_when_strict(spark, sales):
    with pytest.raises(UnsupportedOperator):
        Lineage(spark, "SELECT * FROM sales LIMIT 2")
    assert Lineage(spark, "SELECT * FROM sales LIMIT 2", strict=False).annotated.count() == 2


def test_views_come_back(spark, sales):
    with rerun.views(spark, {"sales": sales.limit(1)}):
        assert spark.table("sales").count() == 1
    assert spark.table("sales").count() == 5


def grade(score):
    if score is None:
        return "none"
    if score >= 90:
        return "A"
    return "B" if score >= 50 else "C"


def test_udf_reader():
    p = udf_reader.analyze(grade)
    assert p.branches == ["(score IS NULL)", "(score >= 90)", "(score >= 50)"]
    assert len(p.paths) == 4 and p.influence == ["score"] and p.solvable


def opaque(x):
    x = x % 3
    return 1 if x == 0 else 2


def test_udf_reader_marks_reassigned_parameter_opaque():
    assert not udf_reader.analyze(opaque).solvable


def test_distributions():
    import random

    d = distributions.parse("c", "uniform(0, 1)")
    assert [d.draw(random.Random(1)) for _ in range(2)] == [d.draw(random.Random(1)) for _ in range(2)]
    assert distributions.parse("c", "['a, b', 2]").values == ("a, b", 2)
    with pytest.raises(ValueError, match="column c"):
        distributions.parse("c", "normal(1)")


def test_a_table_behind_a_temporary_view_is_seen_again(spark):
    spark.sql("DROP TABLE IF EXISTS perm")
    spark.range(3).write.saveAsTable("perm")
    try:
        with rerun.views(spark, {"perm": spark.range(1)}):
            assert spark.table("perm").count() == 1
        assert spark.table("perm").count() == 3
        assert [t.isTemporary for t in spark.catalog.listTables() if t.name == "perm"] == [False]
    finally:
        spark.sql("DROP TABLE perm")


def test_with_data_reaches_subqueries(spark, sales):
    q = "SELECT k FROM sales WHERE v IN (SELECT max(w) FROM other) OR v = (SELECT min(w) FROM other)"
    spark.createDataFrame([(5,), (9,)], "w int").createOrReplaceTempView("other")
    again = rerun.with_data(spark, spark.sql(q), {"other": spark.createDataFrame([(7,)], "w int")})
    assert [r.k for r in again.collect()] == ["b"]


def test_a_path_that_no_row_takes_is_not_verified(spark, sales):
    q = "SELECT CASE WHEN v > 6 THEN 1 ELSE 0 END AS x FROM sales WHERE k = 'a'"
    cases = pathtests.generate_tests(spark, q, {"sales": sales})
    found = {c.mask: pathtests.verify(spark, q, {"sales": sales}, c) for c in cases}
    names = [c.sql for c in pathtests.branch_conditions(spark, q)]
    at, arm = (next(i for i, n in enumerate(names) if x in n) for x in ("'a'" if "'a'" in str(names) else "= a", "> 6"))
    assert all((v == "verified") == m[at] for m, v in found.items())
    assert "path not reached" in str(found) and arm != at
    assert 0 < pathtests.coverage(spark, q, {"sales": sales}, cases) < 1


def test_either_side_of_an_or_is_tried(spark, sales):
    q = "SELECT k FROM sales WHERE (v > 3 AND v < 2) OR k = 'b'"
    cases = pathtests.generate_tests(spark, q, {"sales": sales})
    assert {c.note for c in cases} == {"solved"}


def test_many_conditions_are_tried_alone(spark, sales):
    q = "SELECT k FROM sales WHERE " + " AND ".join(f"v <> {i + 20}" for i in range(6)) + " AND k = 'b'"
    cases = pathtests.generate_tests(spark, q, {"sales": sales}, max_paths=8)
    assert {m for c in cases for m in c.mask} == {True, False, None}
    assert len(cases) == 2 * len(cases[0].mask) and {pathtests.verify(spark, q, {"sales": sales}, c) for c in cases if c.rows} == {"verified"}


def test_declared_distributions_feed_generation(spark, sales):
    cases = pathtests.generate_tests(spark, "SELECT k FROM sales WHERE k = 'b'", {"sales": sales}, declared={"sales.v": "uniform(500, 600)"})
    assert all(500 <= r["v"] <= 600 for c in cases for r in c.rows["sales"])


def sized(score):
    if score is None:
        return "none"
    return "big" if score > 100 else "small"


def test_paths_through_a_udf(spark, sales):
    known = {"sized": udf_reader.analyze(sized)}
    assert udf_reader.solve_through(known["sized"], "'big'", True, {"score": "`v`"}) == ["(NOT (`v` IS NULL)) AND (`v` > 100)"]
    spark.udf.register("sized", sized, "string")
    q = "SELECT k FROM sales WHERE sized(v) = 'big'"
    conds = pathtests.branch_conditions(spark, q, known)
    assert len(conds) == 3  # the filter, and two inside the function
    cases = pathtests.generate_tests(spark, q, {"sales": sales}, udfs=known)
    good = [c for c in cases if pathtests.verify(spark, q, {"sales": sales}, c, known) == "verified"]
    assert {c.mask[0] for c in good} == {True, False}
    assert all(r["v"] > 100 for c in good if c.mask[0] for r in c.rows["sales"])


def test_methods_with_arguments_are_not_read():
    assert not udf_reader.analyze(stripped).solvable


def stripped(x):
    return 1 if x.strip("a") == "b" else 2


def test_guided_fuzzing_keeps_what_covers_more(spark, sales):
    q = "SELECT CASE WHEN v > 1000000 THEN 1 WHEN v < -1000000 THEN 2 ELSE 3 END AS x FROM sales WHERE k = 'b'"
    found = pathtests.fuzz(spark, q, {"sales": sales}, iterations=24, rows=4, strategy="guided", seed=2)
    assert found.coverage == 1.0 and found.corpus and found.jobs <= 6


def test_fuzzing_tells_failing_inputs_apart(spark, sales):
    q = "SELECT 1 div v AS x FROM sales WHERE v IS NOT NULL"
    found = pathtests.fuzz(spark, q, {"sales": sales}, iterations=6, rows=3, seed=3)
    assert len(found.failures) <= 6 and found.jobs >= 1


def test_generated_cases_verify(spark, sales):
    q = "SELECT k FROM sales WHERE v > 3 AND k = 'b'"
    seeds = {"sales": sales}
    cases = pathtests.generate_tests(spark, q, seeds)
    assert len(cases) == 4
    assert {pathtests.verify(spark, q, seeds, c) for c in cases} == {"verified"}


def test_pools_hold_values_of_all_rows(spark):
    df = spark.createDataFrame([(1,)] * 2000 + [(5000,), (None,)], "v int").coalesce(1)
    df.createOrReplaceTempView("late")
    cases = pathtests.generate_tests(spark, "SELECT v FROM late WHERE v > 2500", {"late": df})
    taken = next(c for c in cases if c.mask == (True,))
    assert {r["v"] for r in taken.rows["late"]} == {5000}
    assert pathtests.pools(df) == {"v": [1, 5000]}


def test_fuzz_is_seeded(spark, sales):
    q = "SELECT k, CASE WHEN v > 3 THEN 1 ELSE 0 END AS b FROM sales"
    a, b = (pathtests.fuzz(spark, q, {"sales": sales}, iterations=3, seed=5) for _ in range(2))
    assert (a.covered, a.failures, a.empty) == (b.covered, b.failures, b.empty)


def test_entry_without_training_data_operators(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith(("qscope.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("qscope.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "lineage_backward_agg" in entry.queries() and not any(k.startswith("op") and k[2].isdigit() for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
