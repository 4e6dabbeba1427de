from qscope.__main__ import main


def run(spark, tmp_path, *more):
    (tmp_path / "s.csv").write_text("k,v\na,1\na,5\nb,99\n")
    return main(["analyze", "--table", f"s={tmp_path}/s.csv", "--query", "SELECT k, sum(v) AS t FROM s WHERE v > 0 GROUP BY k", *more], spark)


def test_wrong_rows_are_traced(spark, tmp_path, capsys):
    assert run(spark, tmp_path, "--oracle", "t > 50", "--watch", "t > 5") == 1
    out = capsys.readouterr().out
    assert "behind wrong rows, in s" in out and "|b  |99 |" in out
    assert "0.500 step 1 Filter" in out and "watch: 2 rows" in out


def test_exit_codes(spark, tmp_path):
    assert run(spark, tmp_path, "--oracle", "t < 0") == 0
    assert run(spark, tmp_path, "--tool", "suspects") == 2
    assert run(spark, tmp_path, "--watch", "t > 0", "--step", "99") == 2
    assert run(spark, tmp_path, "--oracle", "nothing > 1") == 2
