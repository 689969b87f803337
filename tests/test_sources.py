import pytest

from cohortia import sources
from cohortia.operators import joins, verbs
from cohortia.session import scratch_path


def test_unknown_extension_is_an_error(spark):
    with pytest.raises(ValueError):
        sources.read_table(spark, "/nowhere/table.xlsx", "a int")
    with pytest.raises(ValueError):
        sources.read_table(spark, "/nowhere/table.tsv")


def test_quotes_missing_and_bad_numbers(spark):
    df = spark.createDataFrame([('a "b", c', 1.5), (None, None)], "t string, v double")
    path = sources.write_csv(df, scratch_path(spark, "quotes"))
    back = {tuple(r) for r in sources.read_csv(spark, path, "t string, v double").collect()}
    assert back == {('a "b", c', 1.5), (None, None)}
    odd = spark.createDataFrame([("1,5",), ("x",)], "v string")
    path = sources.write_csv(odd, scratch_path(spark, "comma"), sep=";")
    got = sources.read_semicolon(spark, path, "v double", decimal_comma=True).collect()
    assert sorted([r.v for r in got], key=str) == [1.5, None]


class _Named:
    """A session whose cluster names a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return "hdfs://shared/checkpoints/" if key == "spark.checkpoint.dir" else default


def test_scratch_follows_the_session_setting(spark):
    assert scratch_path(_Named, "x").startswith("hdfs://shared/checkpoints/cohortia/x-")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(named.rstrip("/") + "/cohortia/x-")


def test_blank_delimited_goes_by_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("v\tname  id\n1.5 x 1\nNA y  2\n")
    assert [tuple(r) for r in sources.read_blanks(spark, str(tmp_path / "a.txt"), "id long, v double").collect()] == [(1, 1.5), (2, None)]
    with pytest.raises(ValueError):
        sources.read_blanks(spark, str(tmp_path / "a.txt"), "other long")
    with pytest.raises(Exception, match="bad v"):
        (tmp_path / "b.txt").write_text("id v\n1 x\n")
        sources.read_blanks(spark, str(tmp_path / "b.txt"), "id long, v double").collect()


def test_seed_results_refuse_another_header(spark, tmp_path):
    (tmp_path / "t" / "c" / "seed_1").mkdir(parents=True)
    (tmp_path / "t" / "c" / "seed_1" / "x.tsv").write_text("value\tevent_id\n7.0\t3\n")
    assert [tuple(r) for r in sources.read_seed_results(spark, str(tmp_path), "value double, event_id long").collect()] == [(7.0, 3, "t", "c", 1)]
    with pytest.raises(Exception):
        sources.read_seed_results(spark, str(tmp_path), "event_id long, value double").collect()


def test_level_pairs(spark):
    got = joins.level_pairs(spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string"), "k", ("x", "y"))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "a")]


def test_split_two_keeps_hyphens_with_a_declared_delimiter(spark):
    df = spark.createDataFrame([("HLA-A;Name;More",)], "m string")
    row = verbs.split_two(df, "m", ("a", "b"), ";").first()
    assert (row.a, row.b) == ("HLA-A", "Name")


def test_one_seed_of_many_lists_one_file(spark, tmp_path):
    for kind in ("importance", "roc"):
        for group in ("C1", "C2"):
            (tmp_path / kind / group).mkdir(parents=True)
            for seed in range(1, 26):
                (tmp_path / kind / group / f"seed_{seed}.tsv").write_text(f"a\tb\n{seed}\tx\n")
    (tmp_path / "importance" / "C1" / "seed=7").mkdir()
    (tmp_path / "importance" / "C1" / "seed=7" / "part-0.csv").write_text("a\tb\n70\tx\n")
    read = lambda **k: sources.read_seed_results(spark, str(tmp_path), "a long, b string", **k)
    assert len(read().inputFiles()) == 101
    one = read(types=["roc"], classes=["C2"], seeds=[2])
    assert len(one.inputFiles()) == 1 and [tuple(r) for r in one.collect()] == [(2, "x", "roc", "C2", 2)]
    some = read(types=["importance"], classes=["C1"], seeds=[7, 25])
    assert sorted(r.a for r in some.collect()) == [7, 25, 70] and len(some.inputFiles()) == 3
