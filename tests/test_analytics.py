import time

from pyspark.sql import functions as F

from tidemark.functions import analytics as a
from tidemark.operators import sort


def test_lists_and_tables(spark, tmp_path):
    pairs = a.pair_lists(spark, file=["x", "y"], memory=[1, 2, 3]).orderBy("i").collect()
    assert [(r["file"], r["memory"]) for r in pairs] == [("x", 1), ("y", 2), (None, 3)]
    one = spark.createDataFrame([("b", 1.005), ("a", 2.0)], "d string, t double")
    two = spark.createDataFrame([("c", 1.0), ("a", None)], "d string, t double")
    names = a.dataset_union([one, two], "d")
    assert [r["d"] for r in names.collect()] == ["a", "b", "c"]
    assert a.has_dataset(names, two, "d").count() == 2
    assert a.show_table(one, ["t"]).filter("d = 'a'").first()["t"] == "2.00"
    path = str(tmp_path / "r.csv")
    a.append_results(one.coalesce(1), path)
    a.append_results(two.coalesce(1), path)
    back = a.read_results(spark, path, "d string, t double")
    assert back.count() == 4 and back.filter("t is null").count() == 1


def test_phases():
    p = a.Phases()
    with p.phase("sort"):
        time.sleep(0.01)
    with p.phase("sort"):
        pass
    assert 0.01 <= p.seconds["sort"] == p.total


def test_prefix_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("x")).repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sort.with_prefix(df, ["k"], sums={"run": "x"}).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total = 0
    for i, r in enumerate(got):
        total += r["x"]
        assert (r["k"], r["pos"], r["run"]) == (i, i + 1, total)
    assert sort.with_prefix(df.limit(0), ["k"], sums={"run": "x"}).count() == 0


def test_nulls_and_hot_keys(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (None, 3), (2, None)], "k int, x int")
    got = sort.with_position(df, ["k"]).orderBy("pos").collect()
    assert [(r["k"], r["x"]) for r in got] == [(None, 1), (None, 3), (2, None), (2, 2)]
    assert [r["x"] for r in sort.top_k(df, 2, ["x"], descending=["x"]).collect()] == [3, 2]
