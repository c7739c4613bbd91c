import os
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sort, verify
from tidemark.plans import chunking as c
from tidemark.shared import exists, scratch, shared_dir
from tidemark.sources import gen, ints, kvbin, parts


def keys(spark, path, **o):
    return sorted(r["sort_key"] for r in kvbin.read_records(spark, path, ["sort_key"], **o).collect())


def test_append_overwrite_and_strangers(spark, tmp_path):
    p = str(tmp_path / "kv")
    a, b = gen.gen_count(spark, 100, 16, seed=1), gen.gen_count(spark, 50, 16, seed=2)
    kvbin.write_records(a, p)
    open(f"{p}/notes.txt", "w").write("mine")
    kvbin.write_records(b, p, mode="append")
    both = sorted(r[0] for r in a.union(b).select("sort_key").collect())
    assert keys(spark, p) == both
    order = [r["sort_key"] for r in kvbin.read_records(spark, p).orderBy("file_id", "offset").collect()]
    assert order[:100] == [r[0] for r in a.select("sort_key").collect()]  # appended files stand behind
    kvbin.write_records(b, p)
    assert keys(spark, p) == sorted(r[0] for r in b.select("sort_key").collect())
    assert open(f"{p}/notes.txt").read() == "mine"
    left = [f for f in os.listdir(p) if f.endswith(".kv")]
    assert len(left) == len(parts.data_files(*parts.filesystem(p)))


class Dies(Exception):
    pass


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "kv")
    kvbin.write_records(gen.gen_count(spark, 30, 16, seed=1), p)
    before = keys(spark, p)
    root = p
    w = kvbin.KvWriter({"path": p}, True)
    name = f"part-000000-{w.job}-x.kv"
    open(f"{root}/{name}", "wb").write(struct.pack("<QI", 1, 8) + b"x" * 8)
    assert keys(spark, p) == before  # files of a job that never committed are not read

    def boom(*_):
        raise Dies

    done = parts.Written(0, name, 20, 1)
    monkeypatch.setattr(kvbin.KvWriter, "tidy", boom)
    with pytest.raises(Dies):
        w.commit([done])  # dies behind the manifest: the new state stands
    monkeypatch.undo()
    w.abort([done])
    assert len(keys(spark, p)) == 1
    os.truncate(f"{root}/{name}", 10)
    with pytest.raises(Exception, match="bytes were written"):
        keys(spark, p)


def test_stale_side_file(spark, tmp_path):
    p = str(tmp_path / "kv")
    kvbin.write_records(gen.gen_mode(spark, 400, "RANDOM", seed=3).coalesce(1), p, splitBytes=20_000)
    (name,) = [f for f in os.listdir(p) if f.endswith(".kv")]
    assert os.path.exists(f"{p}/{name}.idx") and len(keys(spark, p, splitBytes=20_000)) == 400
    size = os.path.getsize(f"{p}/{name}")
    record = struct.pack("<QI", 7, 8) + b"y" * 8
    with open(f"{p}/{name}", "wb") as f:
        f.write((record * (size // 20 + 1))[:size])
    with pytest.raises(Exception, match="another content"):
        keys(spark, p, splitBytes=20_000)


def test_walk_in_tasks_equals_records(spark, tmp_path):
    folder = tmp_path / "foreign"
    folder.mkdir()
    df = gen.gen_mode(spark, 600, "RANDOM", seed=4)
    for i in range(3):
        kvbin.write_records(df.filter(F.col("id") % 3 == i).coalesce(1), str(tmp_path / "w"), sideFiles="false")
        (name,) = [f for f in os.listdir(tmp_path / "w") if f.endswith(".kv")]
        os.rename(tmp_path / "w" / name, folder / f"f{i}.bin")
        os.remove(tmp_path / "w" / "_manifest-00000000") if i == 0 else [os.remove(tmp_path / "w" / f) for f in os.listdir(tmp_path / "w")]
    want = sorted(r[0] for r in df.select("sort_key").collect())
    read = kvbin.read_records(spark, str(folder), ["sort_key"], splitBytes=10_000)
    assert read.rdd.getNumPartitions() > 20 and sorted(r[0] for r in read.collect()) == want
    assert kvbin.index_files(spark, str(folder), splitBytes=10_000) == 3
    assert keys(spark, str(folder), splitBytes=10_000) == want
    one = spark.read.format("kvbin").options(path=str(folder), splitBytes=10_000).load()  # no helper: walked while planning
    assert one.count() == 600


def test_key_range_and_columns(spark, tmp_path):
    p = str(tmp_path / "kv")
    df = gen.gen_mode(spark, 500, "RANDOM", seed=5)
    kvbin.write_records(df, p)
    low, high = -(1 << 63) + 10**8, -(1 << 63) + 5 * 10**8
    want = df.filter(F.col("sort_key").between(low, high))
    got = kvbin.read_records(spark, p, minKey=low, maxKey=high)
    assert 0 < want.count() < 500 and verify.equal_bag(want.select("sort_key", "payload"), got.select("sort_key", "payload"))
    assert kvbin.read_records(spark, p, ["key"]).columns == ["key"]


def test_ints_round_trip(spark, tmp_path):
    p = str(tmp_path / "i")
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007 - 5000).alias("x")).repartition(3)
    ints.write_ints(df.orderBy("x"), p, "x")
    got = ints.read_ints(spark, p, splitBytes=4000)
    assert verify.verify_ints(spark, p, splitBytes=4000).rows == 10_000
    assert verify.equal_bag(df.select(F.col("x").cast("int").alias("value")), got.select("value"))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, "a", 2, 3), (1, 4, "b", 2, 3)], "g int, x int, __group string, __w int, surplus int")
    assert [(r["x"], r["rank"]) for r in sort.position_in_group(df, "g", ["x"]).orderBy("rank").collect()] == [(4, 1), (5, 2)]
    d = verify.bag_difference(df, df.filter("x = 5"))
    assert [(r["x"], r["surplus_"]) for r in d.collect()] == [(4, 1)] and not verify.equal_bag(df, df.filter("x = 5"))


def test_nan_across_partitions(spark):
    nan = float("nan")
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    assert not verify.verify_sorted(frame([nan, 1.0]), ["x"]).ok and verify.verify_sorted(frame([None, 1.0, nan, nan]), ["x"]).ok
    assert not verify.verify_sorted(frame([nan]).union(frame([1.0])), ["x"]).ok
    assert verify.verify_sorted(frame([1.0, nan]).union(frame([nan])), ["x"]).ok


def test_scratch(spark, tmp_path):
    with scratch(spark):
        p = shared_dir(spark, "x")
        spark.range(3).write.parquet(p)
        assert exists(spark, p)
    assert not exists(spark, p)


@pytest.mark.parametrize(("seed", "target"), [(1, 100), (2, 1000), (3, 20_000), (4, 3), (5, 10**9)])
def test_greedy_chunks(spark, seed, target):
    import random

    r = random.Random(seed)
    sizes = [r.randint(0, 60) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k bigint, size bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = c.greedy_chunks(df, ["k"], "size", target).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = c.pack_bytes(sizes, target)
    assert [x["chunk_id"] for x in got] == [i + 1 for i, w in enumerate(want) for _ in range(w.records)]
    assert c.greedy_chunks(df.limit(0), ["k"], "size", target).count() == 0


def test_many_chunks_in_a_partition(spark):
    """Rows look their chunk up; no row carries, or goes through, all the chunks of its partition."""
    sizes = spark.range(0, 60_000, 1, 1).select("id", (F.col("id") % 7 + 1).alias("size"), F.lit(None).cast("string").alias("__file"))
    out = c.greedy_chunks(sizes, ["id"], "size", 8, [])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "array<bigint>" not in plan
    got = out.orderBy("id").collect()
    want = c.pack_bytes([i % 7 + 1 for i in range(60_000)], 8)
    assert out.columns == ["id", "size", "__file", "chunk_id"] and len(want) > 20_000
    assert [x["chunk_id"] for x in got] == [i + 1 for i, w in enumerate(want) for _ in range(w.records)]


def test_plan_is_made_of_whole_records(spark):
    sizes = spark.range(5000).select("id", (F.col("id") % 977 + 20).alias("size"))
    plan = c.plan_chunks(sizes, ["id"], "size", c.Config(memory=1 << 20, threads=4, min_chunk=1 << 16, max_chunk=1 << 19))
    starts, at = {0}, 0
    for i in range(5000):
        at += i % 977 + 20
        starts.add(at)
    assert all(x.start in starts for x in plan.chunks) and sum(x.records for x in plan.chunks) == 5000 and sum(x.length for x in plan.chunks) == at


def test_shuffles_dropped(spark):
    from tidemark.shared import shuffles_dropped

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().checkpoint()
    assert spark.conf.get(key, None) == before
    assert sorted(r["count"] for r in held.collect()) == [142] * 1 + [143] * 6
