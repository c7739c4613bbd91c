import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import merge, sort, verify
from tidemark.schema import validate
from tidemark.sources import gen, kvbin


def rec(key, payload):
    return struct.pack("<QI", key, len(payload)) + payload


def write(path, records):
    path.write_bytes(b"".join(rec(k, p) for k, p in records))
    return str(path)


def varlen(n, seed=0, keys=1000):
    r = np.random.default_rng(seed)
    return [(int(r.integers(0, keys)), r.bytes(int(r.integers(8, 1025)))) for _ in range(n)]


def read(spark, path, **o):
    return [(int(x["key"]), bytes(x["payload"])) for x in kvbin.read_records(spark, path, **o).orderBy("offset").collect()]


def test_empty_and_one(spark, tmp_path):
    assert read(spark, write(tmp_path / "e.bin", [])) == []
    assert read(spark, write(tmp_path / "o.bin", [(7, b"x" * 8)])) == [(7, b"x" * 8)]


@pytest.mark.parametrize("split", [1 << 30, 20_000])
def test_varlen_round_trip(spark, tmp_path, split):
    rows = varlen(400)
    path = write(tmp_path / "v.bin", rows)
    assert read(spark, path, splitBytes=split) == rows
    n = kvbin.read_records(spark, path, splitBytes=split).rdd.getNumPartitions()
    assert (n > 5) == (split == 20_000)


def test_fixed_len_splits_and_lookalike_headers(spark, tmp_path):
    rows = [(i, struct.pack("<QI", 5, 16) * 5 + b"abcd") for i in range(300)]
    path = write(tmp_path / "f.bin", rows)
    assert read(spark, path, splitBytes=1000, fixedLen=64) == rows
    assert read(spark, path, splitBytes=1000) == rows


def test_unsigned_order(spark, tmp_path):
    keys = [2**63, 0, 2**64 - 1, 2**63 - 1, 1]
    path = write(tmp_path / "u.bin", [(k, b"p" * 8) for k in keys])
    got = [int(r["key"]) for r in sort.global_sort(kvbin.read_records(spark, path), ["sort_key"], ["offset"]).collect()]
    assert got == sorted(keys)
    assert kvbin.read_records(spark, path).agg(F.max("key")).first()[0] == Decimal(2**64 - 1)


@pytest.mark.parametrize("bad", [rec(1, b"a" * 7), rec(1, b"a" * 1025), struct.pack("<QI", 1, 0), struct.pack("<QI", 1, 2**32 - 1), rec(1, b"a" * 100)[:-1], b"\0" * 5])
@pytest.mark.parametrize("split", [1 << 30, 64])
def test_malformed(spark, tmp_path, bad, split):
    good = [(i, b"q" * (20 + i)) for i in range(5)]
    path = tmp_path / "b.bin"
    path.write_bytes(b"".join(rec(*r) for r in good) + bad)
    at = len(path.read_bytes()) - len(bad)
    with pytest.raises(Exception, match="outside|cut off"):
        read(spark, str(path), splitBytes=split)
    assert read(spark, str(path), mode="PREFIX", splitBytes=split) == good
    bad_rows = kvbin.read_records(spark, str(path), mode="PERMISSIVE", splitBytes=split).filter("corrupt is not null").collect()
    assert [r["offset"] for r in bad_rows] == [at]
    (tmp_path / "first.bin").write_bytes(bad)
    assert read(spark, str(tmp_path / "first.bin"), mode="PREFIX") == []


def test_len_bounds_and_domain(spark, tmp_path):
    rows = [(1, b"a" * 8), (2, b"b" * 1024)]
    path = write(tmp_path / "l.bin", rows)
    assert read(spark, path) == rows
    df = spark.createDataFrame([(1, 7, bytearray(7)), (2, 8, bytearray(8))], "key int, len int, payload binary")
    assert validate(df, "DROP").count() == 1
    assert [r["valid"] for r in validate(df, "PERMISSIVE").orderBy("key").collect()] == [False, True]
    with pytest.raises(Exception, match="illegal payload length"):
        validate(df).collect()


@pytest.mark.parametrize("kind", ["asc", "desc", "equal", "dups", "random"])
def test_sort_properties(spark, tmp_path, kind):
    n = 1000
    keys = {"asc": range(n), "desc": range(n, 0, -1), "equal": [5] * n, "dups": [i * 7919 % 100 for i in range(n)], "random": np.random.default_rng(1).integers(0, 2**40, n).tolist()}[kind]
    path = write(tmp_path / "s.bin", [(int(k), struct.pack("<Q", i)) for i, k in enumerate(keys)])
    out = str(tmp_path / "out")
    df = kvbin.read_records(spark, path)
    merge.write_ordered(df, out, ["sort_key"], ["offset"], fmt="kvbin")
    order = verify.verify_records(spark, out)
    assert order.ok and order.rows == n
    assert verify.equal_bag(df.select("sort_key", "payload"), kvbin.read_records(spark, out).select("sort_key", "payload"))
    raw = verify.verify_records(spark, path)
    assert raw.ok == (list(keys) == sorted(keys))
    if kind == "desc":
        assert raw.inversions == n - 1 and raw.first_bad == 2
    sizes = sort.global_sort(df, ["sort_key"], ["offset"], partitions=8).groupBy(F.spark_partition_id()).count().count()
    assert sizes > 4  # equal keys do not pile up in one partition


def test_mutations_are_found(spark, tmp_path):
    rows = sorted((k, p) for k, p in varlen(200))
    a = write(tmp_path / "a.bin", rows)
    swapped = rows[:50] + [rows[199]] + rows[51:199] + [rows[50]]
    flipped = rows[:10] + [(rows[10][0], bytes([rows[10][1][0] ^ 1]) + rows[10][1][1:])] + rows[11:]
    assert verify.compare_files(spark, a, write(tmp_path / "same.bin", rows))
    for i, other in enumerate((rows[:-1], rows[:3] + rows[4:], rows + rows[-1:], swapped, flipped)):
        b = write(tmp_path / f"m{i}.bin", other)
        assert not verify.compare_files(spark, a, b)
        x, y = (kvbin.read_records(spark, p).select("sort_key", "payload") for p in (a, b))
        assert verify.equal_bag(x, y) == (other is swapped)
    assert not verify.verify_records(spark, str(tmp_path / "m3.bin")).ok
    assert not verify.verify_sorted(kvbin.read_records(spark, a), ["sort_key"], expected_rows=201).ok


def test_verify_across_partitions_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 1), (2, None)], "a int, b int").repartition(1)
    assert not verify.verify_sorted(df, ["a", "b"]).ok
    assert verify.verify_sorted(df, ["a"]).ok
    border = df.filter("a = 2").union(df.filter("a = 1"))
    r = verify.verify_sorted(border, ["a"])
    assert not r.ok and r.first_bad == 2


def test_side_file_splits(spark, tmp_path):
    df = gen.gen_mode(spark, 500, "RANDOM", seed=3)
    out = str(tmp_path / "side")
    kvbin.write_records(df.coalesce(1), out, splitBytes=20_000)
    again = kvbin.read_records(spark, out, splitBytes=20_000)
    assert again.rdd.getNumPartitions() > 5
    assert verify.equal_bag(df.select("sort_key", "payload"), again.select("sort_key", "payload"))


def test_generators(spark):
    a = gen.gen_count(spark, 1000, 64)
    b = gen.gen_count(spark, 1000, 64).repartition(7)
    assert verify.equal_bag(a, b)
    assert a.filter("len <> 64 or not cast(payload as string) rlike '^[A-Z]{64}$'").count() == 0
    assert gen.gen_size(spark, 10_000, 100).count() == -(-10_000 // 112)
    lens = gen.gen_mode(spark, 2000, "RANDOM").agg(F.min("len"), F.max("len")).first()
    assert lens[0] >= 8 and lens[1] <= 1024 and lens[1] > 900
    with pytest.raises(ValueError):
        gen.gen_count(spark, 1, 7)


def test_ints(spark, tmp_path):
    p = tmp_path / "i.bin"
    p.write_bytes(np.array([-5, 1, 1, 9], "<i4").tobytes())
    assert verify.verify_ints(spark, str(p)).ok
    p.write_bytes(np.array([3, 1], "<i4").tobytes())
    assert not verify.verify_ints(spark, str(p)).ok


def test_cli(spark, tmp_path):
    f, out = str(tmp_path / "g"), str(tmp_path / "g.sorted")
    assert cli.main(["gen_count", f, "500", "32"]) == 0
    assert cli.main(["verify", f]) == 1
    assert cli.main(["sort", f, "64", "2", "--output", out]) == 0
    assert cli.main(["verify", out]) == 0
    assert cli.main(["compare", f, out]) == 1
    assert cli.main(["compare", out, out]) == 0
    assert cli.main(["benchmark", f, "64", "2"]) == 0
    assert cli.main(["plan", f]) == 0
    assert cli.main(["delete", f]) == 0 and cli.main(["delete", f]) == 1
    assert cli.main(["verify", f]) == 1
    assert cli.main(["gen_count", f, "5", "3"]) == 1


def test_stream_runs(spark, tmp_path):
    from tidemark.streaming.runs import finish, stream_runs

    src = str(tmp_path / "src")
    gen.gen_count(spark, 300, 16).select("sort_key", "payload").repartition(3).write.parquet(src)
    s = spark.readStream.schema("sort_key bigint, payload binary").option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_runs(s, str(tmp_path / "runs"), ["sort_key"], None, str(tmp_path / "ck"))
    q.awaitTermination()
    got = finish(spark, str(tmp_path / "runs"), ["sort_key"])
    assert verify.verify_sorted(got, ["sort_key"], 300).ok
