from pyspark.sql import functions as F

from tidemark.plans import chunking as c


def test_chunk_rules():
    assert c.sequential_chunk(100) == 80
    assert c.threaded_chunk(1000, 1000, 4) == 200  # ceil(1000 / 200) = 5 chunks
    assert c.threaded_chunk(1000, 100_000, 4) == 250
    assert c.distributed_chunk(1000, 10_000, 5) == 250
    assert c.distributed_chunk(1000, 200, 3) == 143  # 7 chunks of at most 160
    assert c.clamped_chunk(8 << 20, 1) == 16 << 20
    assert c.clamped_chunk(64 << 30, 4) == 1 << 30


def test_adaptive_rules():
    cfg = c.preset(4, 1 << 30)
    assert (cfg.min_chunk, cfg.safety) == (64 << 20, 0.8)
    assert c.preset(1).min_chunk == 128 << 20 and c.preset(16).safety == 0.7
    size = 10 << 30
    room = int(int(int((1 << 30) * 0.8) / 2.5) / 1.3)
    assert c.adaptive_chunk(size, 76, cfg) == max(room // 2, 64 << 20)
    assert c.even_count_chunk(300 << 20, 100 << 20, cfg) == 75 << 20
    assert c.even_count_chunk(400 << 20, 100 << 20, cfg) == 100 << 20
    assert c.merge_fanout(10, 1 << 30) == 10 and c.merge_fanout(400, 1 << 30) == 16 and c.merge_fanout(25, 1 << 30) == 8


def test_pack_and_balance():
    got = c.pack_bytes([40, 40, 40, 10], 60)
    assert [(x.start, x.length, x.records) for x in got] == [(0, 80, 2), (80, 50, 2)]
    b = c.balance([c.Chunk(0, 10, 1), c.Chunk(10, 100, 1), c.Chunk(110, 100, 1)])
    # The mean is 70: 10 is small, but 10 + 100 is over 1.5 means, so nothing is joined.
    assert [x.length for x in b] == [10, 100, 100]
    joined = c.balance([c.Chunk(0, 10, 1), c.Chunk(10, 90, 2), c.Chunk(100, 110, 3), c.Chunk(210, 90, 4)])
    assert joined == [c.Chunk(0, 100, 3), c.Chunk(100, 110, 3), c.Chunk(210, 90, 4)]
    even = [c.Chunk(0, 100, 1), c.Chunk(100, 101, 1)]
    assert c.balance(even) == even


def test_plan(spark):
    sizes = spark.range(1000).select((F.col("id") % 100 + 20).alias("size"))
    row = c.size_stats(sizes).first()
    assert (row["n"], row["avg_size"], row["min_size"], row["max_size"]) == (1000, 69, 20, 119)
    assert abs(row["size_variance"] - sum((x % 100 + 20 - 69) ** 2 for x in range(1000)) / 1000) < 1e-6
    chunk, bound = c.plan_size(10 << 30, row, c.preset(8, 4 << 30))
    assert bound and c.ceil_div(10 << 30, chunk) % 2 == 0
    big = c.size_stats(spark.range(1000).select((F.col("id") % 100 + 2**40).alias("size"))).first()
    assert abs(big["size_variance"] - 833.5) < 1e-6  # exact, however large the sizes


def test_even_split_small(spark):
    df = spark.range(5)
    assert sorted(r["chunk_id"] for r in c.even_split(df, 8, ["id"]).collect()) == [1, 2, 3, 4, 5]
