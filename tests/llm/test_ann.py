import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.ann import Quantiser, Settings, kmeans, search
from tidemark.llm.queries_ann import op4_ann


def brute(ids, x, picked, k):
    out = {}
    for i in np.flatnonzero(picked):
        s = np.zeros(len(x))
        for j in range(x.shape[1]):
            s += x[:, j] * x[i, j]
        order = sorted((-s[j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out[ids[i]] = [(d, -m) for m, d in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hit = total = 0
    for q, w in want.items():
        least = w[-1][1]
        total += len(w)
        hit += sum(s >= least - 1e-12 for _, s in got[q])
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in rows]
    x = np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, np.array(ids) % 20 == 0, 20)
    got = by_query(op4_ann(spark, f"/root/testdata/{sf}").collect())
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {q: dict(w) for q, w in want.items()}
    assert all(exact[q].get(d, s) == s for q, v in got.items() for d, s in v)


def test_norms_copies_and_bad_rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8)) * r.uniform(0.1, 3, size=(600, 1))
    x[100:300] = x[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [float("inf")] * 8), (1100, [1.0] * 5), (1120, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).withColumn("id", F.lit(1)).withColumn("v", F.lit(1))
    got = by_query(search(df, F.col("id") % 20 == 0, s=Settings(k=20, recall=1.0, shard=50)).collect())
    want = brute(list(range(600)), x, np.arange(600) % 20 == 0, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.99
    assert all([d for d, _ in got[q]] == [d for d, _ in want[q]] for q in range(100, 300, 20))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.5]), (3, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    got = by_query(search(df, F.col("id") % 20 == 0).collect())
    assert got == {0: [(20, 1.0), (3, 0.5)], 20: [(0, 1.0), (3, 0.75)]}
    assert search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert search(df, F.col("id") == 999).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert search(one, F.col("id") % 20 == 0).count() == 0


def test_traversal_order():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 10))
    q = Quantiser(kmeans(x[:, :5], 6, 1), kmeans(np.column_stack([x[:, 5:], np.zeros(300)]), 7, 2), 0.0)
    order = list(q.traverse(x[0]))
    d1 = ((q.first - x[0, :5]) ** 2).sum(1)
    d2 = ((q.second - np.append(x[0, 5:], 0)) ** 2).sum(1)
    sums = [d1[c // 7] + d2[c % 7] for c in order]
    assert sorted(order) == list(range(42)) and sums == sorted(sums)
