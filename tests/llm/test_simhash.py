import random
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.queries_simhash import op2_simhash
from tidemark.llm.simhash import _masks, fingerprint, link_bucket, near_duplicates, near_duplicates_removed

SF = "/root/testdata/sf0.01"
BLANKS = "\t\n\x0b\x0c\r "


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, w = [], ""
    for c in text + " ":
        if c in BLANKS:
            words += [w] if w else []
            w = ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    """(id, fp) -> {index: smallest id reachable}, over all pairs."""
    fps = np.array([f for _, f in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            parent[find(int(j))] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [low[find(i)] for i in range(len(rows))]


def test_query(spark):
    docs = [(r["doc_id"], slow_fingerprint(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(docs, slow_components(docs), strict=True)}
    got = {tuple(r) for r in op2_simhash(spark, SF).collect()}
    assert got == want and len(want) == len(docs)
    assert len({c for *_, c in want}) < len(docs)


def test_hash_is_sparks():
    assert xxhash.xxh64(b"a b c", seed=42).intdigest() == fingerprint("a b c") == fingerprint("A\tB\x0bC")
    assert fingerprint(" \n") == 0 and fingerprint("x y") == xxhash.xxh64(b"x y", seed=42).intdigest()


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None), (9, ""), (3, "one two three"), (7, "ONE two\nthree"), (8, "solo"), (8, "solo"), (2, long), (1, long + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect())
    fps = [(d, fingerprint(t or "")) for d, t in rows]
    assert got == sorted(zip([d for d, _ in rows], slow_components(fps), strict=True))
    assert near_duplicates(df.limit(0)).count() == 0
    kept = near_duplicates_removed(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(set(slow_components(fps)))
    assert near_duplicates_removed(df.limit(0)).count() == 0


def test_repeated_ids_lose_no_group(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (1, "delta epsilon zeta"), (1, "alpha beta gamma"), (None, "eta theta iota")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in near_duplicates_removed(df).collect()) == ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]


def test_bucket_ways_agree():
    r = random.Random(3)
    mask = _masks(6, 3)[7]
    base = r.getrandbits(64)
    fps = {base}
    for _ in range(300):
        f = r.choice(sorted(fps))
        for _ in range(r.randint(1, 4)):
            f ^= 1 << r.choice([i for i in range(64) if not mask >> i & 1])
        fps.add(f)
    a = np.array(sorted(fps), np.uint64)
    assert groups(link_bucket(a, mask, 3)) == groups(link_bucket(a, mask, 3, small=4))


def groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    out = {}
    for x in parent:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_a_bucket_of_hundreds_of_thousands():
    rng = np.random.default_rng(5)
    mask = _masks(6, 3)[0]
    free = [i for i in range(64) if not mask >> i & 1]
    a = np.zeros(300_000, np.uint64)
    for i in free:
        a |= rng.integers(0, 2, len(a), np.uint64) << np.uint64(i)
    a = np.unique(a)
    some = a[:: len(a) // 500]
    planted = some ^ np.uint64((1 << free[0]) | (1 << free[9]) | (1 << free[-1]))
    begin = time.perf_counter()
    edges = link_bucket(np.unique(np.concatenate([a, planted])), mask, 3)
    assert time.perf_counter() - begin < 120
    linked = {x for e in edges for x in e}
    assert all(int(x) in linked for x in some) and all(int(x) in linked for x in planted)


def test_a_new_split_of_the_scan_changes_nothing(spark, tmp_path):
    """The scan is split otherwise when the result is written than when the call was made."""
    from tidemark.llm.jaccard import near_copies_removed

    texts = [" ".join(f"t{i}w{j}" for j in range(8)) for i in range(3000)]
    rows = list(enumerate(texts)) + [(10_000 + i, texts[3 * i]) for i in range(700)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).write.parquet(path)
    key = "spark.sql.files.openCostInBytes"
    for removed in (near_duplicates_removed, near_copies_removed):
        out = removed(spark.read.parquet(path))
        before = spark.conf.get(key)
        spark.conf.set(key, "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        try:
            kept = sorted(r["doc_id"] for r in out.collect())
        finally:
            spark.conf.set(key, before)
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert kept == list(range(3000)), removed


def test_planted_distances(spark):
    """Fingerprints 3 bits apart are always found, 4 bits apart only through others."""
    from tidemark.llm.simhash import links

    r = random.Random(9)
    fps = []
    for _ in range(150):
        f = r.getrandbits(64)
        fps += [f, f ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 3, 4])))]
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    member = {x["node"] % (1 << 64): x["root"] for x in components(links(df)).collect()}
    low = slow_components(rows)
    for i in range(len(fps)):
        for j in (i ^ 1,):
            assert (low[i] == low[j]) == (fps[i] in member and member.get(fps[i]) == member.get(fps[j]))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
