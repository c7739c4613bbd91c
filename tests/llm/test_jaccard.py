from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidemark.llm.jaccard import fingerprint_groups, link_bucket, near_copies_removed, shingles
from tidemark.llm.pii import find_base


def slow_shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_kept(rows):
    """(id, text) -> ids that stay, and pairs of distinct sets that are linked; over all pairs that share a shingle."""
    groups, holders = defaultdict(list), defaultdict(list)
    for d, t in rows:
        groups[slow_shingles(t)].append(d)
    sets = list(groups)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x]).items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
                pairs += 1
        for x in s:
            holders[x].append(i)
    low = {}
    for i, s in enumerate(sets):
        r = find(i)
        low[r] = min(low.get(r, min(groups[s])), min(groups[s]))
    return set(low.values()), pairs


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 5), ("sf0.1", 36)])
def test_stage_against_all_pairs(spark, tmp_path, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    out = by_name["near_dedup"](spark, docs, f"/root/testdata/{sf}")
    assert out.columns == docs.columns
    want, pairs = slow_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert pairs >= least
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(want)
    if sf == "sf0.01":
        out.write.parquet(f"{tmp_path}/one")
        one = spark.read.parquet(f"{tmp_path}/one")
        safe = by_name["personal_data"](spark, one, f"/root/testdata/{sf}")
        texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in safe.collect()}
        assert set(texts) == want and all(t is None or not find_base(t) and n == len(t) for t, n in texts.values())


def test_groups(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):  # a chain: neighbours are near copies, the ends share nothing
        rows.append((100 + i, " ".join(f"c{j}" for j in range(i * 3, i * 3 + 60))))
    for i in range(400):  # near copies of one text, each with a word of its own
        rows.append((1000 + i, " ".join([*base[:50], f"own{i}", *base[51:]])))
    rows += [(1, None), (2, ""), (3, "a b"), (4, "A\nb"), (4, "a b"), (5, "a c"), (6, "x y z u v w"), (None, "x y z u v w q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in near_copies_removed(docs).collect())
    assert got == [-1, 1, 3, 5, 6, 100, 1000]
    assert near_copies_removed(docs.limit(0)).count() == 0


def test_parts_of_a_bucket_meet(spark, monkeypatch):
    """A hot bucket, cut into many parts, gives the same groups."""
    from tidemark.llm import jaccard

    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:40], f"own{i % 150}", *base[41:]])) for i in range(300)]
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i * 3, i * 3 + 60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "BUCKET", 600)
    assert sorted(r["doc_id"] for r in near_copies_removed(docs).collect()) == [0, 1000]


def test_fingerprints_come_first(spark):
    """Nodes whose fingerprints are linked by up to three bits share a bucket, over any number of steps."""
    far = 0x7FFF << 32
    rows = [(1, 10, 0), (2, 10, 0b111), (3, 10, 0b111_111), (4, 10, far), (5, 10, far), (6, 10, -1), (7, 10, 0xFF << 20)]
    got = fingerprint_groups(spark.createDataFrame(rows, "node bigint, size bigint, fp bigint")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["key"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5]] and {r["parts"] for r in got} == {1}


def test_bucket_finds_all_links():
    texts = [" ".join(f"c{j}" for j in range(i * 3, i * 3 + 60)) for i in range(30)] + ["other words than those of them all", ""]
    stars = link_bucket(list(range(32)), [shingles(t) for t in texts])
    assert sorted(stars) == [(i, 0) for i in range(1, 30)]
