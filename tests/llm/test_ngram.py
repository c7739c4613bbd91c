import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.elias_fano import EliasFano, Trie, dump, pack, unpack, view
from tidemark.llm.ngram import END, Settings, _hashes, build_vocabulary, decode_pairs, encode_pairs, pair_scores, quantise, score, shard_trie
from tidemark.llm.queries_ngram import op8_ngram

SF = "/root/testdata/sf0.01"


def brute(rows, mu=100.0):
    def tokens(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w] + [" END"]

    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    docs = [tokens(t) for _, t in rows]
    c, b, ctx = Counter(), Counter(), Counter()
    for w, h in zip(docs, held, strict=True):
        if not h:
            c.update(w)
            p = [" START", *w[:-1]]
            b.update(zip(p, w, strict=True))
            ctx.update(p)
    n, v = sum(c.values()), len(c)
    one, two = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(max(one / (one + 2 * two), 0.05), 0.95) if one else 0.5
    p1 = lambda w: ((c[w] - d) / n if w in c else d * v / n) if n else 1.0
    out = []
    for (i, _), h, w in zip(rows, held, docs, strict=True):
        base = sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        s = sum(math.log10((b.get((a, x), 0) + mu * p1(x)) / (ctx.get(a, 0) + mu)) for a, x in zip([" START", *w[:-1]], w, strict=True))
        out.append((i, h, len(w), sum(x in c for x in w), n, base, s))
    return out


def compare(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[5]))
    want = sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and abs(g[6] - w[6]) <= 2e-3 * g[2], (g, w)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op8_ngram(spark, SF).collect()
    compare(got, brute(rows))
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_many_shards(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(3)
    compare(score(df, s=Settings(slice_bytes=20_000, vocabulary_shard=500, pair_shard=3000)).collect(), brute(rows))


def test_cases(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "The the\tTHE \x0b x"), (3, "The the\tTHE \x0b x"), (4, "w " * 50_000), (5, "é Ü")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    compare(score(df).collect(), brute(rows))
    only_held = [(d, "never seen") for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    compare(score(spark.createDataFrame(only_held, "doc_id bigint, text string")).collect(), brute(only_held))
    assert score(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 2) | st.integers(0, 300) | st.integers(10**6, 10**6 + 50), min_size=1, max_size=300), st.lists(st.integers(0, 2**64 - 2) | st.integers(0, 400), max_size=50))
def test_elias_fano(values, probes):
    a = np.sort(np.array(values, np.uint64))
    ef = EliasFano.of(view(dump(EliasFano.build(a).arrays())))
    assert (ef.decode() == a).all() and (ef.access(np.arange(len(a))) == a).all()
    x = np.array([*probes, *values, *[v + 1 for v in values]], np.uint64)
    assert (ef.next_geq(x) == np.searchsorted(a, x)).all()


def test_elias_fano_is_small():
    a = np.sort(np.random.default_rng(0).integers(0, 10**9, 100_000).astype(np.uint64))
    ef = EliasFano.build(a)
    bits = 8 * (ef.lows.nbytes + ef.highs.nbytes + ef.ones.nbytes + ef.zeros.nbytes) / len(a)
    assert bits < math.log2(10**4) + 2 + 6.5


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(0, 2**40)), min_size=1, max_size=120), st.integers(1, 16))
def test_trie_of_three_levels(grams, bits):
    rows = np.array(sorted(grams))
    codes = [None, None, np.arange(len(rows)) % (1 << bits)]
    t = Trie.of(view(dump(Trie.build(rows, codes, bits).arrays())))
    node = t.find(rows)
    assert (node == np.arange(len(rows))).all() and (t.code(2, node) == codes[2]).all()
    pairs = sorted({r[:2] for r in map(tuple, rows.tolist())})
    probe = np.array([(a, b) for a in range(8) for b in range(11)])
    want = [pairs.index((a, b)) if (a, b) in pairs else -1 for a, b in probe.tolist()]
    assert t.find(probe).tolist() == want
    other = rows + [0, 0, 1]
    assert t.find(other).tolist() == [sorted(grams).index(tuple(r)) if tuple(r) in grams else -1 for r in other.tolist()]


def test_packing_and_blocks():
    r = np.random.default_rng(2)
    for width in (0, 1, 7, 31, 33, 63):
        x = r.integers(0, 1 << width, 500).astype(np.uint64)
        assert (unpack(pack(x, width), width, np.arange(500)) == x).all()
    import zstandard

    for top in (1 << 20, 1 << 40):
        h, w, d = np.sort(r.integers(0, top, 1000)), r.integers(0, top, 1000), r.integers(0, 5000, 1000)
        back = decode_pairs(encode_pairs(h, w, d, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor())
        assert all((a == b).all() for a, b in zip(back, (h, w, d), strict=True))
    x = r.normal(size=100_000)
    code, book = quantise(x, np.ones(len(x)), 12)
    assert np.abs(book[code] - x).mean() < 1e-3 and code.max() < 1 << 12


def test_probabilities_add_up(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a b"), (3, "c c a")], "d bigint, t string")
    cfg = Settings(mu=3.0)
    voc = build_vocabulary(docs, str(tmp_path / "v"), cfg)
    v = voc.v
    assert (v, voc.n, voc.texts) == (4, 12, 3)
    id_of = dict(zip("abc$", voc.lookup(_hashes([b"a", b"b", b"c", END]))[0].tolist(), strict=True)) | {"^": v}
    pairs = Counter((id_of[x], id_of[y]) for t in ("abac", "ab", "cca") for x, y in zip("^" + t, t + "$", strict=True))
    h, w = (np.array(c) for c in zip(*sorted(pairs), strict=True))
    arrays = view(dump(shard_trie(h, w, np.array([pairs[p] for p in sorted(pairs)]), voc, cfg)))
    for context in set(range(v + 2)) - {id_of["$"]}:  # nothing follows an end
        words = np.array([*range(v), v + 1])
        p = 10 ** pair_scores(np.full(v + 1, context), words, arrays, voc, cfg)
        assert abs(p.sum() - 1) < 1e-9
