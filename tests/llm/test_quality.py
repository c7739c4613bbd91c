import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.quality import BAD, GOOD, LISTS, MOST, LabelModel, Scorer, Shape, association, bucket, fit, learned_insults, pattern, quality_filter, quality_votes, scored, toxic_votes, votes_of, with_learned
from tidemark.llm.queries_quality import op7_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Toxic words come from labels of odd ids, or of none; even ids judge. The quality label is never shown."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = [r for r in labels_of(labels) if r[0] % 2 == 0]
    fine = [d for d, q, t in judged if q == 1 and t == 0]
    junk = [d for d, q, t in judged if q == 0]
    toxic = [d for d, q, t in judged if q == 1 and t == 1]
    for known, least in ((labels.filter("doc_id % 2 = 1"), 0.78), (None, 0.5)):
        keep = {r["doc_id"]: r["keep"] for r in scored(docs, labels=known).join(labels.filter("doc_id % 2 = 0"), "doc_id").collect()}
        share = [sum(keep[d] for d in fine) / len(fine), sum(not keep[d] for d in junk) / len(junk), sum(not keep[d] for d in toxic) / len(toxic)]
        print("learned words" if known is not None else "fixed lists", "clean kept, junk rejected, toxic rejected:", share, len(fine), len(junk), len(toxic))
        assert len(fine) > 1000 and share[0] >= 0.98 and share[1] >= 0.98 and share[2] >= least
    assert scored(docs.limit(0)).count() == 0


def labels_of(labels):
    return [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]


def slow_votes(text, lists):
    """All votes and features of a text, measure by measure."""
    tokens = text.split()
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
    n, solid = len(tokens), sum(map(len, tokens))
    if not n:
        return [0] * 6, [0] * 4, set()
    symbols = sum(text.count(c) for c in "|#$%&*<>{}[]\\^~=") / solid
    letters = sum(len(w) for w in re.findall(r"[^\W\d_]+", text)) / solid
    top = max(tokens.count(t) for t in set(tokens)) / n if n < 3000 else Counter(tokens).most_common(1)[0][1] / n
    run = best = 1
    for a, b in itertools.pairwise(tokens):
        run = run + 1 if a == b else 1
        best = max(best, run)
    variety = len(set(tokens)) / n
    capitals = sum(t.isupper() for t in tokens) / n
    marks = len(re.findall(r"[!?]{2,}|([#$%&*~^=+<>\\|])\1+", text)) / n
    band = lambda x, good, bad: GOOD if x <= good else BAD if x >= bad else 0
    q = [band(symbols, 0.01, 0.04), 0, 0, 0, 0, band(marks, 0.02, 0.1)]
    if n >= 5:
        q[2] = band(capitals, 0.1, 0.3)
    if n >= 20:
        q[1] = BAD if best >= 6 or top >= 0.3 else GOOD if top <= 0.15 else 0
        q[3] = GOOD if variety >= 0.55 else BAD if variety <= 0.4 else 0
        q[4] = GOOD if letters >= 0.85 else BAD if letters <= 0.75 else 0
    t = [0] * 4
    if words:
        t = [BAD if set(words) & x else GOOD for x in lists[:3]]
        t.append((BAD if {w[:5] for w in words} & lists[3] else GOOD) if lists[3] else 0)
    cut = lambda x, edges: sum(x >= e for e in edges)
    size = cut(n, (5, 20))
    shape = [("sym", symbols, (0.01, 0.02, 0.04, 0.1), ""), ("let", letters, (0.6, 0.7, 0.75, 0.8, 0.85), f"/{size}"), ("top", top, (0.1, 0.15, 0.2, 0.3), f"/{size}"), ("run", best, (2, 3, 6), ""), ("var", variety, (0.2, 0.4, 0.55), f"/{size}"), ("cap", capitals, (0.1, 0.2, 0.3, 0.6), f"/{size}"), ("mrk", marks, (0.02, 0.05, 0.1, 0.3), "")]
    features = set(words) | {f"#{name}{cut(x, edges)}{end}" for name, x, edges, end in shape}
    features |= {f"#q{i}" for i, v in enumerate(q) if v == BAD} | {f"#t{i}" for i, v in enumerate(t) if v == BAD}
    return q, t, features


def slow_em(votes, m):
    """Expectation-maximisation text by text; returns each text's probability of good."""
    prior, bad_if = 0.85, [[0.02, 0.5] for _ in range(m)]  # chance of a bad vote for good and bad texts
    groups = Counter(map(tuple, votes))

    def posterior(v):
        good, bad = prior, 1 - prior
        for j, x in enumerate(v):
            if x:
                good *= bad_if[j][0] if x == BAD else 1 - bad_if[j][0]
                bad *= bad_if[j][1] if x == BAD else 1 - bad_if[j][1]
        return good / (good + bad)

    for _ in range(300):
        post = {v: posterior(v) for v in groups}
        new = []
        for j in range(m):
            sums = [[20 * 0.02, 20.0], [20 * 0.5, 20.0]]
            for v, n in groups.items():
                if v[j]:
                    for k, p in ((0, post[v]), (1, 1 - post[v])):
                        sums[k][1] += n * p
                        sums[k][0] += n * p * (v[j] == BAD)
            new.append([b / a for b, a in sums])
        share = (sum(n * post[v] for v, n in groups.items()) + 20 * 0.85) / (sum(groups.values()) + 20)
        done = abs(share - prior) < 1e-9 and max(abs(x[1] - y[1]) for x, y in zip(new, bad_if, strict=True)) < 1e-7
        prior, bad_if = share, new
        if done:
            break
    return posterior


def slow_scorer(rows, target, min_df=5):
    """Dense logistic regression by full-batch Adagrad."""
    df = Counter(b for r in rows for b in r)
    known = sorted(df)
    x = np.zeros((len(rows), len(known)))
    for i, r in enumerate(rows):
        for j, b in enumerate(known):
            x[i, j] = b in r and df[b] >= min_df
    w, bias, h, hb = np.zeros(len(known)), 0.0, np.full(len(known), 1e-8), 1e-8
    weight = np.where(target > 0.5, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    shrink = np.where(np.array(known) < 1 << 18, 2e-3, 2e-3 / 300)
    for _ in range(150):
        err = weight * (1 / (1 + np.exp(-(x @ w + bias))) - target)
        g, gb = x.T @ err / len(rows) + shrink * w, err.mean()
        h, hb = h + g * g, hb + gb * gb
        w, bias = w - 0.3 * g / np.sqrt(h), bias - 0.3 * gb / np.sqrt(hb)
    return dict(zip(known, w, strict=True)), bias


def test_query(spark):
    """The query against its definition: votes, EM, training and scores, text by text."""
    sf = "/root/testdata/sf0.01"
    got = op7_quality(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    lists = with_learned(learned_insults(docs, spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text"))
    seen = {t: slow_votes(t, lists) for t in set(texts.values())}
    models = []
    for group, m in ((0, 6), (1, 4)):
        posterior = slow_em([seen[t][group] for t in texts.values()], m)
        once = sorted(seen)
        target = np.array([posterior(tuple(seen[t][group])) for t in once])
        buckets = [{bucket(f, 18) for f in seen[t][2]} for t in once]
        known = [sorted(b for b in x if b < 1 << 18)[:MOST] + [b for b in x if b >= 1 << 18] for x in buckets]
        models.append((*slow_scorer([set(x) or {-1} for x in known], target), posterior))
    for r in got:
        t = texts[r["doc_id"]]
        if t.strip():
            for (w, bias, _), p in zip(models, (r["quality"], 1 - r["toxicity"]), strict=True):
                z = bias + sum(w.get(bucket(f, 18), 0.0) for f in seen[t][2])
                assert abs(p - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) < 1e-4


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    y = r.random(50_000) < 0.8
    find = np.array([0.6, 0.5, 0.3, 0.7])
    votes = np.where(np.where(y[:, None], r.random((len(y), 4)) < 0.01, r.random((len(y), 4)) < find), BAD, GOOD)
    votes[r.random(votes.shape) < 0.2] = 0
    counts = {}
    for v in votes.tolist():
        counts[pattern(v)] = counts.get(pattern(v), 0) + 1
    m = LabelModel.fit(counts, 4)
    assert abs(m.prior - 0.8) < 0.03 and np.abs(m.bad[:, BAD] - find).max() < 0.06 and m.good[:, BAD].max() < 0.03
    assert m.posterior([BAD, BAD, 0, GOOD]) < 0.05 and m.posterior([GOOD] * 4) > 0.9
    assert votes_of(pattern([0, 1, 2, 1]), 4) == [0, 1, 2, 1]


def test_shapes_and_votes():
    good = "The quick brown fox jumps over the lazy dog while seven wizards mix jugs of quartz for every patient king. " * 1
    assert BAD not in quality_votes(Shape.of(good))
    for junk in ("word " * 100, "a | " * 50, "WHAT!! IS!! THIS!! " * 20, "x%%% y### z$$$ " * 30):
        assert BAD in quality_votes(Shape.of(junk))
    assert set(quality_votes(Shape.of(""))) == {0} and set(quality_votes(Shape.of(" \n"))) == {0}


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 200_000), (4, "fine text here"), (4, "fine text here"), (None, "fine text here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("quality", F.lit("clash")).withColumn("keep", F.lit(False))
    got = scored(df).collect()
    assert len(got) == 6 and len({(r["quality"], r["toxicity"]) for r in got if r["doc_id"] in (4, None)}) == 1
    kept = quality_filter(df)
    assert kept.columns == df.columns and {1, 2, 4} <= {r["doc_id"] for r in kept.collect()}
    assert quality_filter(df.limit(0)).count() == 0


def test_learned_insults(spark):
    near = lambda i: chr(97 + i % 17) * 3
    rows = [(i, f"plain words {near(i)} " + ("zorgle" if i % 5 == 0 else "pleasant") + f" {near(i // 3)}") for i in range(200)]
    rows += [(1000 + i, "one bad passage with a copied word" + " 7" * i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", ((F.col("doc_id") % 5 == 0) | (F.col("doc_id") >= 1000)).cast("int").alias("toxic"))
    assert learned_insults(docs, labels, "doc_id", "text") == ["zorgl*", "zorgle"]  # "passage" is in forty toxic texts, in one context
    assert learned_insults(docs, labels.limit(0), "doc_id", "text") == []
    assert association(np.array([5.0]), np.array([0.0]), 100, 100)[0] < 24
    model = fit(docs, labels=labels)
    assert sum("zorgle" in x for x in model.lists) == 1 and model.lists[3] == {"zorgl"}


def test_no_word_makes_two_labellers_agree():
    lists = with_learned(["zorgle", "idiot", "blarg", "zorgl*"])
    assert all(not a & b for a, b in itertools.combinations(lists[:3], 2)) and not any(a & b for a, b in itertools.combinations(LISTS, 2))
    for w in set().union(*lists[:3]):
        assert sum(v == BAD for v in toxic_votes({w}, lists)[:3]) == 1
    assert toxic_votes({"zorgling"}, lists) == [GOOD, GOOD, GOOD, BAD] and toxic_votes(set(), lists) == [0] * 4


def test_scorer_with_one_class():
    s = Scorer.fit([np.array([1, 2])], np.array([0.9]), 18, 1)
    assert s.score([]) > 0.5


def test_a_worker_forgets_the_tokenizers_words():
    import public_tokenizers

    from tidemark.llm import encoding
    from tidemark.llm.batches import lean

    encoding.Encoder.of(public_tokenizers.path("word_bpe_49k.json")).encode("some words")
    lean(encoders=True)
    assert encoding._cache
    lean()
    assert not encoding._cache
