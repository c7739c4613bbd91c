import re

from test_jaccard import slow_kept

import corpus_pipeline
from tidemark.llm.pii import find_base

SF = "/root/testdata/sf0.01"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "packing"]
    kept = by_name["quality"](spark, docs, SF)
    assert kept.columns == columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, v in labels.items() if v == (1, 0)]
    junk = [d for d, v in labels.items() if v[0] == 0]
    assert sum(d in rows for d in clean) >= 0.97 * len(clean) and sum(d in rows for d in junk) <= 0.05 * len(junk)
    one = by_name["near_dedup"](spark, kept, SF)
    assert one.columns == columns
    left = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(left) == slow_kept([(d, r["text"]) for d, r in rows.items()])[0]
    safe = by_name["personal_data"](spark, one, SF)
    assert safe.columns == columns and dict(safe.dtypes) == dict(docs.dtypes)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in safe.collect()}
    assert set(texts) == set(left)
    for d, (t, n) in texts.items():
        assert not find_base(t) and n == len(t)
        if not find_base(left[d]):
            assert t == left[d] or len(re.findall("<TERM>", t)) or len(t) < len(left[d])
    packed = by_name["packing"](spark, safe, SF).collect()
    assert {r["doc_id"] for r in packed} == set(texts)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, sf)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    whole = lambda rows: sorted((d, n) for d, n in {(k[0], k[4]) for k in map(key, rows)})
    got = out.collect()
    assert whole(got) == whole(want.collect()) and len(got) > 100
    for d, n in whole(got):  # each document's ids lie in one piece each
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == n


def test_stages_on_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, "same text of some words", "en", "a", 23), (3, "same text of some words", "en", "a", 23), (4, "Same text\nof some words", "de", "b", 23), (5, "word " * 300_000, "en", "a", 1_500_000), (6, "mail a.b@example.com now", "fr", "c", 24), (None, "no id but text here", "es", None, 19)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("__row", "__key", "__score", "fp", "component_id", "t", "d", "quality"):
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    for table in (docs, docs.limit(0)):
        table = table.checkpoint()
        out = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF).checkpoint()
            assert name == "packing" or out.columns == table.columns
            if name == "near_dedup" and not table.isEmpty():
                left = [(r["doc_id"], (r["text"] or "")[:9]) for r in out.collect()]
                # The three texts without words are one group, and so are the three of the same words.
                assert sorted(left, key=str) == sorted([(None, ""), (3, "same text"), (5, "word word"), (6, "mail a.b@"), (None, "no id but")], key=str)
        assert {r["doc_id"] for r in out.collect()} == (set() if table.isEmpty() else {None, 3, 5, 6})
