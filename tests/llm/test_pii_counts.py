import random

from tidemark.llm.pii import disclosing_terms


def mentions(r, n, words, name="Brunhilda", mail="bq@corp.example.com"):
    return [" ".join(r.choices(words, k=15)) + f" {name} {mail} " + " ".join(r.choices(words, k=15)) for _ in range(n)]


def terms(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["term"]: r["disclosure"] for r in disclosing_terms(docs).collect()}


def test_copies_weigh_one(spark):
    r = random.Random(4)
    words = [f"w{i}x" for i in range(300)]
    other = [" ".join(r.choices(words, k=30)) for _ in range(600)]
    independent = mentions(r, 5, words)
    # Copies of a mention take no term's redaction away, nor do copies of a text that has the term without the value.
    plain = terms(spark, other + independent)
    got = terms(spark, other + independent + [independent[0]] * 300)
    assert abs(got["brunhilda"] - 1) < 1e-9 and got == plain
    elsewhere = [" ".join(r.choices(words, k=30)) + " Brunhilda"]
    assert terms(spark, other + independent + elsewhere * 200) == terms(spark, other + independent + elsewhere)


def test_near_copies_prove_nothing(spark):
    r = random.Random(5)
    words = [f"w{i}x" for i in range(300)]
    other = [" ".join(r.choices(words, k=30)) for _ in range(300)]
    one = mentions(r, 1, words, "Zebrafish", "z@z.example.org")[0].split()
    edited = []
    for i in range(60):
        w = list(one)
        w[r.choice([j for j in range(len(w)) if j not in (15, 16)])] = f"edit{i}"
        edited.append(" ".join(w))
    assert "zebrafish" not in terms(spark, other + edited)
    passage = [" ".join(r.choices(words, k=60)) + " " + " ".join(one) for _ in range(30)]  # in thirty different texts
    assert "zebrafish" not in terms(spark, other + passage)


def test_thousands_of_mentions_and_a_large_group(spark):
    r = random.Random(6)
    words = [f"w{i}x" for i in range(400)]
    many = mentions(r, 3000, words)
    got = terms(spark, many + [many[0]] * 500 + [" ".join(r.choices(words, k=30)) for _ in range(3000)])
    assert set(got) == {"brunhilda"} and abs(got["brunhilda"] - 1) < 1e-9
