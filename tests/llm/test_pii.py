import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm.pii import Rules, _window, clean, disclosing_terms, find_base, find_personal, find_secrets, sanitised, spans_text
from tidemark.llm.queries_pii import op9_pii

SF = "/root/testdata/sf0.01"


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(d):
        d = [int(c) for c in d][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = "".join(c for c in m[0] if c in "0123456789")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = slow_base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans_text(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, *_ in base) for x in ("email", "ip", "card", "phone")]
        assert r["spans"].startswith(spans_text(base))
    assert sum(r["n_email"] for r in got) and sum(r["n_phone"] for r in got) and sum(r["n_card"] for r in got)
    assert sum(r["n_term"] > 0 for r in got) <= 0.02 * len(got)  # clean documents are left alone


def test_base_against_patterns():
    r = random.Random(0)
    units = ["a", "B", ".", "-", "@", "@", "1", "2", "25", "255", "256", "007", " ", "+", "(", ")", "x.y", "é", "4111 1111 1111 1111", "4111-1111", "+1 (017) 555-7713", "%", "_", "192.168.1.1"]
    for _ in range(4000):
        text = "".join(r.choices(units, k=r.randint(0, 30)))
        assert find_base(text) == slow_base(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000, "+1(" * 100_000, "0" * 6000 + ".1.1.1"):
        find_base(text)


def corpus(spark, n=400):
    r = random.Random(1)
    words = [f"w{i}x" for i in range(300)]
    rows = []
    for i in range(n):
        t = " ".join(r.choices(words, k=40))
        if i % 50 == 0:
            t += f" ask Brunhilda Quartz at bq@corp.example.com {r.choice(words)} " + " ".join(r.choices(words, k=10))
        elif i % 9 == 0:
            t += " ask someone else at home " + " ".join(r.choices(words, k=10))
        rows.append((i, t))
    copies = [(1000 + i, "unique Zebrafish mail to z@z.example.org here") for i in range(30)]
    return spark.createDataFrame(rows + copies + [(5000, None), (5001, "")], "doc_id bigint, text string")


def test_disclosure(spark):
    docs = corpus(spark)
    got = {r["term"]: r["disclosure"] for r in disclosing_terms(docs).collect()}
    assert {"brunhilda", "quartz"} <= set(got) and all(abs(got[t] - 1) < 1e-9 for t in ("brunhilda", "quartz"))
    assert "zebrafish" not in got  # thirty copies are one context
    assert "ask" not in got and not any(t.startswith("w") for t in got)


def test_planted_names(spark, tmp_path):
    """Precision and recall of the query on names planted beside values, among the documents of sf0.01."""
    r = random.Random(11)
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    words = [w for _, t in docs if t for w in t.split()[:30]]
    text = lambda n: " ".join(r.choices(words, k=n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["王小", "李五", "Bo", "4711", *("".join(r.choices(letters, k=7)).title() + "ov" for _ in range(36))]
    rows, truth = list(docs), set()
    next_id = 10_000_000

    def add(t):
        nonlocal next_id
        next_id += 1
        rows.append((next_id, t))

    for i, name in enumerate(names):
        mail = f"p{i}@corp{i}.example.com"
        for _ in range(r.randint(4, 12)):
            add(f"{text(30)} {name} {mail} {text(30)}")
        if i % 4 == 3:  # a name that many bear: it says nothing about one address
            for _ in range(60):
                add(f"{text(30)} {name} {text(30)}")
        else:
            truth.add(name.lower())
        if i % 5 == 0:  # known beside the value only from copies of one document
            t = f"{text(30)} decoy{i} {mail} {text(30)}"
            for _ in range(20):
                add(t)
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    texts = dict(rows)
    found = set()
    for x in op9_pii(spark, folder).filter("n_term > 0").select("doc_id", "spans").collect():
        for s in x["spans"].split(","):
            kind, a, b = s.split(":")
            if kind == "term":
                found.add(texts[x["doc_id"]][int(a) : int(b)].lower())
    precision, recall = len(found & truth) / max(1, len(found)), len(found & truth) / len(truth)
    print("precision", precision, "recall", recall, sorted(found - truth), sorted(truth - found))
    assert precision >= 0.9 and recall >= 0.9


def test_secrets():
    hidden = "908038b7daaf91e730d2f64001c52934d43"
    t = f'on token = "{hidden}" and api_key:{hidden} but not x = "{hidden}" nor token of {hidden}, password=short'
    assert [t[a:b] for _, a, b in find_secrets(t)] == [hidden, hidden]
    assert clean(t, {}).count("<SECRET>") == 2
    for long in ("=" * 300_000, "token=" * 50_000, ":" + "a" * 300_000):
        find_secrets(long)


def test_windows_are_whole_words():
    long = "x" * 900
    t = f"{long} a1 7 {long} a@b.c {long} 12 b2 " + " ".join(["z"] * 20)
    (span,) = find_base(t)
    assert _window(t, [span], span[1], span[2], 4) == [long, "a1", "7", long, long, "12", "b2", "z"]


def test_sanitised(spark):
    docs = corpus(spark).withColumn("terms", F.lit("clash")).withColumn("n_chars", F.lit(1))
    out = sanitised(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows[5000] is None and rows[5001] == ""
    for d, t in before.items():
        if t and "@" in t:
            assert "@" not in rows[d] and "<EMAIL>" in rows[d] and "Brunhilda" not in rows[d]
        else:
            assert rows[d] == t
    found = {r["doc_id"]: r for r in find_personal(docs).collect()}
    assert [s["kind"] for s in found[0]["term_spans"]] == ["term", "term"] and len(found[0]["base_spans"]) == 1
    assert find_personal(docs, lot=1).filter("doc_id = 0").first()["term_spans"] == found[0]["term_spans"]
    assert sanitised(docs.limit(0)).count() == 0 and find_personal(docs.limit(0)).count() == 0


def test_clean():
    assert clean("x Foo bar a@b.c +1 (017) 555-7713!", {"foo": 1.0, "bar": 0.92}) == "x  <TERM> <EMAIL> <PHONE>!"
    assert Rules().support == 3
