import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_packing import ODD, SF, library
from tokenizers import Tokenizer

from tidemark.llm.bpe import StreamDecoder, StreamEncoder, Transducer, Vocabulary
from tidemark.llm.queries_bpe import encode_decode, op3_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
V = Vocabulary.load(PATH)
LIB = Tokenizer.from_file(PATH)


def ids_of(x):
    return np.frombuffer(x, "<u4").tolist()


def want(text):
    ids = library(PATH, [text])[0]
    raw = LIB.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw.encode()).hexdigest()


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op3_bpe(spark, SF).collect()}
    assert got == {r["doc_id"]: want(r["text"] or "") for r in docs}


def test_cases(spark):
    texts = [None, *ODD, "a" * 300_000, " " * 200_000 + "b", "ab " * 100_000, "!?" * 100_000 + "'s", "<|endoftext|>" * 20_000, "日本" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_tokens", F.lit(1)).repartition(4)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_decode(df, PATH).collect()}
    assert got == {i: want(t or "") for i, t in enumerate(texts)}
    assert encode_decode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_stream_equals_whole(seed):
    r = random.Random(seed)
    units = ["a", "b", "e", " ", "  ", "\n", "1", "2", "!", "'", "'s", "'ll", "<", "|", "<|endoftext|>", "<|endof", "é", "日", "the", " of", "\xa0", "́", "=" * 20, "\t"]
    for _ in range(300):
        few = r.sample(units, r.randint(1, 8))
        text = "".join(r.choices(few, k=r.randint(0, 400)))
        enc = StreamEncoder(V, {}, hold=r.choice([20, 40, 64]))
        out, at = b"", 0
        while at < len(text):
            n = r.randint(1, 60)
            out += enc.push(text[at : at + n])
            at += n
        out += enc.finish()
        assert ids_of(out) == library(PATH, [text])[0], repr(text)
        assert len(enc.text) == 0 and not enc.open


def test_transducer_is_stable_and_bounded():
    r = random.Random(5)
    pieces = sorted(V.tokens.values(), key=len)[-3000:]
    for _ in range(20):
        word = b"".join(r.choice(pieces) for _ in range(600)) if r.random() < 0.5 else bytes(r.choice(b"abcdest") for _ in range(20_000))
        t, out = Transducer(V), []
        for i in range(0, len(word), 777):
            out += t.push(word[i : i + 777])
            assert len(t.buf) <= t.window
        out += t.flush()
        assert out == t.merge(word)


def test_lookahead_of_small_lists():
    """Brute force: boundaries up to |x| - L never change, for all short texts over two letters."""
    import itertools

    r = random.Random(1)
    for _ in range(25):
        tokens, ranks = {0: b"a", 1: b"b"}, {}
        for _ in range(6):
            x, y = r.choice(list(tokens)), r.choice(list(tokens))
            if (x, y) not in ranks and tokens[x] + tokens[y] not in tokens.values():
                ranks[x, y] = (len(ranks), len(tokens))
                tokens[len(tokens)] = tokens[x] + tokens[y]
        ids = [0] * 256
        ids[ord("b")] = 1
        from tidemark.llm import bpe

        v = Vocabulary(tokens, ranks, ids, {}, 1)
        v.byte_ids = [0, 1]
        look = bpe.sufficient_lookahead(v)
        v.byte_ids = ids
        t = Transducer(v)

        def ends(w, t=t, v=v):
            return set(np.cumsum([len(v.tokens[i]) for i in t.merge(w)]).tolist())

        for n in range(1, 11):
            for w in map(bytes, itertools.product(b"ab", repeat=n)):
                whole = ends(w)
                for k in range(1, n):
                    stable = k - look
                    assert {e for e in ends(w[:k]) if e <= stable} == {e for e in whole if e <= stable}


def test_decoder():
    data = "a€😀é".encode() + b"\xff\xf0\x9f\x98 x\xe2\x82"
    v = Vocabulary({i: bytes([i]) for i in range(256)}, {}, list(range(256)), {}, 1)
    d = StreamDecoder(v)
    assert "".join(d.push([b]) for b in data) + d.finish() == data.decode("utf-8", "replace")
