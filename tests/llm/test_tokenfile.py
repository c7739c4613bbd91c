import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from test_packing import ODD, SF, library

from tidemark.llm.queries_tokenfile import op6_token_files
from tidemark.llm.tokenfile import TokenFile, TokenFileWriter, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, at = {}, 0
    for (d, _), ids in zip(docs, library(PATH, [t for _, t in docs]), strict=True):
        want[d] = (at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        at += len(ids) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op6_token_files(spark, SF).collect()} == want


def test_cases(spark, tmp_path):
    rows = [(3, None), (1, "b"), (1, "a"), (None, "n"), *[(10 + i, t) for i, t in enumerate(ODD)], (2, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("d", F.lit(0)).withColumn("x", F.lit(0))
    shards = write_token_files(df, str(tmp_path / "t"), PATH, 0, partitions=3)
    got = read_token_files(spark, shards).orderBy("start").collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r["doc_id"] for r in got] == [d for d, _ in order]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [x + [0] for x in library(PATH, [t for _, t in order])]
    some = read_token_files(spark, shards, wanted=[1, 2]).collect()
    assert sorted(r["doc_id"] for r in some) == [1, 1, 2]
    assert not list((tmp_path / "t").glob(".*-*"))
    empty = write_token_files(df.limit(0), str(tmp_path / "e"), PATH, 0)
    assert read_token_files(spark, empty).count() == 0


def test_format():
    out = io.BytesIO()
    w = TokenFileWriter(out, frame_bytes=4000)
    docs = {i: np.arange(i, dtype="<u4").tobytes() for i in range(200)}
    for d, ids in docs.items():
        w.add(d, ids)
    w.finish()
    data = out.getvalue()
    # Any zstandard reader gets all ids, and skips the tables.
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(docs.values())
    t = TokenFile(io.BytesIO(data), len(data))
    assert dict(t.find([7, 150])) == {7: docs[7], 150: docs[150]} and t.frames_read == 2 < len(t.frames)
    broken = bytearray(data)
    broken[40] ^= 1
    with pytest.raises(Exception):
        list(TokenFile(io.BytesIO(bytes(broken)), len(broken)).find([20]))
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(data[:-1]), len(data) - 1)
