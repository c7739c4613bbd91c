import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import matroska as M
from tidemark.llm.queries_matroska import op10_matroska

SF = "/root/testdata/sf0.01"


def test_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_matroska(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        p = docs[r["doc_id"]]
        n = len(p)
        p += bytes(-n % 64 or (0 if n else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        media = M.mux_pcm(docs[r["doc_id"]])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([64, 100, 1024]), st.integers(1, 9), st.integers(1, 3))
def test_round_trip(data, frame, laced, blocks):
    m = M.parse(M.mux_pcm(data, frame, laced, blocks))
    assert m.payload(1) == M.padded(data) and int(m.tags["PAYLOAD_BYTES"]) == len(data) and m.doc_type == "matroska"
    assert len(m.cues) == m.clusters and {p.cluster for p in m.packets} == {c for _, _, c in m.cues}
    times = [p.timestamp_ns for p in m.packets]
    assert times == sorted(times)


def test_timestamps_and_seek():
    m = M.parse(M.mux_pcm(bytes(200_000)))
    assert [p.timestamp_ns for p in m.packets[:3]] == [0, 128_000_000, 256_000_000]
    late = m.from_time(10_000_000_000, 1)
    assert late[0].timestamp_ns <= 10_000_000_000 and late[0].cluster == m.cues[1][2] and len(late) < len(m.packets)
    assert m.tracks[1]["codec"] == "A_PCM/INT/LIT" and m.tracks[1]["bits"] == 8


def hand_made(lacing, body, group=False, unknown=False):
    block = b"\x81\x00\x05" + bytes([lacing << 1]) + body
    inner = M.number(M.TIMESTAMP, 7) + (M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block) + M.element(M.REFERENCE, b"\x01")) if group else M.element(M.SIMPLE_BLOCK, block))
    inner += M.element(0xEC, bytes(5))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + inner if unknown else M.element(M.CLUSTER, inner)
    segment = cluster + M.element(M.TAGS, b"")
    head = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm"))
    return head + (M.SEGMENT.to_bytes(4, "big") + b"\xff" + segment if unknown else M.element(M.SEGMENT, segment))


@pytest.mark.parametrize("unknown", [False, True])
@pytest.mark.parametrize("group", [False, True])
def test_lacing(group, unknown):
    cases = {
        0: (b"abc", [b"abc"]),
        1: (b"\x02\xff\x2d\x01" + b"x" * 300 + b"y" + b"zz", [b"x" * 300, b"y", b"zz"]),
        2: (b"\x02" + b"aabbcc", [b"aa", b"bb", b"cc"]),
        3: (b"\x03\x41\x2c\x5e\xd3\xc0" + b"x" * 300 + b"y" * 0, None),
    }
    # EBML lacing: 300, then a difference of -299 (two bytes), then +1 (one byte), rest.
    diff = (-299 + (1 << 13) - 1) | 1 << 14
    one = (1 + (1 << 6) - 1) | 1 << 7
    cases[3] = (b"\x03\x41\x2c" + diff.to_bytes(2, "big") + bytes([one]) + b"x" * 300 + b"y" + b"zz" + b"rest", [b"x" * 300, b"y", b"zz", b"rest"])
    for kind, (body, frames) in cases.items():
        data = hand_made(kind, body, group, unknown)
        m = M.parse(data)
        assert [data[p.offset : p.offset + p.size] for p in m.packets] == frames
        assert all(p.timestamp_ns == 12_000_000 and p.keyframe is False for p in m.packets)


def test_table_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 5000)], "doc_id bigint, text string").withColumn("media", F.lit("x"))
    media = M.media_column(df)
    rows = M.packet_table(media).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3} and all(r["error"] is None for r in rows)
    assert sum(r["size"] for r in rows if r["doc_id"] == 3) == 10_048
    bad = spark.createDataFrame([(1, None), (2, bytearray(M.mux_pcm(b"x" * 500)[:-30])), (3, bytearray(b"junk"))], "doc_id bigint, media binary")
    got = M.packet_table(bad).collect()
    assert [(r["doc_id"], r["error"] is not None, r["track"]) for r in got] == [(2, True, None), (3, True, None)]
    assert M.packet_table(media.limit(0)).count() == 0
