"""op10: every document's bytes as a Matroska file, read back through its packet table."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.batches import sliced, table
from tidemark.llm.matroska import media_column, parse

_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(m, payload: bytes) -> str:
    """Duration, packets, clusters, and level, energy and sign changes of the samples, all as integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"ms={len(x) * 1000 // 8000};packets={len(m.packets)};clusters={m.clusters};cues={len(m.cues)};mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};turns={turns}"


def digest_media(media: DataFrame) -> DataFrame:
    """Digests and features of files, from their packets' byte ranges."""

    def run(batches):
        for b in sliced(batches, 1, 1 << 20):
            rows = []
            for data in b.column(1).to_pylist():
                m = parse(data)
                payload = m.payload(1)
                rows.append((int(m.tags["PAYLOAD_BYTES"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(m, payload)))
            c = list(zip(*rows, strict=True))
            ints = lambda v: pa.array(v, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), ints(c[0]), ints(c[1]), pa.array(c[2]), ints(c[3]), ints(c[4]), pa.array(c[5]), pa.array(c[6])], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return media.mapInArrow(run, _SCHEMA)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(media_column(table(spark, sf_dir, "documents")))


QUERIES = {"op10_matroska": op10_matroska}
