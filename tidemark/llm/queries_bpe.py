"""op3: every document through the streaming encoder and decoder."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.batches import sliced, table, texts_of
from tidemark.llm.bpe import StreamDecoder, StreamEncoder, Vocabulary, encode_parts

_loaded: dict[str, tuple[Vocabulary, dict]] = {}


def _vocabulary(path: str) -> tuple[Vocabulary, dict]:
    if path not in _loaded:
        _loaded[path] = (Vocabulary.load(path), {})
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; a null text is an empty one."""

    def run(batches):
        v, memo = _vocabulary(path)
        enc, dec = StreamEncoder(v, memo), StreamDecoder(v)
        for b in sliced(batches, 1):
            rows = []
            for text in texts_of(b, 1):
                n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encode_parts(enc, text):
                    n += len(ids) // 4
                    ids_sha.update(ids)
                    for part in decode_ids(dec, ids):
                        text_sha.update(part)
                text_sha.update(dec.finish().encode())
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
            n, a, t = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(t)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_ids(dec: StreamDecoder, ids: bytes):
    yield dec.push(memoryview(ids).cast("I")).encode()


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op3_bpe": op3_bpe}
