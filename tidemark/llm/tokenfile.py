"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file is a run of zstandard frames (each with its content checksum), each holding the ids of whole documents as
little-endian unsigned 32-bit integers, up to about ``FRAME_BYTES``; then two skippable frames:

* the document index: a zstandard frame of (doc_id i64, ids u64, frame u32, offset in frame in ids u64) columns;
* the seek table of the public "seekable" layout: per frame (compressed size, size, checksum) as u32, where the
  checksum is the low half of XXH64 of the uncompressed bytes; then frame count, a flag byte and the magic number.

A reader of some documents fetches the two tables and the frames these documents are in, and checks their sums.
Shards are in ascending doc_id order, across and inside files. A task writes a file of a name that no other attempt has
and returns it, so nothing is renamed, and a file that a lost attempt has left is in no list of shards.

Defined cases: null text: empty (the end id only); a null doc_id sorts first; repeated ids and rows stay, ordered by
text; a very long text is a frame of its own; an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced, texts_of
from tidemark.llm.encoding import Encoder
from tidemark.shared import shared_dir
from tidemark.sources.kvbin import filesystem

FRAME_BYTES = 1 << 18
# Fixed values of the seekable layout.
SKIP_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x8F92EAB1
_NULL_ID = -(1 << 63)


class TokenFileWriter:
    def __init__(self, out, level: int = 1, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.z = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.buf: list[bytes] = []
        self.size = 0
        self.docs: list[tuple[int, int, int, int]] = []
        self.ids = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.buf and self.size + len(ids) > self.frame_bytes:
            self._close()
        self.docs.append((doc_id, len(ids) // 4, len(self.frames), self.size // 4))
        self.buf.append(ids)
        self.size += len(ids)
        self.ids += len(ids) // 4

    def _close(self) -> None:
        raw = b"".join(self.buf)
        packed = self.z.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.buf, self.size = [], 0

    def finish(self) -> None:
        if self.buf:
            self._close()
        cols = list(zip(*self.docs, strict=True)) or [(), (), (), ()]
        raw = b"".join(np.array(c, t).tobytes() for c, t in zip(cols, ("<i8", "<u8", "<u4", "<u8"), strict=True))
        index = struct.pack("<Q", len(self.docs)) + self.z.compress(raw)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.out.write(struct.pack("<II", SKIP_MAGIC, len(table)) + table)


class TokenFile:
    """Random access to one file."""

    def __init__(self, stream: io.IOBase, size: int):
        self.f, self.z = stream, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        table = size - 9 - 12 * n - 8
        kind, length = struct.unpack("<II", self._at(table, 8))
        if kind != SKIP_MAGIC or length != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(self._at(table + 8, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != INDEX_MAGIC:
            raise ValueError("the document index is damaged")
        body = self._at(at + 8, length)
        docs = struct.unpack_from("<Q", body)[0]
        raw = self.z.decompress(body[8:], max_output_size=28 * docs + 1) if docs else b""
        self.doc_id, self.n, self.frame, self.offset = (np.frombuffer(raw, t, docs, o * docs) for t, o in (("<i8", 0), ("<u8", 8), ("<u4", 16), ("<u8", 20)))
        self._held: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        if len(got) != n:
            raise ValueError("the file is cut off")
        return got

    def read_frame(self, i: int) -> bytes:
        if self._held[0] != i:
            packed, size, check = map(int, self.frames[i])
            raw = self.z.decompress(self._at(int(self.starts[i]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i}: wrong checksum")
            self._held = (i, raw)
            self.frames_read += 1
        return self._held[1]

    def ids(self, row: int) -> bytes:
        """Ids of the document at a row of the index."""
        a = int(self.offset[row]) * 4
        return self.read_frame(int(self.frame[row]))[a : a + 4 * int(self.n[row])]

    def find(self, wanted: Sequence[int]) -> Iterator[tuple[int, bytes]]:
        """Documents by id; only their frames are read."""
        for d in wanted:
            a, b = np.searchsorted(self.doc_id, [d, d + 1])
            for row in range(int(a), int(b)):
                yield int(d), self.ids(row)


@dataclass(frozen=True)
class Shard:
    path: str
    first: int
    docs: int
    ids: int


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[Shard]:
    """Encode and write all documents; returns one small row per shard, in doc_id order.

    One exchange deals the texts by ranges of (doc_id, text hash), so equal ids of different texts may be parted; the
    encoding runs behind it, in the task that writes the file.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        enc, end = Encoder.of(tokenizer), int(end_id).to_bytes(4, "little")
        name = f"shard-{task:06d}-{uuid.uuid4().hex}.tzs"
        out = None
        for b in sliced(batches, 1):
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}")
                w = TokenFileWriter(out)
            for d, ids in zip(b.column(0).to_pylist(), enc.encode_all(texts_of(b, 1)), strict=True):
                w.add(_NULL_ID if d is None else d, ids + end)
        if out is not None:
            w.finish()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (task, len(w.docs), w.ids)] + [pa.array([name])], names=["task", "docs", "ids", "name"])

    src = docs.select(docs[id_col].cast("bigint").alias("d"), docs[text_col].alias("x"))
    order = [F.col("d").asc_nulls_first(), F.xxhash64("x")]
    dealt = (src.repartitionByRange(partitions, *order) if partitions else src.repartitionByRange(*order)).sortWithinPartitions(F.col("d").asc_nulls_first(), "x")
    shards, first = [], 0
    for r in sorted(dealt.mapInArrow(run, "task bigint, docs bigint, ids bigint, name string").collect(), key=lambda r: r["task"]):
        shards.append(Shard(f"{folder}/{r['name']}", first, r["docs"], r["ids"]))
        first += r["ids"]
    return shards


def read_token_files(spark, shards: Sequence[Shard], wanted: Sequence[int] | None = None, digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary), one task a shard; ``wanted`` picks ids.

    With ``digest``, a function of a document's id bytes, its number stands in for ``ids``, so that the ids themselves
    needn't leave the task.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, " + ("ids binary" if digest is None else "digest bigint")
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = filesystem(path)
                with fs.open_input_file(p) as f:
                    t = TokenFile(f, fs.get_file_info(p).size)
                    starts = first + np.concatenate([[0], np.cumsum(t.n, dtype=np.int64)])
                    rows = range(len(t.n)) if wanted is None else np.flatnonzero(np.isin(t.doc_id, np.array(wanted, np.int64))).tolist()
                    part: list[tuple] = []
                    held = 0
                    for i in rows:
                        ids = t.ids(i)
                        d = int(t.doc_id[i])
                        part.append((None if d == _NULL_ID else d, int(starts[i]), int(t.n[i]), ids if digest is None else digest(ids)))
                        held += len(ids)
                        if held > 4 << 20 or len(part) == 4096:
                            yield _table(part)
                            part, held = [], 0
                    if part:
                        yield _table(part)

    def _table(part):
        c = list(zip(*part, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary() if digest is None else pa.int64())], names=["doc_id", "start", "n_tokens", "ids" if digest is None else "digest"])

    where = spark.createDataFrame([(s.path, s.first) for s in shards], "path string, first bigint").repartition(len(shards))
    return where.mapInArrow(run, schema)


def token_folder(spark) -> str:
    return shared_dir(spark, "token-files")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
