"""``kvbin``: files of ``[u64 key][u32 len][len bytes]``, little-endian, as a Spark data source.

Planning. A file of up to ``splitBytes`` is one split, so nothing of it is read beforehand. A larger file is cut at
record boundaries, found, in this order, from a side file ``<file>.idx`` (our writer leaves one), by arithmetic if
``fixedLen`` is given, or by walking its records. ``read_records`` walks in tasks, one for each such file, and hands the
cuts to the reader; only the plain ``spark.read.format("kvbin")`` walks on the driver. Cuts are never guessed from the
bytes in the middle of a file: payloads can look like headers. A side file holds the header that it found at each
mark; a split that doesn't start with it fails, as the file isn't the one that was indexed.

Modes. FAILFAST raises at the first malformed record. PREFIX keeps what stands before it and drops the rest of that
file. PERMISSIVE does the same and adds one row with ``corrupt`` set and the offset of the bad record. The latter two
don't trust side files or ``fixedLen``, as what is dropped depends on all that stands before.

Pruning. With ``payload=false`` payloads are skipped; ``minKey`` and ``maxKey`` (bounds of ``sort_key``, included) skip
records before their payload is copied. ``read_records(columns=...)`` sets the former by the columns asked for.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.unsigned import from_sort_key
from tidemark.schema import HEADER_BYTES, MAX_LEN, MIN_LEN
from tidemark.sources.parts import DataFile, PartWriter, data_files, filesystem, with_scheme

_FLIP = np.uint64(1 << 63)
_HEAD = struct.Struct("<QI")
_BLOCK = 8 << 20
_ROWS = 32768

_SCHEMA = pa.schema(
    [
        ("file_id", pa.int32()),
        ("offset", pa.int64()),
        ("sort_key", pa.int64()),
        ("len", pa.int32()),
        ("payload", pa.binary()),
        ("corrupt", pa.string()),
    ]
)
_DDL = "file_id int, offset bigint, sort_key bigint, len int, payload binary, corrupt string"


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int
    file_id: int = 0
    head: bytes = b""  # the header that a side file promises at the start


@dataclass
class Rules:
    mode: str = "FAILFAST"
    split_bytes: int = 128 << 20
    fixed_len: int = 0
    low: int = MIN_LEN
    high: int = MAX_LEN
    payload: bool = True
    low_key: int = -(1 << 63)
    high_key: int = (1 << 63) - 1

    @classmethod
    def of(cls, options) -> Rules:
        mode = options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "PREFIX", "PERMISSIVE"):
            raise ValueError(f"unknown mode {mode}")
        return cls(
            mode,
            int(options.get("splitBytes", 128 << 20)),
            int(options.get("fixedLen", 0)),
            int(options.get("minLen", MIN_LEN)),
            int(options.get("maxLen", MAX_LEN)),
            str(options.get("payload", "true")).lower() == "true",
            int(options.get("minKey", -(1 << 63))),
            int(options.get("maxKey", (1 << 63) - 1)),
        )

    @property
    def all_keys(self) -> bool:
        return self.low_key == -(1 << 63) and self.high_key == (1 << 63) - 1


def record_starts(stream, rules: Rules, every: int) -> tuple[list[int], list[bytes]]:
    """Offsets of records about ``every`` bytes apart and their headers, from a walk over all records, block by block;
    stops at a malformed one."""
    cuts, heads, at, rest = [0], [b""], 0, b""
    while True:
        got = stream.read(_BLOCK)
        block = rest + got
        starts, _, _, used, why = _parse(memoryview(block), rules)
        i = int(np.searchsorted(starts, cuts[-1] + every - at))
        while i < len(starts):
            a = int(starts[i])
            cuts.append(at + a)
            heads.append(block[a : a + HEADER_BYTES])
            i = int(np.searchsorted(starts, a + every))
        at += used
        rest = block[used:]
        if why or not got:
            return cuts, heads


_MARK = np.dtype([("at", "<u8"), ("head", f"V{HEADER_BYTES}")])


def side_file(size: int, cuts: Sequence[int], heads: Sequence[bytes]) -> bytes:
    """Content of a side file: the size of the data file, then offset and header of each mark."""
    marks = np.zeros(len(cuts), _MARK)
    marks["at"] = cuts
    marks["head"] = [np.void(h) for h in heads]
    return struct.pack("<Q", size) + marks.tobytes()


def _side_cuts(fs: pafs.FileSystem, file: DataFile, every: int) -> tuple[list[int], list[bytes]] | None:
    """Cuts from a file's side file, if there is one for a file of this size."""
    if fs.get_file_info(file.path + ".idx").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(file.path + ".idx") as f:
        raw = f.read()
    if len(raw) < 8 or (len(raw) - 8) % _MARK.itemsize or struct.unpack_from("<Q", raw)[0] != file.size:
        return None
    cuts, heads = [0], [b""]
    for at, head in np.frombuffer(raw, _MARK, offset=8).tolist():
        if at - cuts[-1] >= every:
            cuts.append(at)
            heads.append(bytes(head))
    return cuts, heads


def _cuts(fs: pafs.FileSystem, file: DataFile, rules: Rules) -> tuple[list[int], list[bytes]] | None:
    """Where to cut a file, as far as that is known without walking it."""
    if file.size <= rules.split_bytes:
        return [0], [b""]
    if rules.mode == "FAILFAST":
        if side := _side_cuts(fs, file, rules.split_bytes):
            return side
        if rules.fixed_len:
            step = HEADER_BYTES + rules.fixed_len
            cuts = list(range(0, file.size, max(1, rules.split_bytes // step) * step))
            return cuts, [b""] * len(cuts)
    return None


def _parse(block: memoryview, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, str]:
    """Whole records of a block: starts, keys, lengths, bytes used, and what is wrong with the next one, if anything."""
    size = len(block)
    if size >= HEADER_BYTES:
        n = _HEAD.unpack_from(block, 0)[1]
        step = HEADER_BYTES + n
        if rules.low <= n <= rules.high and size >= step:
            # All lengths as the first one's: no loop over records.
            rows = np.frombuffer(block, np.uint8, count=size // step * step).reshape(-1, step)
            lens = rows[:, 8:12].copy().view("<u4").ravel()
            same = int(np.argmax(lens != n)) if (lens != n).any() else len(lens)
            if same == len(lens) or same > 1024:
                rows = rows[:same]
                keys = rows[:, :8].copy().view("<u8").ravel()
                return np.arange(same, dtype=np.int64) * step, keys, np.full(same, n, np.int32), same * step, ""
    starts, at, why = [], 0, ""
    unpack = _HEAD.unpack_from
    keys, lens = [], []
    while at + HEADER_BYTES <= size:
        k, n = unpack(block, at)
        if not rules.low <= n <= rules.high:
            why = f"length {n} at {{}} is outside [{rules.low}, {rules.high}]"
            break
        if at + HEADER_BYTES + n > size:
            break
        starts.append(at)
        keys.append(k)
        lens.append(n)
        at += HEADER_BYTES + n
    return np.array(starts, np.int64), np.array(keys, np.uint64), np.array(lens, np.int32), at, why


def _batches(split: Split, rules: Rules) -> Iterator[pa.RecordBatch]:
    fs, path = filesystem(split.file)
    with fs.open_input_file(path) as f:
        f.seek(split.start)
        at, rest = split.start, b""
        while at < split.end:
            got = f.read(min(_BLOCK, split.end - at - len(rest)))
            block = rest + got
            if at == split.start and split.head and not block.startswith(split.head):
                raise ValueError(f"{split.file}: its side file belongs to another content (at {at})")
            starts, keys, lens, used, why = _parse(memoryview(block), rules)
            for i in range(0, len(starts), _ROWS):
                yield from _batch(split.file_id, block, at, starts[i : i + _ROWS], keys[i : i + _ROWS], lens[i : i + _ROWS], rules)
            at += used
            rest = block[used:]
            if not used and not why and not got:
                why = "the record at {} is cut off"
            if why:
                if rules.mode == "FAILFAST":
                    raise ValueError(f"{split.file}: {why.format(at)}")
                if rules.mode == "PERMISSIVE":
                    row = {"file_id": [split.file_id], "offset": [at], "sort_key": [None], "len": [None], "payload": [None], "corrupt": [why.format(at)]}
                    yield pa.RecordBatch.from_pydict(row, schema=_SCHEMA)
                return


def _batch(file_id: int, block: bytes, base: int, starts: np.ndarray, keys: np.ndarray, lens: np.ndarray, rules: Rules) -> Iterator[pa.RecordBatch]:
    signed = (keys ^ _FLIP).view(np.int64)
    if not rules.all_keys:
        some = (signed >= rules.low_key) & (signed <= rules.high_key)
        starts, lens, signed = starts[some], lens[some], signed[some]
    n = len(starts)
    if not n:
        return
    payload = pa.nulls(n, pa.binary())
    if rules.payload:
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(lens, out=offsets[1:])
        data = np.frombuffer(block, np.uint8)
        begin, end = int(starts[0]), int(starts[-1]) + HEADER_BYTES + int(lens[-1])
        if int(offsets[-1]) + n * HEADER_BYTES == end - begin:
            keep = np.ones(end - begin, bool)
            heads = (starts - begin)[:, None] + np.arange(HEADER_BYTES)
            keep[heads.ravel()] = False
            data = data[begin:end][keep]
        else:
            data = np.concatenate([data[a + HEADER_BYTES : a + HEADER_BYTES + m] for a, m in zip(starts.tolist(), lens.tolist(), strict=True)])
        payload = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    yield pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(file_id, pa.int32()), n), pa.array(starts + base), pa.array(signed), pa.array(lens), payload, pa.nulls(n, pa.string())],
        schema=_SCHEMA,
    )


class KvReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rules = options["path"], Rules.of(options)
        self.known = json.loads(options.get("cuts", "{}"))

    def partitions(self):
        fs, path = filesystem(self.path)
        out = []
        for i, f in enumerate(data_files(fs, path)):
            if not f.size:
                continue
            if f.path in self.known:
                cuts = self.known[f.path]
                heads = [b""] * len(cuts)
            elif (found := _cuts(fs, f, self.rules)) is not None:
                cuts, heads = found
            else:
                with fs.open_input_stream(f.path) as stream:
                    cuts, heads = record_starts(stream, self.rules, self.rules.split_bytes)
            out += [Split(with_scheme(self.path, path, f.path), a, b, i, h) for a, b, h in zip(cuts, [*cuts[1:], f.size], heads, strict=True)]
        return out or [Split("", 0, 0)]

    def read(self, partition):
        if partition.end > partition.start:
            yield from _batches(partition, self.rules)


def encode(batch: pa.RecordBatch, low: int = MIN_LEN, high: int = MAX_LEN) -> tuple[memoryview, np.ndarray]:
    """The bytes of a batch with ``sort_key`` and ``payload``, and each record's size. Raises on an illegal length."""
    keys = batch.column("sort_key").to_numpy(zero_copy_only=False).view(np.uint64) ^ _FLIP
    col = batch.column("payload")
    if col.null_count:
        raise ValueError("a payload is null")
    col = col if pa.types.is_binary(col.type) else col.cast(pa.binary())
    n = len(col)
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    lens = np.diff(ends)
    if n and (lens.min() < low or lens.max() > high):
        raise ValueError(f"payload length outside [{low}, {high}]")
    heads = np.empty((n, HEADER_BYTES), np.uint8)
    heads[:, :8] = keys.astype("<u8").view(np.uint8).reshape(n, 8)
    heads[:, 8:] = lens.astype("<u4").view(np.uint8).reshape(n, 4)
    data = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]] if n else np.zeros(0, np.uint8)
    sizes = lens + HEADER_BYTES
    if n and (lens == lens[0]).all():
        return np.concatenate([heads, data.reshape(n, -1)], axis=1).ravel().data, sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    at = (np.cumsum(sizes) - sizes)[:, None] + np.arange(HEADER_BYTES)
    body = np.ones(len(out), bool)
    body[at.ravel()] = False
    out[at.ravel()] = heads.ravel()
    out[body] = data
    return out.data, sizes


class KvWriter(PartWriter):
    """Part files of records (see ``parts``), with a side file where one is larger than ``splitBytes``."""

    suffix = ".kv"

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.rules = Rules.of(options)
        self.side = str(options.get("sideFiles", "true")).lower() == "true"

    def write_stream(self, out, batches):
        rows, at, last, cuts, heads = 0, 0, 0, [], []
        for batch in batches:
            data, sizes = encode(batch, self.rules.low, self.rules.high)
            out.write(data)
            starts = np.cumsum(sizes) - sizes
            i = int(np.searchsorted(starts, last + self.rules.split_bytes - at))
            while i < len(starts):
                a = int(starts[i])
                last = at + a
                cuts.append(last)
                heads.append(bytes(data[a : a + HEADER_BYTES]))
                i = int(np.searchsorted(starts, a + self.rules.split_bytes))
            at += len(data)
            rows += len(sizes)
        return at, rows, side_file(at, cuts, heads) if cuts and self.side else b""


class KvBin(DataSource):
    @classmethod
    def name(cls):
        return "kvbin"

    def schema(self):
        return _DDL

    def reader(self, schema):
        return KvReader(self.options)

    def writer(self, schema, overwrite):
        return KvWriter(self.options, overwrite)


def unindexed(path: str, rules: Rules) -> list[DataFile]:
    """Files that must be walked before they can be split."""
    fs, p = filesystem(path)
    return [f for f in data_files(fs, p) if f.size and _cuts(fs, f, rules) is None]


def walk_files(spark: SparkSession, path: str, files: Sequence[DataFile], rules: Rules, store: bool = False) -> dict[str, list[int]]:
    """Cuts of each file, found by one task a file; ``store`` leaves them in side files."""
    _, inside = filesystem(path)

    def run(batches):
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = filesystem(with_scheme(path, inside, name))
                with fs.open_input_stream(p) as stream:
                    cuts, heads = record_starts(stream, rules, rules.split_bytes)
                if store:
                    with fs.open_output_stream(p + ".idx") as f:
                        f.write(side_file(size, cuts[1:], heads[1:]))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([cuts], pa.list_(pa.int64()))], names=["file", "cuts"])

    listed = spark.createDataFrame([(f.path, f.size) for f in files], "file string, size bigint").repartition(len(files))
    return {r["file"]: r["cuts"] for r in listed.mapInArrow(run, "file string, cuts array<bigint>").collect()}


def index_files(spark: SparkSession, path: str, **options) -> int:
    """Leave a side file beside each data file that has none and is larger than ``splitBytes``; returns how many."""
    rules = Rules.of(options)
    files = unindexed(path, rules)
    if files:
        walk_files(spark, path, files, rules, store=True)
    return len(files)


def read_records(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Records of a file or folder, with their file's number in name order and their offset (the natural tie-breaker).

    ``columns`` picks among file_id, offset, sort_key, key, len, payload and corrupt; payloads are only read if asked for.
    """
    spark.dataSource.register(KvBin)
    if columns is not None and "payload" not in columns:
        options["payload"] = "false"
    rules = Rules.of(options)
    if "cuts" not in options and (files := unindexed(path, rules)):
        options["cuts"] = json.dumps(walk_files(spark, path, files, rules))
    df = spark.read.format("kvbin").options(path=path, **options).load()
    df = df.withColumn("key", from_sort_key(F.col("sort_key")))
    return df if columns is None else df.select(*columns)


def write_records(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Write ``sort_key`` and ``payload`` in partition order; ``append`` adds files behind those that are there."""
    df.sparkSession.dataSource.register(KvBin)
    df.select("sort_key", "payload").write.format("kvbin").mode(mode).options(path=path, **options).save()
