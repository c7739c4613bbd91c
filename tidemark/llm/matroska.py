"""Matroska: a small muxer for 8-bit PCM and a parser that gives packet tables.

The parser reads variable-length EBML ids and sizes (unknown sizes of segments and clusters included), clusters,
SimpleBlocks and BlockGroups with all four kinds of lacing, and cues, into one row per frame: track, timestamp,
byte range in the file, key frame, cluster and block position. The payload never leaves the file: readers slice it by
the byte ranges.

``mux_pcm`` stores any bytes, padded to whole units of 64, as mono unsigned 8-bit samples at 8 kHz: frames of up to
1024 samples, up to 8 frames a block (equal frames: fixed-size lacing, else EBML lacing), up to 8 blocks a cluster.
Equal input gives equal files.

Defined cases of the DataFrame functions: a null text is an empty one (64 zero bytes); a null medium has no packets;
a damaged one, or one with numbers beyond 64 bits, gives one row with ``error`` set and nothing else; very long texts are
one file each; repeated rows and ids are files of their own; a null id stays null; an empty table gives no rows; further
columns, also of the result's names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.batches import sliced

# Element ids of the public specification.
EBML, EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TAGS, TAG, TARGETS, SIMPLE_TAG, TAG_NAME, TAG_STRING = 0x1254C367, 0x7373, 0x63C0, 0x67C8, 0x45A3, 0x4487
_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, 0x1941A469, 0x1043A770}

UNIT = 64
RATE = 8000
FRAME = 1024
LACED = 8
BLOCKS = 8


class Damaged(ValueError):
    pass


def _size(n: int, width: int = 0) -> bytes:
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def number(ident: int, n: int, width: int = 0) -> bytes:
    return element(ident, n.to_bytes(width or max(1, (n.bit_length() + 7) // 8), "big"))


def _block(track: int, rel: int, frames: list[bytes]) -> bytes:
    head = _size(track) + struct.pack(">h", rel)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        lacing, table = 0x04, b""
    else:
        lacing, table = 0x06, _size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            table += _size(d + (1 << 7 * w - 1) - 1, w)
    return element(SIMPLE_BLOCK, head + bytes([0x80 | lacing, len(frames) - 1]) + table + b"".join(frames))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def mux_pcm(data: bytes, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """``data``, padded, as one audio track; its own length is kept in a tag."""
    payload = padded(data)
    ms = lambda at: at * 1000 // RATE
    per_block, per_cluster = frame * laced, frame * laced * blocks
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", ms(len(payload)))) + element(MUXING_APP, b"tidemark") + element(WRITING_APP, b"tidemark"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + audio
    tracks = element(TRACKS, element(TRACK_ENTRY, entry))
    tags = element(TAGS, element(TAG, element(TARGETS, b"") + element(SIMPLE_TAG, element(TAG_NAME, b"PAYLOAD_BYTES") + element(TAG_STRING, str(len(data)).encode()))))
    seek = lambda cues: element(SEEK_HEAD, element(SEEK, element(SEEK_ID, CUES.to_bytes(4, "big")) + number(SEEK_POSITION, cues, 8)))
    at = len(seek(0)) + len(info) + len(tracks) + len(tags)
    parts, cues = [], []
    for c in range(0, len(payload), per_cluster):
        body = number(TIMESTAMP, ms(c))
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            stop = min(b + per_block, len(payload))
            body += _block(1, ms(b) - ms(c), [payload[i : min(i + frame, stop)] for i in range(b, stop, frame)])
        cues.append(element(CUE_POINT, number(CUE_TIME, ms(c)) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, body))
        at += len(parts[-1])
    body = b"".join([seek(at), info, tracks, tags, *parts, element(CUES, b"".join(cues))])
    return head + element(SEGMENT, body)


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int  # position of its cluster's element
    block: int  # position of its block's element


@dataclass
class Media:
    data: memoryview
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (timestamp, track, position of the cluster)
    packets: list[Packet] = field(default_factory=list)
    clusters: int = 0

    def payload(self, track: int) -> bytes:
        return b"".join([self.data[p.offset : p.offset + p.size] for p in self.packets if p.track == track])

    def from_time(self, ns: int, track: int) -> list[Packet]:
        """Packets of a track from the cluster that the cues name for a time."""
        start = max((pos for t, k, pos in self.cues if k == track and t * self.scale <= ns), default=0)
        return [p for p in self.packets if p.track == track and p.cluster >= start]


def _vint(d: memoryview, at: int, end: int, keep: bool) -> tuple[int, int, bool]:
    """Value, next position, and whether all value bits are 1 (an unknown size)."""
    if at >= end or not d[at]:
        raise Damaged(f"no variable-length integer at {at}")
    w = 9 - int(d[at]).bit_length()
    if at + w > end:
        raise Damaged(f"the integer at {at} is cut off")
    raw = int.from_bytes(d[at : at + w], "big")
    value = raw & ((1 << 7 * w) - 1)
    return (raw if keep else value), at + w, value == (1 << 7 * w) - 1


def elements(d: memoryview, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, position, body start, body end) of the elements in a range; an unknown size ends where its parent's level goes on."""
    while at < end:
        ident, p, _ = _vint(d, at, end, True)
        size, body, unknown = _vint(d, p, end, False)
        if unknown:
            if ident not in (SEGMENT, CLUSTER):
                raise Damaged(f"element at {at} has an unknown size")
            stop = end if ident == SEGMENT else _cluster_end(d, body, end)
        else:
            stop = body + size
        if stop > end:
            raise Damaged(f"the element at {at} is cut off")
        yield ident, at, body, stop
        at = stop


def _cluster_end(d: memoryview, at: int, end: int) -> int:
    while at < end:
        ident, p, _ = _vint(d, at, end, True)
        if ident in _TOP:
            return at
        size, body, _ = _vint(d, p, end, False)
        at = body + size
    return end


def _uint(d, a, b) -> int:
    return int.from_bytes(d[a:b], "big")


def _float(d, a, b) -> float:
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", d[a:b])[0]


def _text(d, a, b) -> str:
    return bytes(d[a:b]).rstrip(b"\0").decode("utf-8", "replace")


def _lace(d: memoryview, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes and the position of the first frame."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise Damaged(f"no lace count at {at}")
    n = d[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 2:  # fixed size
        if (end - at) % n:
            raise Damaged(f"the laced frames at {at} are not of one size")
        return [(end - at) // n] * n, at
    if kind == 1:  # Xiph: runs of 255
        for _ in range(n - 1):
            s = 0
            while True:
                if at >= end:
                    raise Damaged("a lace table is cut off")
                s += d[at]
                at += 1
                if d[at - 1] < 255:
                    break
            sizes.append(s)
    else:  # EBML: first size, then signed differences
        for i in range(n - 1):
            v, nxt, _ = _vint(d, at, end, False)
            sizes.append(v if not i else sizes[-1] + v - ((1 << 7 * (nxt - at) - 1) - 1))
            at = nxt
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"a lace table at {at} is wrong")
    return sizes, at


def parse(data) -> Media:
    """Everything above in one pass; raises ``Damaged``."""
    d = memoryview(data)
    m = Media(d)
    for ident, _, a, b in elements(d, 0, len(d)):
        if ident == EBML:
            m.doc_type = next((_text(d, x, y) for i, _, x, y in elements(d, a, b) if i == DOC_TYPE), "matroska")
        elif ident == SEGMENT:
            _segment(m, d, a, b)
    if not m.doc_type:
        raise Damaged("no EBML header")
    return m


def _segment(m: Media, d: memoryview, start: int, end: int) -> None:
    for ident, at, a, b in elements(d, start, end):
        if ident == INFO:
            for i, _, x, y in elements(d, a, b):
                if i == TIMESTAMP_SCALE:
                    m.scale = _uint(d, x, y)
                elif i == DURATION:
                    m.duration = _float(d, x, y)
        elif ident == TRACKS:
            for i, _, x, y in elements(d, a, b):
                if i == TRACK_ENTRY:
                    t = _track(d, x, y)
                    m.tracks[t["number"]] = t
        elif ident == CLUSTER:
            m.clusters += 1
            _cluster(m, d, at, a, b)
        elif ident == CUES:
            for i, _, x, y in elements(d, a, b):
                if i == CUE_POINT:
                    _cue(m, d, x, y, start)
        elif ident == TAGS:
            for i, _, x, y in elements(d, a, b):
                if i == TAG:
                    for j, _, u, v in elements(d, x, y):
                        if j == SIMPLE_TAG:
                            f = {k: _text(d, p, q) for k, _, p, q in elements(d, u, v)}
                            m.tags[f.get(TAG_NAME, "")] = f.get(TAG_STRING, "")


def _track(d, a, b) -> dict:
    t = {"number": 0, "type": 0, "codec": "", "frame_ns": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns"}
    for i, _, x, y in elements(d, a, b):
        if i in names:
            t[names[i]] = _uint(d, x, y)
        elif i == CODEC_ID:
            t["codec"] = _text(d, x, y)
        elif i == AUDIO:
            for j, _, u, v in elements(d, x, y):
                if j == SAMPLING:
                    t["rate"] = _float(d, u, v)
                elif j in (CHANNELS, BIT_DEPTH):
                    t["channels" if j == CHANNELS else "bits"] = _uint(d, u, v)
    return t


def _cue(m: Media, d, a, b, base: int) -> None:
    time = 0
    for i, _, x, y in elements(d, a, b):
        if i == CUE_TIME:
            time = _uint(d, x, y)
        elif i == CUE_POSITIONS:
            f = {j: _uint(d, u, v) for j, _, u, v in elements(d, x, y)}
            m.cues.append((time, f.get(CUE_TRACK, 0), base + f.get(CUE_CLUSTER, 0)))


def _cluster(m: Media, d, pos: int, a: int, b: int) -> None:
    time = 0
    for i, at, x, y in elements(d, a, b):
        if i == TIMESTAMP:
            time = _uint(d, x, y)
        elif i == SIMPLE_BLOCK:
            _frames(m, d, pos, at, x, y, time, None)
        elif i == BLOCK_GROUP:
            inner = list(elements(d, x, y))
            key = all(j != REFERENCE for j, *_ in inner)
            for j, _, u, v in inner:
                if j == BLOCK:
                    _frames(m, d, pos, at, u, v, time, key)


def _frames(m: Media, d, cluster: int, block: int, a: int, b: int, time: int, key: bool | None) -> None:
    track, at, _ = _vint(d, a, b, False)
    if at + 3 > b:
        raise Damaged(f"the block at {block} is cut off")
    rel, flags = struct.unpack(">hB", d[at : at + 3])
    sizes, at = _lace(d, at + 3, b, flags >> 1 & 3)
    step = m.tracks.get(track, {}).get("frame_ns", 0)
    begin = (time + rel) * m.scale
    for i, s in enumerate(sizes):
        m.packets.append(Packet(track, begin + i * step, at, s, bool(flags & 0x80) if key is None else key, cluster, block))
        at += s


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``media``, the text's bytes as a Matroska file."""

    def run(batches):
        for b in sliced(batches, 1, 1 << 20):
            media = [mux_pcm((t or "").encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, media binary")


PACKETS = "doc_id bigint, track bigint, timestamp_ns bigint, offset bigint, size bigint, keyframe boolean, cluster bigint, block bigint, error string"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of every file."""

    def run(batches):
        for b in sliced(batches, 1, 1 << 20):
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    packets = parse(data).packets
                    if any(not -(1 << 63) <= x < 1 << 63 for p in packets for x in (p.timestamp_ns, p.track)):
                        raise Damaged("a timestamp or track is beyond 64 bits")
                    rows += [(doc, p.track, p.timestamp_ns, p.offset, p.size, p.keyframe, p.cluster, p.block, None) for p in packets]
                except (Damaged, struct.error) as e:
                    rows.append((doc, None, None, None, None, None, None, None, str(e)))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:5]), pa.array(c[5], pa.bool_()), *(pa.array(x, pa.int64()) for x in c[6:8]), pa.array(c[8], pa.string())], names=[x.split()[0] for x in PACKETS.split(", ")])

    return media.select(media[id_col].cast("bigint").alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, PACKETS)
