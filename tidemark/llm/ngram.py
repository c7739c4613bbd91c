"""Language-model scores from an Elias-Fano n-gram trie in memory-mapped shards.

**Model.** Tokens are words (A-Z lowered, split at ASCII blanks) and one end per text. With counts c, N tokens and V
distinct ones in the training texts, and D = n1 / (n1 + 2 n2) from the numbers of words seen once and twice,

    P(w) = (c(w) - D) / N for known words,  D V / N for the unknown word,
    P(w | h) = (c(h, w) + mu P(w)) / (c(h) + mu),

which add up to one over the V + 1 words after every h (a text's first word follows a start). The logarithms of seen
pairs are quantised to 2^bits values per shard and stored with the pairs in the trie; unseen pairs are backed off.

**Counting and scoring in one pass.** (1) Words are counted by 64-bit hash and written, in shards by hash range, as
Elias-Fano sequences with their counts; a word's id is its place. Tasks map these files. (2) Each task reads its
texts once, looks the words up, and sends each shard of the pair space the pairs of all its texts, sorted, in one
compact block per slice of texts. The shard of a pair is a hash of both words, so a frequent word is spread over all
shards. (3) A shard counts its training pairs, writes and maps its trie, searches all its pairs in it (sorted,
context by context), and answers each slice with one block of sums per text. (4) The sums of a slice meet.

Nothing but per-shard numbers reaches the driver. All counts cover all training texts; there are no cut-offs.

Defined cases: very long texts are read whole; null texts count as empty (only the end token); a null id counts as an empty id text; repeated rows are
texts of their own; with no training text every word is unknown and scores zero; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced
from tidemark.llm.elias_fano import EliasFano, Trie, dump, view
from tidemark.shared import ensure_checkpoint_dir, shared_dir
from tidemark.sources.kvbin import filesystem

U64 = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: No word holds a blank, so this is none.
END = b"\n"
#: Vocabulary shards that a task holds open.
OPEN = 64


@dataclass(frozen=True)
class Settings:
    mu: float = 100.0
    bits: int = 12
    slice_bytes: int = 6 << 20
    vocabulary_shard: int = 1 << 20
    pair_shard: int = 3_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), U64, len(words))


def write_file(path: str, data: bytes) -> str:
    """Under a name that no other attempt has, which is returned: nothing is renamed or replaced."""
    path = f"{path}-{uuid.uuid4().hex}"
    fs, p = filesystem(path)
    with fs.open_output_stream(p) as f:
        f.write(data)
    return path


def map_file(path: str) -> dict[str, np.ndarray]:
    """Mapped arrays of a file. From a store without local paths it is read into memory; nothing is left on local disks."""
    fs, p = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return view(np.memmap(p, np.uint8, "r"))
    with fs.open_input_stream(p) as f:
        return view(f.read())


@dataclass
class Vocabulary:
    """Level 1: mapped shards by the top bits of the hash."""

    paths: list[str | None]
    bases: np.ndarray  # first id of each shard, and V
    bits: int
    n: int  # training tokens
    texts: int  # training texts
    once: int
    twice: int

    def __post_init__(self):
        self._open: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}  # mapped files don't travel

    @property
    def v(self) -> int:
        return int(self.bases[-1])

    def shard(self, s: int) -> tuple[EliasFano, np.ndarray]:
        if s not in self._open:
            while len(self._open) >= OPEN:  # lookups come in the order of shards, so the oldest isn't asked for soon
                self._open.pop(next(iter(self._open)))
            a = map_file(self.paths[s])
            self._open[s] = (EliasFano.of({k[2:]: x for k, x in a.items() if k.startswith("h.")}), a["counts"])
        return self._open[s]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (V + 1: unknown) and counts."""
        ids, counts = np.full(len(hashes), self.v + 1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        sorted_ = hashes[order]
        tops = (sorted_ >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for s in np.unique(tops):
            if self.paths[s] is None:
                continue
            a, b = np.searchsorted(tops, [s, s + 1])
            ef, c = self.shard(int(s))
            at = ef.next_geq(sorted_[a:b])
            ok = at < ef.n
            ok[ok] = ef.access(at[ok]) == sorted_[a:b][ok]
            to = order[a:b][ok]
            ids[to] = at[ok] + self.bases[s]
            counts[to] = c[at[ok]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids; 0 for the unknown word, the number of texts for the start (id V)."""
        out = np.where(ids == self.v, self.texts, 0).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        cut = np.searchsorted(ids[order], self.bases)
        for s, path in enumerate(self.paths):
            if path is not None and cut[s + 1] > cut[s]:
                to = order[cut[s] : cut[s + 1]]
                out[to] = self.shard(s)[1][ids[to] - self.bases[s]]
        return out

    def p1(self, ids: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(ids))
        d = self.once / (self.once + 2 * self.twice) if self.once else 0.5
        d = min(max(d, 0.05), 0.95)
        return np.where(ids < self.v, (self.counts(ids) - d) / self.n, d * self.v / self.n)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))


def build_vocabulary(docs: DataFrame, folder: str, s: Settings) -> Vocabulary:
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def count(batches):
        seen: Counter = Counter()
        texts = 0

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(_hashes(seen).view(np.int64)), pa.array(seen.values(), pa.int64())], names=["h", "n"])
            seen.clear()
            return rows

        for b in sliced(batches, 1):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not held_out(d):
                    seen.update(words_of(t))
                    texts += 1
            if len(seen) > 400_000:
                yield out()
        if texts:
            seen[END] = texts
        if seen:
            yield out()

    counted = docs.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).checkpoint()
    end = int(_hashes([END]).view(np.int64)[0])
    t = counted.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.max(F.when(F.col("h") == end, F.col("n"))).alias("texts")).first()
    bits = max(0, (max(1, t["v"]) // s.vocabulary_shard).bit_length())
    shards = 1 << bits
    place = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def write(batches):
        got: dict[int, list] = {}
        for b in batches:
            h, n, p = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            for i in np.unique(p):
                got.setdefault(int(i), []).append((h[p == i], n[p == i]))
        for i, parts in sorted(got.items()):
            h = np.concatenate([x for x, _ in parts]).view(U64)
            n = np.concatenate([x for _, x in parts])
            order = np.argsort(h)
            kind = np.uint32 if n.max() < 1 << 32 else np.uint64
            path = write_file(f"{folder}/words-{i:06d}", dump({f"h.{k}": v for k, v in EliasFano.build(h[order]).arrays().items()} | {"counts": n[order].astype(kind)}))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([path])], names=["shard", "v", "path"])

    written = {r["shard"]: r for r in counted.select("h", "n", place.alias("p")).repartitionById(shards, F.col("p")).mapInArrow(write, "shard bigint, v bigint, path string").collect()}
    paths = [written[i]["path"] if i in written else None for i in range(shards)]
    bases = np.concatenate([[0], np.cumsum([written[i]["v"] if i in written else 0 for i in range(shards)], dtype=np.int64)])
    return Vocabulary(paths, bases, bits, t["n"] or 0, t["texts"] or 0, t["one"] or 0, t["two"] or 0)


def pair_shard(h: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    x = h.astype(U64) * U64(0x9E3779B97F4A7C15) ^ w.astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    return ((x >> U64(32)) % U64(shards)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def encode_pairs(h: np.ndarray, w: np.ndarray, doc: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """Pairs sorted by (h, w): steps of h, then w and the text's place, as byte planes."""
    wide = "<u4" if not len(h) or max(int(h[-1]), int(w.max())) < 1 << 32 else "<u8"
    step = np.diff(h, prepend=0).astype(wide)
    raw = _planes(step) + _planes(w.astype(wide)) + _planes(doc.astype("<u4"))
    return len(h).to_bytes(4, "little") + wide[2:].encode() + z.compress(raw)


def decode_pairs(data: bytes, z: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, wide = int.from_bytes(data[:4], "little"), f"<u{data[4:5].decode()}"
    size = np.dtype(wide).itemsize
    raw = z.decompress(data[5:], max_output_size=n * (2 * size + 4) + 1)
    h = np.cumsum(_unplanes(raw, wide, n), dtype=np.int64)
    return h, _unplanes(raw[n * size :], wide, n).astype(np.int64), _unplanes(raw[2 * n * size :], "<u4", n)


_ROWS = "shard int, slice bigint, kind int, data binary"


def _row(shard: int, slice_: int, kind: int, data: bytes) -> tuple:
    return shard, slice_, kind, data


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], names=["shard", "slice", "kind", "data"])


def _texts(docs: DataFrame, voc: Vocabulary, shards: int, s: Settings) -> DataFrame:
    """Per slice of texts: a block of pairs for each shard, and one of what is known of each text."""

    def run(batches):
        from pyspark import TaskContext

        task, z = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        for number, b in enumerate(sliced(batches, 1, s.slice_bytes)):
            slice_ = (task << 24) | number
            texts = [words_of(t) for t in b.column(1).to_pylist()]
            for t in texts:
                t.append(END)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            tokens = [w for t in texts for w in t]
            del texts
            place = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
            code = np.fromiter(map(place.__getitem__, tokens), np.int32, len(tokens))
            ids, counts = voc.lookup(_hashes(list(place)))
            del tokens, place
            base = voc.base(counts)[code]
            known = (counts > 0)[code]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids_of = b.column(0).to_pylist()
            held = np.array([held_out(d) for d in ids_of])
            info = dump({
                "doc_id": np.array([0 if d is None else d for d in ids_of], np.int64),
                "null": np.array([d is None for d in ids_of], np.uint8),
                "held": held.astype(np.uint8),
                "n": sizes,
                "known": np.add.reduceat(known.astype(np.int64), first),
                "base": np.add.reduceat(base, first),
            })
            w = ids[code]
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[first] = voc.v
            # The lowest bit says whether a text may teach.
            doc = np.repeat(np.arange(len(sizes)) * 2 + ~held, sizes)
            order = np.lexsort((w, h)) if voc.v >= (1 << 31) else np.argsort(h * (voc.v + 2) + w, kind="stable")
            h, w, doc = h[order], w[order], doc[order]
            to = pair_shard(h, w, shards)
            order = np.argsort(to.astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")
            cut = np.searchsorted(to[order], np.arange(shards + 1))
            out = [_row(number % shards, slice_, 1, info)]
            for i in np.flatnonzero(np.diff(cut)):
                pick = order[cut[i] : cut[i + 1]]
                out.append(_row(int(i), slice_, 0, encode_pairs(h[pick], w[pick], doc[pick], z)))
            yield _rows(out)

    return docs.mapInArrow(run, _ROWS)


def quantise(x: np.ndarray, weight: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their values: up to 2^bits bins of about equal weight (how often a number is used), each standing for
    its mean; so what is used often is kept finely."""
    levels, back = np.unique(x, return_inverse=True)
    if len(levels) <= 1 << bits:
        return back, levels
    n = np.bincount(back, weight, len(levels))
    bin_ = np.minimum(((np.cumsum(n) - n / 2) * (1 << bits) / n.sum()).astype(np.int64), (1 << bits) - 1)
    book = np.bincount(bin_, levels * n, 1 << bits) / np.maximum(1e-300, np.bincount(bin_, n, 1 << bits))
    return bin_[back], book


def shard_trie(h: np.ndarray, w: np.ndarray, c: np.ndarray, voc: Vocabulary, s: Settings) -> dict[str, np.ndarray]:
    """File image of the trie over distinct sorted training pairs with their counts."""
    p = np.log10((c + s.mu * voc.p1(w)) / (voc.counts(h) + s.mu))
    codes, book = quantise(p, c, s.bits)
    return Trie.build(np.column_stack([h, w]), [None, codes], s.bits).arrays() | {"book": book}


def pair_scores(h: np.ndarray, w: np.ndarray, arrays: dict[str, np.ndarray], voc: Vocabulary, s: Settings) -> np.ndarray:
    """log10 P(w | h) of sorted pairs: the stored value, or the back-off."""
    trie = Trie.of(arrays)
    node = trie.find(np.column_stack([h, w]))
    out = np.empty(len(h))
    seen = node >= 0
    out[seen] = arrays["book"][trie.code(1, node[seen]).astype(np.int64)]
    away = ~seen
    out[away] = np.log10(s.mu * voc.p1(w[away]) / (voc.counts(h[away]) + s.mu))
    return out


def _answer(blocks: list[tuple[int, bytes]], path: str, voc: Vocabulary, s: Settings) -> list[tuple[int, bytes]]:
    """Sums per text of each slice, from one shard's pairs."""
    z = zstandard.ZstdDecompressor()
    parts = [decode_pairs(data, z) for _, data in blocks]
    h, w, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
    del parts
    order = np.lexsort((w, h)) if voc.v >= (1 << 31) else np.argsort(h * (voc.v + 2) + w, kind="stable")
    h, w, doc, owner = h[order], w[order], doc[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
    taught = np.add.reduceat((doc & 1).astype(np.int64), start)
    n = np.diff(np.append(start, len(h)))
    h, w = h[start], w[start]
    learn = taught > 0
    path = write_file(path, dump(shard_trie(h[learn], w[learn], taught[learn], voc, s)))
    score = np.repeat(pair_scores(h, w, map_file(path), voc, s), n)
    text = (doc >> 1).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(blocks) + 1))
    out = []
    for i, (slice_, _) in enumerate(blocks):
        pick = order[cut[i] : cut[i + 1]]
        sums = np.bincount(text[pick], score[pick])
        some = np.flatnonzero(sums)
        out.append((slice_, dump({"at": some.astype(np.uint32), "sum": sums[some]})))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = shared_dir(spark, "ngram")
    docs = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t"))
    voc = build_vocabulary(docs, folder, s)
    shards = max(1, -(-int(voc.n * 10 / 9) // s.pair_shard))

    def answer(batches):
        got: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            through = []
            for shard, slice_, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 1:
                    through.append(_row(shard, slice_, 1, data))
                else:
                    got.setdefault(shard, []).append((slice_, data))
            if through:
                yield _rows(through)
        while got:
            shard, blocks = got.popitem()
            yield _rows([_row(shard, x, 2, data) for x, data in _answer(sorted(blocks), f"{folder}/pairs-{shard:06d}", voc, s)])

    n = voc.n
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def gather(batches):
        info: dict[int, dict] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slice_, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = view(data)
                if kind == 1:
                    info[slice_] = a
                    continue
                need = int(a["at"][-1]) + 1 if len(a["at"]) else 0
                have = sums.get(slice_, np.zeros(0))
                if len(have) < need:
                    have = np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have))])
                have[a["at"]] += a["sum"]
                sums[slice_] = have
        for slice_, a in info.items():
            total, m = sums.pop(slice_, np.zeros(0)), len(a["n"])
            total = np.concatenate([total, np.zeros(max(0, m - len(total)))])[:m]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["doc_id"], mask=a["null"].astype(bool)), pa.array(a["held"].astype(bool)), pa.array(a["n"]), pa.array(a["known"]), pa.array(np.full(m, n)), pa.array(a["base"]), pa.array(total)],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    sent = _texts(docs, voc, shards, s).repartitionById(shards, F.col("shard"))
    back = sent.mapInArrow(answer, _ROWS).select("slice", "kind", "data").repartition("slice")
    return back.sortWithinPartitions("slice", "kind").mapInArrow(gather, schema)
