"""Near copies by the Jaccard similarity of five-word shingles, at least 0.8, checked exactly.

A text is the set of the 64-bit hashes of its shingles (words are split at ASCII blanks, A-Z lowered; a text of fewer
words is one shingle). Equal sets are one node from the start, so copies cost nothing. Candidates come from
``BANDS`` bands of ``ROWS`` min-hashes: two texts of similarity s share a bucket but for a chance of
(1 - s^ROWS)^BANDS, which is 5e-6 at 0.8 and less above. Every link is then checked on the whole sets.

Only nodes in buckets of two or more have their texts shuffled (compressed) and their sets built again; buckets of the same members count once.
A bucket is taken apart in one pass over its sorted run and gives a star for each of its components, not pairs, with
all its links found. ``FIRST`` bands go first; of the others only those buckets are left to do whose members aren't in
one component yet, so a large group of near copies isn't compared anew in each band. A very large bucket is cut into
parts that meet in pairs.

``near_copies_removed`` goes by SimHash first: 64-bit fingerprints of the sets, linked at ``simhash.DISTANCE`` differing bits
by ``simhash.links`` (blocks, distance verified); each component of fingerprints is a bucket, checked like the others.
At 0.8 two fingerprints differ in about 10 bits, which no blocks of 64 bits find in buckets that stay small, so the bands
give the links that are further apart.

Defined cases: null texts count as empty; the texts of no words are one group; of repeated rows and ids the first row
stays; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import lean
from tidemark.llm.components import components
from tidemark.llm.simhash import _LOWER, SEED, links, majority
from tidemark.operators.sort import stored
from tidemark.shared import ensure_checkpoint_dir, fresh, shuffles_dropped

WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
FIRST = 4
#: Size of the filter that goes to all tasks (8 MB), so that few texts are shuffled that aren't wanted. A fuller one lets
#: more of them through, which costs a shuffle of those and nothing else.
FILTER_BITS = 1 << 26

#: Hashes of a bucket, or of a part of one, that a task takes at a time (8 bytes each).
BUCKET = 500_000

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of all word shingles."""
    w = text.encode().translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([digest(b" ".join(w), SEED)] if w else [], np.uint64)
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 256):
        part = x[i : i + 256] ^ _FLIP
        part *= _TIMES
        np.minimum(low, part.min(1), out=low)
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(BANDS, ROWS))]


def _sketch(text: Column, words: int, prints: bool = True) -> Column:
    """node: the set's hash; size: its size; fp: its fingerprint; keys: its bucket in each band. Signed longs."""

    @F.arrow_udf("struct<node:bigint,size:bigint,fp:bigint,keys:array<bigint>>")
    def run(col: pa.Array) -> pa.Array:
        lean()
        node = np.empty(len(col), np.uint64)
        size = np.empty(len(col), np.int64)
        fp = np.empty(len(col), np.uint64)
        keys = np.empty((len(col), BANDS), np.uint64)
        for i, t in enumerate(col):
            h = shingles(t.as_py() or "", words)
            node[i] = xxhash.xxh64_intdigest(h.tobytes())
            size[i] = len(h)
            fp[i] = majority(h) if prints else 0
            keys[i] = band_keys(h)
        ends = pa.array(np.arange(len(col) + 1, dtype=np.int32) * BANDS)
        return pa.StructArray.from_arrays([pa.array(node.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))], names=["node", "size", "fp", "keys"])

    return run(text)


def _packed(text: Column) -> Column:
    """The text, compressed: it is smaller than its set in a shuffle, and gives it."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=1)
        return pa.array([z.compress((t.as_py() or "").encode()) for t in col], pa.binary())

    return run(text)


def bits_of(numbers: DataFrame, column: str) -> np.ndarray:
    """A filter of the longs of a column: ``FILTER_BITS`` bits, whatever their number, of which those at the numbers'
    places are set. Built by partial aggregation; the driver gets the bits, not the numbers."""
    x = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    parts = numbers.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe_in(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """False for longs that are surely not among those of a filter."""
    at = x % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most rows whose ``row`` isn't among the wanted ones (an exact join must follow)."""
    return maybe(texts, "row", wanted)


def maybe(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose long isn't in the same column of ``wanted``."""
    bits = bits_of(wanted, column)

    @F.arrow_udf("boolean")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(maybe_in(bits, x.to_numpy()))

    return df.filter(run(F.col(column)))


def link_bucket(nodes: list[int], sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Stars (member, root) of the components of sets that are similar enough."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left = np.ones(len(sets), bool)
    out = []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo and left.any():
            i = todo.pop()
            mine = sets[i]
            if not len(mine):
                continue
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.bincount(owner[mine[at] == flat], minlength=len(sets))
            found = np.flatnonzero(left & (both >= similarity * (sizes + sizes[i] - both)) & (both > 0))
            left[found] = False
            out += [(nodes[j], nodes[root]) for j in found]
            todo += found.tolist()
            if len(found):
                stay = left[owner]
                flat, owner = flat[stay], owner[stay]
    return out


def _links(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(band, key, parts, node) of buckets, and (node, packed) -> edges (u, v) whose components are those of all links inside the buckets.

    A bucket of more than ``BUCKET`` hashes is cut into parts, and each pair of parts (or part with itself) is a bucket of
    its own, so no task holds more than two parts, and all nodes of the bucket still meet.
    """
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda other: F.least(other, own) * F.col("parts") + F.greatest(other, own))
    spread = members.select("node", "band", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(F.array(F.lit(0).cast("bigint")))).alias("pair"), "key")
    spread = spread.select("node", "key", F.col("pair").cast("int").alias("pair"))
    dealt = spread.join(texts, "node").select("key", "pair", "node", "packed").repartition("key", "pair").sortWithinPartitions("key", "pair")

    def run(batches):
        lean()
        held, nodes, own = None, [], []
        out: list[tuple[int, int]] = []
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for key, pair, node, packed in zip(*(b.column(c) for c in range(4)), strict=True):
                if (key.as_py(), pair.as_py()) != held:
                    out += link_bucket(nodes, own, similarity) if len(nodes) > 1 else []
                    held, nodes, own = (key.as_py(), pair.as_py()), [], []
                nodes.append(node.as_py())
                own.append(shingles(z.decompress(packed.as_py()).decode(), words))
            if out:
                yield _edges(out)
                out = []
        out += link_bucket(nodes, own, similarity) if len(nodes) > 1 else []
        if out:
            yield _edges(out)

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _parts(n: Column, size: Column) -> Column:
    return F.least(n, F.ceil(size / BUCKET)).cast("bigint").alias("parts")


def fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """(node, size, fp) -> (node, key, parts) of the components of fingerprints that hold two nodes or more."""
    member = components(links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp")
    grouped = nodes.select("node", "size", "fp").join(member, "fp", "left").select("node", "size", F.coalesce("root", "fp").alias("key"))
    large = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1").select("key", _parts(F.col("n"), F.col("size")))
    return grouped.drop("size").join(large, "key").select("node", "key", "parts")


def near_groups(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, prints: bool = False) -> DataFrame:
    """(place, text), place a struct of id and row -> (row, keep) of all rows: the row that stands for its component of
    near copies, the one of the smallest place. A text's row must be the same number whenever the rows are read; rows of
    equal texts may share one. ``prints``: by fingerprints first."""
    ensure_checkpoint_dir(rows.sparkSession)
    with shuffles_dropped(rows.sparkSession):
        return _near_groups(rows, words, similarity, prints)


def _near_groups(rows: DataFrame, words: int, similarity: float, by_prints: bool) -> DataFrame:
    prints = rows.select("place", _sketch(F.col("text"), words, by_prints).alias("s")).select("place", "s.node", "s.size", "s.fp", "s.keys").checkpoint()
    nodes = prints.groupBy("node").agg(F.min("place").alias("low"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).checkpoint()

    # Buckets are told apart by key alone (the band is in it), and those of the same members by number, sizes and a mark.
    entries = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.min("band").alias("band")).filter("n > 1")
    buckets = buckets.groupBy("n", "size", "x").agg(F.min(F.struct("band", "key")).alias("b"))
    buckets = buckets.select("b.key", _parts(F.col("n"), F.col("size"))).checkpoint()
    members = maybe(entries.drop("size"), "key", buckets).join(buckets, "key").select("node", "band", "key", "parts")
    if by_prints:
        members = members.unionAll(fingerprint_groups(nodes).select("node", F.lit(-1).alias("band"), "key", "parts"))
    members = members.checkpoint()
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("low.row").alias("row")).checkpoint()
    # One text for each wanted row, also if rows with equal texts share a number (the join has put them together).
    texts = among(rows.select(F.col("place.row").alias("row"), "text"), wanted).select("row", _packed(F.col("text")).alias("packed"))
    texts = texts.join(wanted, "row").groupBy("row").agg(F.first("node").alias("node"), F.first("packed").alias("packed")).select("node", "packed").checkpoint()

    first = _links(members.filter(F.col("band") < FIRST), texts, words, similarity).checkpoint()
    known = components(first)
    later = members.filter(F.col("band") >= FIRST).join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = later.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    second = _links(later.drop("root").join(open_, "key"), texts, words, similarity)
    member = components(first.unionAll(second))

    linked = nodes.join(member, "node").select("node", "root", "low")
    kept = linked.groupBy("root").agg(F.min("low").alias("keep"))
    of = nodes.select("node", "low").join(linked.select("node", "root").join(kept, "root").select("node", "keep"), "node", "left")
    # Stored, so that the join below stands on plain exchanges, of which a hot node's can be split at run time.
    of = of.select("node", F.coalesce("keep", "low").getField("row").alias("keep")).checkpoint()
    return prints.select("node", F.col("place.row").alias("row")).join(of, "node").select("row", "keep")


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of near copies stays: the row of the smallest id (the first such row, if rows
    repeat). Same columns. Rows are told apart by a number that is stored with them, so it doesn't matter how a scan is
    split in the later passes."""
    (row,) = fresh(docs, "__row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")).alias("place"), F.col(text_col).alias("text"))
    dropped = near_groups(rows, words, similarity, prints=True).filter("row <> keep").select(F.col("row").alias(row))
    return keyed.join(dropped, row, "left_anti").select(*docs.columns)
