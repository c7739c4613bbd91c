"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint per text; texts link if their fingerprints differ in at most ``distance`` bits. The fingerprint
is cut into ``blocks`` blocks; two that differ in 3 bits agree on at least blocks - 3 of them, so each fingerprint is
entered once per choice of blocks - 3 blocks (6 blocks: 20 choices of about 32 bits, so a bucket stays small up to
billions of fingerprints). Equal fingerprints are one node from the start, so copies cost nothing.

The join on blocks is a sort-merge self-join: entries are dealt by (choice, block bits), sorted, and each run of one
bucket is joined with itself in place, with the Hamming distance verified. A bucket of many links gives a star for each of its components
instead of pairs: all its links enter the components, yet rows stay in proportion to its fingerprints.
Within a bucket the next node is compared with what isn't reached yet; one of more than ``SMALL`` is first split by
blocks of its other bits, in the same way. A bucket is held by one task as 8 bytes a distinct fingerprint.

Defined cases: null texts count as empty; a text of no words has fingerprint 0 and links like any other; a text of one
or two words is one shingle; repeated ids are one node each with their own text's fingerprint; an empty table gives no
rows; very long texts are read whole; null ids are nodes too (they sort first); further columns are kept by
``near_duplicates_removed`` and ignored elsewhere.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.operators.sort import stored
from tidemark.shared import ensure_checkpoint_dir, fresh

SEED = 42
BLOCKS = 6
DISTANCE = 3
SMALL = 600
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles; words are split at ASCII blanks, A-Z lowered."""
    w = text.encode().translate(_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        h = [digest(b" ".join(w), SEED)]
    else:
        h = [digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]
    return majority(h)


def majority(h) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(np.array(h[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x or "", words) for x in s], np.uint64).view(np.int64))

    return run(text)


def _masks(blocks: int, agree: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in itertools.combinations(bits, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_bucket(fps: np.ndarray, mask: int, distance: int, small: int = SMALL) -> list[tuple[int, int]]:
    """Edges between distinct fingerprints that agree on a mask, at most about two for each, whose components are those of
    all their links: stars where there are many links, else the links. A large bucket is split by the same principle as the whole: of ``distance + 1`` parts of the bits outside
    the mask, two that link agree on one."""
    fps = np.sort(fps)
    free = [i for i in range(64) if not mask >> i & 1]
    out: list[tuple[int, int]] = []
    if len(fps) > small and len(free) > distance:
        for part in np.array_split(np.array(free), distance + 1):
            bits = sum(1 << int(i) for i in part)
            value = fps & np.uint64(bits)
            order = np.argsort(value, kind="stable")
            cut = np.flatnonzero(np.diff(value[order])) + 1
            for own in np.split(order, cut):
                if len(own) > 1:
                    out += link_bucket(fps[own], mask | bits, distance, small)
        return out
    if len(fps) <= SMALL:
        near = np.triu(np.bitwise_count(fps[:, None] ^ fps) <= distance, 1)
        if near.sum() <= 2 * len(fps):
            i, j = np.nonzero(near)
            return list(zip(fps[j].tolist(), fps[i].tolist(), strict=True))
    rest = fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(x), int(root)) for x in found]
                todo += list(found)
    return out


def links(prints: DataFrame, column: str = "fp", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints -> edges (u, v) whose components are those of all links."""
    masks = _masks(blocks, blocks - distance)
    entries = F.array(*[F.struct(F.lit(i).cast("int").alias("c"), F.col(column).bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    rows = prints.select(F.explode(entries).alias("e"), F.col(column).alias("fp")).select("e.c", "e.k", "fp")
    dealt = rows.repartition("c", "k").sortWithinPartitions("c", "k")

    def run(batches):
        held, parts = None, []
        for b in itertools.chain(batches, [None]):
            out: list[tuple[int, int]] = []
            if b is not None and not b.num_rows:
                continue
            c, k, f = (x.to_numpy(zero_copy_only=False) for x in b.columns) if b is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
            starts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1])[: len(c)]
            stops = np.append(starts[1:], len(c))
            for i, (x, y) in enumerate(zip(starts.tolist(), stops[: len(starts)].tolist(), strict=True)):
                if i or held != (int(c[x]), int(k[x])):
                    out += _closed(held, parts)
                    held, parts = (int(c[x]), int(k[x])), []
                parts.append(f[x:y].copy())
            if b is None:
                out += _closed(held, parts)
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def _closed(held, parts):
        if sum(map(len, parts)) < 2:
            return []
        return link_bucket(np.concatenate(parts).view(np.uint64), masks[held[0]], distance)

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS, words: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id that is reachable over links."""
    ensure_checkpoint_dir(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), words).alias("fp")).checkpoint()
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).checkpoint()
    member = components(links(nodes.select("fp"), "fp", distance, blocks))
    linked = nodes.join(member.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = nodes.join(linked.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp", "left")
    # Stored, so that the join below stands on plain exchanges, of which a hot fingerprint's can be split at run time.
    of = of.select("fp", F.coalesce("component_id", "low").alias("component_id")).checkpoint()
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = 3) -> DataFrame:
    """One document of each group stays: the row of the smallest id (the first such row, if rows repeat). Same columns.

    Rows are told apart by a number that is stored with them, so repeated ids lose no group and it doesn't matter how a
    scan is split later. Only keys and fingerprints are shuffled to find the groups; then the dropped rows are taken out.
    """
    row, key = fresh(docs, "__row", "__key")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col(id_col).alias("id"), F.col(row).alias("row"))
    ranked = near_duplicates(keyed.withColumn(key, place), key, text_col, distance, words=words)
    dropped = ranked.filter("doc_id <> component_id").select(F.col("doc_id.row").alias(row))
    return keyed.join(dropped, row, "left_anti").select(*docs.columns)
