"""Approximate nearest neighbours by inner product: an inverted multi-index (Babenko and Lempitsky, 2012).

**Index.** Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm. Both
halves of the vectors get k centroids of their own, fitted on a bounded sample of distinct vectors (``train``); the
k^2 pairs of centroids are the cells, and every vector is entered in its cell.

**Search.** For each query, a heap gives the cells in the order of the summed distance of the two halves, until they
hold ``budget`` entries; these are reranked by their exact inner product in double precision (coordinates in order).
The budget is measured: for a bounded sample of queries, brute force over all entries says where in that order the
true neighbours are, and the budget is the least that finds ``recall`` of them. Clustered vectors need few entries;
for vectors without structure it may be a third of them, which no index avoids.

**Scale and skew.** Equal vectors are one entry that keeps the smallest ``k + 1`` ids: all others lose every tie, so
nothing is lost, and copies cost nothing. Cells are dealt to shards of at most ``shard`` entries (a larger cell is
split by hash); a query goes to the shards of its cells and brings back its best of each. The driver holds centroids,
cell counts (k is at most 1024), and samples.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id,
take no part; nor do vectors whose length isn't the most frequent one. Repeated rows count once; one id with several
vectors is several entries. Too few candidates: all of them. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import ensure_checkpoint_dir


@dataclass(frozen=True)
class Settings:
    k: int = 20
    train: int = 20_000
    probes: int = 100
    recall: float = 0.96
    shard: int = 20_000
    queries: int = 100_000
    seed: int = 7


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class Quantiser:
    first: np.ndarray
    second: np.ndarray
    top: float  # largest squared norm

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))
        return x[:, :h], np.column_stack([x[:, h:], extra])

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        near = lambda v, c: (2 * v @ c.T - (c * c).sum(1)).argmax(1)
        return near(a, self.first) * len(self.second) + near(b, self.second)

    def traverse(self, q: np.ndarray) -> Iterator[int]:
        """All cells in the order of summed distance."""
        a, b = self.halves(q[None, :], query=True)
        d1, d2 = ((self.first - a) ** 2).sum(1), ((self.second - b) ** 2).sum(1)
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        m, n, width = len(s1), len(s2), len(self.second)
        heap = [(s1[0] + s2[0], 0, 0)]
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, j = pop(heap)
            yield o1[i] * width + o2[j]
            if j + 1 < n:
                push(heap, (s1[i] + s2[j + 1], i, j + 1))
            if not j and i + 1 < m:
                push(heap, (s1[i + 1] + s2[0], i + 1, 0))

    def visited(self, q: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
        """Non-empty cells until they hold ``budget`` entries."""
        out, got, all_ = [], 0, int(counts.sum())
        for c in self.traverse(q):
            if n := int(counts[c]):
                out.append(c)
                got += n
                if got >= min(budget, all_):
                    break
        return out


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, coordinates added in order: the same result for the same two vectors, always."""
    out = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        out += vectors[:, j] * q[j]
    return out


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _valid(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    df = table.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return df.filter(F.size("v") == (sizes["d"] if sizes else 0))


def _sampled(df: DataFrame, key: str, part: float) -> DataFrame:
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 32)) < int(min(1.0, part) * (1 << 32)))


def train(valid: DataFrame, s: Settings) -> Quantiser | None:
    stats = valid.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    n = stats["n"]
    if not n:
        return None
    rows = _sampled(valid, "v", s.train / n).select("v").distinct().orderBy(F.xxhash64("v")).limit(2 * s.train).toArrow()
    if not rows.num_rows:  # few vectors, all hashed away
        rows = valid.select("v").limit(s.train).toArrow()
    x = _matrix(rows.column(0))
    x = x[np.lexsort(x.T)]
    k = int(min(1024, max(4, n**0.5 / 4)))
    empty = np.zeros((1, 1))
    q = Quantiser(empty, empty, float(stats["top"]))
    a, b = q.halves(x)
    return Quantiser(kmeans(a, k, s.seed), kmeans(b, k, s.seed + 1), q.top)


def entries(valid: DataFrame, q: Quantiser, k: int) -> DataFrame:
    """Distinct vectors: v, ids (the k + 1 smallest, ascending), cell."""
    w = Window.partitionBy("v").orderBy("id")
    # Repeats go first, by id and vector, so that a row repeated a million times is one.
    low = valid.distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    classes = low.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                cell = q.cell_of(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["v", "ids", "cell"])

    return classes.select("v", "ids").mapInArrow(run, "v array<double>, ids array<bigint>, cell int")


def _best(vectors: np.ndarray, q: np.ndarray, k: int, rough: np.ndarray) -> np.ndarray:
    """Rows that can be among the k best, by rough products."""
    if len(rough) <= k:
        return np.arange(len(rough))
    least = np.partition(rough, len(rough) - k)[len(rough) - k]
    return np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least)))


def needed_budget(index: DataFrame, probes: np.ndarray, counts: np.ndarray, q: Quantiser, s: Settings) -> int:
    """Entries to look at so that ``recall`` of the sampled queries' true neighbours are among them."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, cell = _matrix(b.column(0)), b.column(2).to_numpy(zero_copy_only=False)
            n, sc, ce = [], [], []
            rough = probes @ x.T
            for i in range(len(probes)):
                top = _best(x, probes[i], s.k + 1, rough[i])
                top = top[np.argsort(-rough[i][top], kind="stable")[: s.k + 1]]
                n += [i] * len(top)
                sc += rough[i][top].tolist()
                ce += cell[top].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(sc), pa.array(ce, pa.int32())], names=["p", "score", "cell"])

    w = Window.partitionBy("p").orderBy(F.desc("score"), "cell")
    rows = index.select("v", "ids", "cell").mapInArrow(run, "p int, score double, cell int").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= s.k + 1).collect()
    true: dict[int, list[int]] = {}
    for r in rows:
        true.setdefault(r["p"], []).append(r["cell"])
    costs = []
    for p, cells in true.items():
        at, got = {}, 0
        want = set(cells)
        for c in q.traverse(probes[p]):
            got += int(counts[c])
            if c in want:
                at[c] = got
                if len(at) == len(want):
                    break
        costs += [at[c] for c in cells]
    costs.sort()
    return costs[min(len(costs) - 1, int(np.ceil(s.recall * len(costs))))] if costs else 1


def search(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row that ``is_query`` picks, without itself.

    ``is_query`` is an expression over the column ``id``.
    """
    spark = table.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    ensure_checkpoint_dir(spark)
    valid = _valid(table, id_col, vec_col)
    q = train(valid, s)
    if q is None:
        return spark.createDataFrame([], schema)
    index = entries(valid, q, s.k).checkpoint()
    counts = np.zeros(q.cells, np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    asked = valid.filter(is_query)
    queries = asked.distinct().join(index.select("v", F.element_at("ids", 1).alias("rep")), "v").select("id", "rep", "v").checkpoint()
    probes = queries.select("v").distinct().orderBy(F.xxhash64("v")).limit(s.probes).toArrow()
    if not probes.num_rows:
        return spark.createDataFrame([], schema)
    budget = needed_budget(index, _matrix(probes.column(0)), counts, q, s)

    # Cells to shards, in order, so that neighbours in the first half share shards; a large cell has several.
    shard_of, parts, load = np.zeros(q.cells, np.int64), np.ones(q.cells, np.int64), 0
    shard = 0
    for c in np.flatnonzero(counts).tolist():
        if load and load + counts[c] > s.shard:
            shard, load = shard + 1, 0
        shard_of[c], parts[c] = shard, -(-int(counts[c]) // s.shard)
        load += int(counts[c])
        if parts[c] > 1:
            shard, load = shard + int(parts[c]), 0

    def place(batches):
        for b in batches:
            if b.num_rows:
                cell = b.column(2).to_numpy(zero_copy_only=False)
                salt = b.column(3).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of[cell] + salt % parts[cell]), *b.columns[:3]], names=["shard", "v", "ids", "cell"])

    def plan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            sh, rows, cells = [], [], []
            for i in range(len(x)):
                by: dict[int, list[int]] = {}
                for c in q.visited(x[i], counts, budget):
                    for p in range(int(parts[c])):
                        by.setdefault(int(shard_of[c]) + p, []).append(c)
                sh += by.keys()
                cells += by.values()
                rows += [i] * len(by)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sh, pa.int64()), b.column(0).take(take), b.column(1).take(take), pa.array(cells, pa.list_(pa.int32()))], names=["shard", "rep", "v", "cells"])

    k = s.k

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("cell").to_numpy(), kind="stable")
            cell = left.column("cell").to_numpy()[order]
            x = _matrix(left.column("v"))[order]
            ids = left.column("ids").to_pylist()
            known, start = np.unique(cell, return_index=True)
            stop = np.append(start[1:], len(cell))
            for block in right.to_batches(max_chunksize=128):
                qs = _matrix(block.column(2))
                seen = [np.searchsorted(known, np.asarray(c)) for c in block.column(3).to_pylist()]
                share = sum(int((stop[j] - start[j]).sum()) for j in seen) / (len(qs) * len(x))
                dense = qs @ x.T if share > 0.05 else None
                for i, rep in enumerate(block.column(1).to_pylist()):
                    at = np.concatenate([np.arange(start[j], stop[j]) for j in seen[i]])
                    rough = dense[i][at] if dense is not None else x[at] @ qs[i]
                    top = at[_best(x, qs[i], k + 1, rough)]
                    exact = products(x[top], qs[i]).tolist()
                    found = sorted((-e, d) for e, t in zip(exact, top.tolist(), strict=True) for d in ids[order[t]])[: k + 1]
                    out.append((rep, [-e for e, _ in found], [d for _, d in found]))
        c = list(zip(*out, strict=True)) or [(), (), ()]
        shard = pa.repeat(right.column("shard")[0], len(out)) if out else pa.array([], pa.int64())
        return pa.table({"shard": shard, "rep": pa.array(c[0], pa.int64()), "score": pa.array(c[1], pa.list_(pa.float64())), "id": pa.array(c[2], pa.list_(pa.int64()))})

    # A shard meets its queries in blocks of at most about ``queries``, so no task holds more of either.
    asking = queries.select("rep", "v").distinct()
    blocks = max(1, -(-asking.count() // s.queries))
    placed = index.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(1 << 20))).mapInArrow(place, "shard bigint, v array<double>, ids array<bigint>, cell int")
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    planned = asking.mapInArrow(plan, "shard bigint, rep bigint, v array<double>, cells array<int>").withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    found = placed.groupBy("shard", "block").cogroup(planned.groupBy("shard", "block")).applyInArrow(scan, "shard bigint, rep bigint, score array<double>, id array<bigint>")
    # The best of each query in two steps, so that no group grows with the number of shards.
    pairs = F.zip_with("score", "id", lambda a, b: F.struct((-a).alias("minus"), b.alias("id")))
    first = lambda df, *by: df.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k + 1).alias("p"))
    parted = first(found.select("rep", F.pmod("shard", F.lit(64)).alias("part"), pairs.alias("p")), "rep", "part")
    best = first(parted, "rep").withColumnRenamed("p", "best")
    mine = queries.select("id", "rep").join(best, "rep").select("id", F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return mine.select(F.col("id").alias("query_id"), F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.minus")).alias("score"))
