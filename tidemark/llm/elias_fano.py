"""Elias-Fano sequences and n-gram tries over memory-mapped arrays, with vectorised queries.

A non-decreasing sequence of n numbers below u keeps the low log2(u/n) bits of each number packed, and the high bits
in unary: bit (v >> l) + i is set for the i-th number v. Every sixteenth set and unset bit is sampled, so access
(select of ones) and successor search (select of zeros, then a binary search in one bucket of low bits) look at a few
words. All queries take arrays.

A trie keeps, for each level, the ids of its nodes and the pointers to the next level as such sequences. Ids start
anew under each parent, so they are made monotone by adding the last value under the parent before: a search under a
parent adds the same amount and looks for the successor inside the parent's range.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_ONE = U64(1)
_EVERY = 16


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, one after the other, in 64-bit words (and one word more)."""
    values = values.astype(U64)
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 2, U64)
    if not n or not width:
        return words
    at = np.arange(n, dtype=np.int64) * width
    word, off = at >> 6, (at & 63).astype(U64)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[starts]] |= np.bitwise_or.reduceat(values << off, starts)
    spill = np.flatnonzero(off.astype(np.int64) + width > 64)
    words[word[spill] + 1] |= values[spill] >> (U64(64) - off[spill])
    return words


def unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U64)
    at = i.astype(np.int64) * width
    word, off = at >> 6, (at & 63).astype(U64)
    low = words[word] >> off
    high = np.where(off > 0, words[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
    return (low | high) & U64((1 << width) - 1)


@dataclass
class EliasFano:
    n: int
    l: int  # noqa: E741
    lows: np.ndarray
    highs: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        high = (values >> U64(width)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        sample = lambda x: x[::_EVERY].astype(np.uint32 if size < 1 << 32 else np.uint64)
        words = np.concatenate([np.packbits(bits, bitorder="little").view(U64), np.zeros(1, U64)])
        lows = pack(values & U64((1 << width) - 1), width)
        return cls(n, width, lows, words, sample(np.flatnonzero(bits)), sample(np.flatnonzero(bits[:size] == 0)))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) set or unset bit."""
        samples = self.ones if one else self.zeros
        pos = samples[k // _EVERY].astype(np.int64)
        skip = (k % _EVERY).astype(np.int64)
        out = np.empty(len(k), np.int64)
        live = np.arange(len(k))
        while len(live):
            word = self.highs[pos >> 6]
            z = (word if one else ~word) >> (pos & 63).astype(U64)
            have = np.bitwise_count(z).astype(np.int64)
            here = skip < have
            zz, t, p = z[here], skip[here].copy(), pos[here]
            for _ in range(int(t.max()) if len(t) else 0):
                zz = np.where(t > 0, zz & (zz - _ONE), zz)
                t -= 1
            low = zz & (~zz + _ONE)
            out[live[here]] = p + np.bitwise_count(low - _ONE).astype(np.int64)
            far = ~here
            live, skip, pos = live[far], (skip - have)[far], ((pos[far] >> 6) + 1) << 6
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(U64)
        return (high << U64(self.l)) | unpack(self.lows, self.l, i)

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number that is x or more; n if there is none."""
        x = np.asarray(x, U64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        last = int(self.access(np.array([self.n - 1]))[0])
        out = np.full(len(x), self.n, np.int64)
        live = np.flatnonzero(x <= U64(last))
        if not len(live):
            return out
        v = x[live]
        h = (v >> U64(self.l)).astype(np.int64)
        low = v & U64((1 << self.l) - 1)
        a = np.zeros(len(live), np.int64)
        some = h > 0
        a[some] = self._select(h[some] - 1, False) - (h[some] - 1)
        b = self._select(h, False) - h
        # Binary search for the first low part that is large enough in [a, b).
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            less = np.zeros(len(a), bool)
            less[open_] = unpack(self.lows, self.l, mid[open_]) < low[open_]
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        out[live] = a
        return out

    def decode(self) -> np.ndarray:
        bits = np.unpackbits(self.highs.view(np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        return (high.astype(U64) << U64(self.l)) | unpack(self.lows, self.l, np.arange(self.n))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.l], np.int64), "lows": self.lows, "highs": self.highs, "ones": self.ones, "zeros": self.zeros}

    @classmethod
    def of(cls, a: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(a["meta"][0]), int(a["meta"][1]), a["lows"], a["highs"], a["ones"], a["zeros"])


@dataclass
class Trie:
    """Sorted n-grams of one length and all their prefixes; ``codes`` of each level are small numbers of ``bits`` bits."""

    ids: list[EliasFano]
    pointers: list[EliasFano]
    codes: list[np.ndarray]
    bits: int

    @classmethod
    def build(cls, grams: np.ndarray, codes: list[np.ndarray | None], bits: int) -> Trie:
        """``grams``: (n, order), sorted and distinct; ``codes``: for each level one number a node, in order, or None."""
        n, order = grams.shape
        fresh = np.zeros(n, bool)
        ids, pointers, nodes = [], [], []
        for j in range(order):
            if n:
                fresh = fresh | np.concatenate([[True], grams[1:, j] != grams[:-1, j]])
            at = np.flatnonzero(fresh)
            own = grams[at, j].astype(U64)
            if j:
                start = np.searchsorted(at, nodes[-1])
                pointers.append(EliasFano.build(np.append(start, len(at))))
                if len(at):
                    last = own[np.append(start[1:], len(at)) - 1]
                    offset = np.concatenate([[U64(0)], np.cumsum(last, dtype=U64)[:-1]])
                    own = own + np.repeat(offset, np.diff(np.append(start, len(at))))
            ids.append(EliasFano.build(own))
            nodes.append(at)
        packed = [pack(np.zeros(0, U64) if c is None else c, bits) for c in codes]
        return cls(ids, pointers, packed, bits)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Node numbers at the level of the grams' length; -1 for those that aren't there."""
        m, order = grams.shape
        node = self.ids[0].next_geq(grams[:, 0])
        node = self._verify(0, node, grams[:, 0].astype(U64))
        for j in range(1, order):
            live = np.flatnonzero(node >= 0)
            # Parents repeat in sorted queries: each is looked up once.
            parent, back = np.unique(node[live], return_inverse=True)
            a = self.pointers[j - 1].access(parent).astype(np.int64)
            b = self.pointers[j - 1].access(parent + 1).astype(np.int64)
            offset = np.zeros(len(parent), U64)
            offset[a > 0] = self.ids[j].access(a[a > 0] - 1)
            x = grams[live, j].astype(U64) + offset[back]
            at = np.maximum(self.ids[j].next_geq(x), a[back])
            ok = at < b[back]
            ok[ok] = self.ids[j].access(at[ok]) == x[ok]
            out = np.full(m, -1, np.int64)
            out[live[ok]] = at[ok]
            node = out
        return node

    def _verify(self, level: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        ok = at < self.ids[level].n
        ok[ok] = self.ids[level].access(at[ok]) == x[ok]
        return np.where(ok, at, -1)

    def code(self, level: int, node: np.ndarray) -> np.ndarray:
        return unpack(self.codes[level], self.bits, node)

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"trie": np.array([len(self.ids), self.bits], np.int64)}
        for i, e in enumerate(self.ids):
            out |= {f"ids{i}.{k}": v for k, v in e.arrays().items()}
            out[f"codes{i}"] = self.codes[i]
        for i, e in enumerate(self.pointers):
            out |= {f"ptr{i}.{k}": v for k, v in e.arrays().items()}
        return out

    @classmethod
    def of(cls, a: dict[str, np.ndarray]) -> Trie:
        order, bits = map(int, a["trie"])
        part = lambda name: EliasFano.of({k.split(".")[1]: v for k, v in a.items() if k.startswith(name + ".")})
        return cls([part(f"ids{i}") for i in range(order)], [part(f"ptr{i}") for i in range(order - 1)], [a[f"codes{i}"] for i in range(order)], bits)


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one file image: a header, then each array at a multiple of 8."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = (x.dtype.str, len(x), at)
        parts.append(raw + bytes(-len(raw) % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(parts)


def view(data) -> dict[str, np.ndarray]:
    """Arrays over a mapped file or bytes, without copying."""
    n = struct.unpack_from("<Q", data)[0]
    head = json.loads(bytes(data[8 : 8 + n]))
    return {k: np.frombuffer(data, np.dtype(t), size, 8 + n + at) for k, (t, size, at) in head.items()}
