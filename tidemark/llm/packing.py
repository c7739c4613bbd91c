"""Vector bin packing of tokenised examples into training sequences.

Each example demands a vector (tokens, segments, loss-bearing tokens); a sequence offers (max_tokens, max_segments,
max_loss). Its first tokens may be a prompt, which bears no loss (``prompt_of``; for the documents here the first line,
if there are more). Bins are filled one at a time: of all waiting examples that fit, the one whose weighted demand has
the largest dot product with what is left of the bin goes in next (weights: mean demand of the waiting ones). When none
fits, the one that gives most is cut: up to the tokens left, and of those behind its prompt up to the loss tokens left;
its rest waits on. So a bin whose loss is spent is still filled up with prompts.

Sequences are padded unless their length is a power of two. One that can't be filled to 95 % (its segments are spent, or
few examples are left) is cut back to a power of two, and what was cut off waits on.

Each task packs the rows it reads, from a pool of at most ``pool`` waiting examples and ``pool_tokens`` tokens (beyond
the last one read), so nothing is shuffled, memory is bounded by the pool, and a lost task is simply run again with the
same sequence ids (partition number and counter).

Defined cases: a null text is an empty one (it still has its end id); repeated rows and ids are examples of their own; a
null id stays null; very long texts are cut into as many pieces as they need; an empty table gives no rows; further
columns, also of the result's names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.batches import lean, sliced, texts_of
from tidemark.llm.encoding import Encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096
    pool: int = 1024
    pool_tokens: int = 2_000_000


#: Limits of the training sequences made of documents.
TRAINING = Limits(tokens=4096, segments=16, loss=3968)


def first_line(text: str) -> int:
    """Characters of the first line, if there is another one behind it: the prompt of a document."""
    return max(0, text.find("\n"))


@dataclass
class Piece:
    doc: int  # the caller's handle
    start: int
    length: int
    sequence: int
    offset: int


class Packer:
    """Streaming packer. ``add`` and ``finish`` return the pieces placed so far."""

    def __init__(self, limits: Limits):
        self.lim = limits
        n = limits.pool + 1
        self.doc = np.zeros(n, np.int64)
        self.start = np.zeros(n, np.int64)
        self.prompt = np.zeros(n, np.int64)  # tokens of it that are still there
        self.need = np.zeros((n, 3))  # tokens, segments, loss tokens
        self.n = self.waiting = 0
        self.next_id = 0
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, doc: int, tokens: int, prompt: int = 0) -> list[Piece]:
        """An example; its first ``prompt`` tokens bear no loss."""
        if not tokens:
            return []
        prompt = min(prompt, tokens)
        i, self.n = self.n, self.n + 1
        self.doc[i], self.start[i], self.prompt[i], self.need[i] = doc, 0, prompt, (tokens, 1, tokens - prompt)
        self.waiting += tokens
        out = []
        if self.n > self.lim.pool or self.waiting > self.lim.pool_tokens:
            while self.n > self.lim.pool // 2 or self.waiting > self.lim.pool_tokens // 2:
                out += self._fill()
        return out

    def finish(self) -> list[Piece]:
        out = []
        while self.n:
            out += self._fill()
        return out

    def _choose(self) -> list[tuple[int, int]]:
        """What goes into the next sequence: places in the pool, each once, and how many tokens of each."""
        need, prompt = self.need[: self.n], self.prompt[: self.n]
        room, free, takes = self.cap.copy(), np.ones(self.n, bool), []
        weight = need.mean(0) / self.cap**2
        while room[0] >= 1 and room[1] >= 1:
            score = need @ (weight * room)
            fits = free & (need <= room).all(1)
            if fits.any():
                i = int(np.where(fits, score, -1.0).argmax())
                take = int(need[i, 0])
            else:
                most = np.where(free, np.minimum(np.minimum(room[0], need[:, 0]), prompt + room[2]), 0)
                if most.max() < 1:
                    break
                i = int(np.where(most == most.max(), score, -1.0).argmax())
                take = int(most[i])
            takes.append((i, take))
            free[i] = False
            room = room - (take, 1, max(0, take - int(prompt[i])))
        return takes

    def _fill(self) -> list[Piece]:
        """One sequence."""
        takes = self._choose()
        total = sum(t for _, t in takes)
        if total < 0.95 * self.lim.tokens:
            left, fitted = 1 << (total.bit_length() - 1), []
            for i, take in takes:
                if left:
                    fitted.append((i, min(take, left)))
                    left -= fitted[-1][1]
            takes = fitted
        at, out = 0, []
        for i, take in takes:
            out.append(Piece(int(self.doc[i]), int(self.start[i]), take, self.next_id, at))
            at += take
            self.start[i] += take
            self.need[i] -= (take, 0, max(0, take - int(self.prompt[i])))
            self.prompt[i] = max(0, int(self.prompt[i]) - take)
        self.next_id += 1
        self.waiting -= at
        for i in sorted((i for i, _ in takes if not self.need[i, 0]), reverse=True):
            self.n -= 1
            for x in (self.doc, self.start, self.prompt, self.need):
                x[i] = x[self.n]
        return out


def pack_rows(rows: Iterable[tuple[object, bytes, int]], limits: Limits, task: int) -> Iterator[tuple]:
    """(key, ids as u32 bytes, prompt tokens) -> (key, start, length, crc32 of the piece's ids, all ids, sequence, offset)."""
    packer, live = Packer(limits), {}

    def place(pieces: list[Piece]):
        for p in pieces:
            key, ids, left = live[p.doc]
            crc = zlib.crc32(memoryview(ids)[4 * p.start : 4 * (p.start + p.length)])
            yield key, p.start, p.length, crc, len(ids) // 4, (task << 33) | p.sequence, p.offset
            if left == p.length:
                del live[p.doc]
            else:
                live[p.doc] = (key, ids, left - p.length)

    for handle, (key, ids, prompt) in enumerate(rows):
        n = len(ids) // 4
        live[handle] = (key, ids, n)
        yield from place(packer.add(handle, n, prompt))
    yield from place(packer.finish())


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", prompt_of: Callable[[str], int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``prompt_of`` says how many characters of a text are its prompt, the tokens of which bear no loss (it must end where a
    blank follows, so that they are the first ones of the text's tokens). By default there is none.
    """
    ids = pa.array([], pa.int64()).type

    def run(batches):
        from pyspark import TaskContext

        lean(encoders=True)
        enc, end = Encoder.of(tokenizer), int(end_id).to_bytes(4, "little")

        def rows():
            for b in sliced(batches, 1):
                for key, text in zip(b.column(0).to_pylist(), texts_of(b, 1), strict=True):
                    prompt = prompt_of(text) if prompt_of is not None else 0
                    yield key, enc.encode(text) + end, len(enc.encode(text[:prompt])) // 4 if prompt else 0

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        block: list[tuple] = []
        for r in pack_rows(rows(), limits, TaskContext.get().partitionId()):
            block.append(r)
            if len(block) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, ids) for c in zip(*block, strict=True)], names=names)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, ids) for c in zip(*block, strict=True)], names=names)

    src = docs.select(docs[id_col].cast("bigint"), docs[text_col])
    return src.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
