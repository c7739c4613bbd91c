"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

**Sufficient lookahead.** BPE applies its merge rules in rank order, leftmost first. Compare the runs on a text x and
on a longer text xy, rule by rule, and let d be the leftmost boundary in which they differ (at first the end of x).
A rule (u, v) moves d left only if it fires in one run at a place where v covers or ends at d, so d moves to the start
of v. If d stands where an earlier rule s left its mark (between its parts u_s and v_s), then u_s ends at d in both
runs, and v, which starts at or before u_s, has u_s as a node of its merge tree. So the way that d can go after rule r
is at most

    f(r) = max(|v_r|, max over nodes t of the merge tree of v_r of g(t) + end of t in v_r),

with g(t) = max f(s) over the earlier rules s whose left part is t. L = max f(r) is the sufficient lookahead: all
boundaries of BPE(x) up to |x| - L are boundaries of BPE(xy), for every y. It needs each token to have one rule and
parts older than itself, which is checked on loading.

A boundary of the final result was crossed by no merge, so both sides of it can be encoded on their own. The
transducer therefore keeps a window of some multiples of L bytes, encodes it, emits the tokens that end L or more
before its end, drops their bytes and goes on: memory stays constant however long a word is.

**Pre-tokens** are found in a stream, too: a cut before a blank after a letter is always safe; where none comes, the
regular expression runs on the held text, matches that later characters cannot change are let go, and a run of one
class that fills the window goes to the transducer in parts.

**Decoding** maps ids to bytes and those to text through an incremental UTF-8 automaton that keeps at most three
bytes; malformed sequences give U+FFFD.

Defined cases: a null text is an empty one (no ids); a very long text, or a very long word, takes constant memory; repeated
rows and ids are rows of their own, and a null id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import regex

from tidemark.llm.encoding import stand_ins

#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CLASSES = {"L": regex.compile(r"\p{L}*+"), "N": regex.compile(r"\p{N}*+"), "O": regex.compile(r"[^\s\p{L}\p{N}]*+"), "S": regex.compile(r"\s*+")}
_CUT = regex.compile(r"(?r)(?<=\p{L}) (?=\p{L})")
MEMO, MEMO_BYTES = 250_000, 48


@dataclass
class Vocabulary:
    tokens: dict[int, bytes]
    ranks: dict[tuple[int, int], tuple[int, int]]  # (left, right) -> (rank, merged)
    byte_ids: list[int]
    specials: dict[str, int]
    lookahead: int = field(default=0)

    @classmethod
    def load(cls, path: str, lookahead: int = 0) -> Vocabulary:
        """``lookahead``: the value of an earlier load, to save computing it again."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], {chr(c): b for b, c in stand_ins().items()}
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ids = model["vocab"]
        as_bytes = lambda s: bytes(chars[c] for c in s)
        tokens = {i: s.encode() if s in specials else as_bytes(s) for s, i in ids.items()} | {i: s.encode() for s, i in specials.items()}
        ranks = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks[ids[a], ids[b]] = (rank, ids[a + b])
        one = {s: i for s, i in ids.items() if len(s) == 1}
        byte_ids = [0] * 256
        for c, b in chars.items():
            byte_ids[b] = one[c]
        v = cls(tokens, ranks, byte_ids, specials, lookahead)
        if not lookahead:
            v.lookahead = sufficient_lookahead(v)
        return v


def sufficient_lookahead(v: Vocabulary) -> int:
    """L in bytes (see the module's text)."""
    born = {i: -1 for i in v.byte_ids}
    # Nodes of each token's merge tree with the end of their last occurrence in it.
    trees: dict[int, dict[int, int]] = {i: {i: 1} for i in v.byte_ids}
    reach: dict[int, int] = {}
    best = 1
    for (a, b), (rank, new) in sorted(v.ranks.items(), key=lambda x: x[1][0]):
        if a not in born or b not in born or new in born:
            raise ValueError("the merge list is not proper: a part is younger than its rule, or a token has two rules")
        born[new] = rank
        f = len(v.tokens[b])
        for t, end in trees[b].items():
            if t in reach:
                f = max(f, reach[t] + end)
        best = max(best, f)
        tree = dict(trees[a])
        shift = len(v.tokens[a])
        for t, end in trees[b].items():
            tree[t] = end + shift
        tree[new] = len(v.tokens[new])
        trees[new] = tree
        reach[a] = max(reach.get(a, 0), f)
    return best


class Transducer:
    """Ids of one pre-token, fed in parts of any size."""

    def __init__(self, v: Vocabulary):
        self.v, self.window, self.buf = v, max(4 * v.lookahead, 1024), bytearray()

    def push(self, data: bytes) -> list[int]:
        """Ids that no later byte can change."""
        out: list[int] = []
        at = 0
        while at < len(data):
            take = self.window - len(self.buf)
            self.buf += data[at : at + take]
            at += take
            if len(self.buf) >= self.window:
                ids = self.merge(bytes(self.buf))
                stable, end = len(self.buf) - self.v.lookahead, 0
                for i in ids:
                    n = len(self.v.tokens[i])
                    if end + n > stable:
                        break
                    out.append(i)
                    end += n
                del self.buf[:end]
        return out

    def flush(self) -> list[int]:
        ids = self.merge(bytes(self.buf))
        self.buf.clear()
        return ids

    def merge(self, word: bytes) -> list[int]:
        """BPE of a whole byte string."""
        ids = [self.v.byte_ids[b] for b in word]
        return self._scan(ids) if len(ids) <= 40 else self._queue(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        get, none = self.v.ranks.get, (1 << 60, 0)
        pairs = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low is none or low[0] == 1 << 60:
                break
            i = pairs.index(low)
            ids[i : i + 2] = [low[1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _queue(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.v.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = get((a, b))[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]


class StreamEncoder:
    """``push`` text in parts of any size, then ``finish``; both return ids as little-endian u32 bytes."""

    def __init__(self, v: Vocabulary, memo: dict[str, bytes] | None = None, hold: int = 1 << 14):
        self.v, self.memo, self.hold = v, {} if memo is None else memo, hold
        self.find = regex.compile(PATTERN).findall
        self.iter = regex.compile(PATTERN).finditer
        self.tr = Transducer(v)
        self.text, self.open = "", ""
        # No special token may be cut, nor a blank run before one; a contraction is decided by three characters.
        self.tail = max([3, *(len(s) + 1 for s in v.specials)])

    def push(self, part: str) -> bytes:
        self.text += part
        out = []
        while len(self.text) >= self.hold:
            before = (len(self.text), self.open)
            out.append(self._continue(last=False) if self.open else self._step())
            if (len(self.text), self.open) == before:
                break
        return b"".join(out)

    def finish(self) -> bytes:
        out = self._continue(last=True) if self.open else b""
        out += self._whole(self.text)
        self.text = ""
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _special(self, text: str) -> tuple[int, str]:
        """The first special token in a text; its length if there is none."""
        return min(((text.find(s), s) for s in self.v.specials if s in text), default=(len(text), ""))

    def _whole(self, text: str) -> bytes:
        """Ids of a text that starts and ends at borders of pre-tokens."""
        out = []
        while True:
            at, special = self._special(text)
            out.append(self._words(self.find(text[:at] if special else text)))
            if not special:
                return b"".join(out)
            out.append(self._bytes([self.v.specials[special]]))
            text = text[at + len(special) :]

    def _words(self, words: list[str]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            got = memo.get(w)
            if got is None:
                data = w.encode()
                got = self._bytes(self.tr.push(data) + self.tr.flush())
                if len(data) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = got
            out.append(got)
        return b"".join(out)

    def _take(self, end: int) -> str:
        done, self.text = self.text[:end], self.text[end:]
        return done

    def _step(self) -> bytes:
        """Let go what is settled of the held text."""
        if (m := _CUT.search(self.text)) and m.start():
            return self._whole(self._take(m.start()))
        at, special = self._special(self.text)
        if special:
            return self._whole(self._take(at + len(special)))
        limit, words = len(self.text) - self.tail, []
        for m in self.iter(self.text):
            if m.end() > limit:
                break
            words.append(m.group())
        if words:
            self._take(sum(map(len, words)))
            return self._words(words)
        # One run fills the held text: it goes on in parts.
        head = self.text[1] if self.text[0] == " " and not self.text[1].isspace() else self.text[0]
        self.open = next(k for k in "LNSO" if _CLASSES[k].match(head).end())
        return self._bytes(self.tr.push(self._take(limit).encode()))

    def _continue(self, last: bool) -> bytes:
        """Go on with an open run, or end it."""
        first = self._special(self.text)[0]
        end = _CLASSES[self.open].match(self.text, 0, first).end()
        rest = len(self.text) - self.tail
        if not last and first == len(self.text) and end > rest:
            return self._bytes(self.tr.push(self._take(max(0, rest)).encode()))
        if self.open == "S" and end < first:
            end -= 1  # the last blank before a word stands alone or goes with the word
        self.open = ""
        return self._bytes(self.tr.push(self._take(end).encode()) + self.tr.flush())


class StreamDecoder:
    """Ids in, text out, as soon as it is settled."""

    def __init__(self, v: Vocabulary):
        size = max(v.tokens) + 1
        self.table = [v.tokens.get(i, b"") for i in range(size)]  # ids between them that stand for nothing give nothing
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        t = self.table
        return self.utf8.decode(b"".join([t[i] for i in ids]))

    def finish(self) -> str:
        out = self.utf8.decode(b"", True)
        self.utf8.reset()
        return out


PART = 1 << 16


def encode_parts(enc: StreamEncoder, text: str) -> Iterator[bytes]:
    for i in range(0, len(text), PART):
        if got := enc.push(text[i : i + PART]):
            yield got
    if got := enc.finish():
        yield got
