"""Whole texts to token ids with the ``tokenizers`` library, one call per distinct run of non-blanks.

Both public BPE files split a text before any blank that follows a non-blank, whatever else stands around (the
pre-tokenisers let a word take blanks only from its left, or drop them). So the text may be cut at all such places,
each piece encoded on its own by the library, and the ids joined: the same ids as for the whole text. Pieces repeat a
lot in real text, so they are remembered, in a bounded table of two generations. A piece that is one run of letters is
one pre-token and goes straight to the library's model; one that ends in a comma or full stop after a letter is two,
and so is one that starts with a line end before one. (The letter must still be one once the text is normalised: some
come apart into a letter and a mark, and the mark would go with the comma.)
Texts with the control characters U+001C to U+001F, on which blank classes of the two libraries differ, go to the
tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

_PIECE = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f]")
MEMO = 300_000
LONG = 48

_cache: dict[str, Encoder] = {}


def stand_ins() -> dict[int, int]:
    """Byte -> its printable stand-in of byte-level vocabularies: printable Latin-1 stands for itself, the rest is moved to U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(moved)}


class _Whole(Exception):
    """A word that says something about its surroundings: blanks in a row, or odd ones. It is never remembered."""


class _Memo(dict):
    """Word, after ``prefix``, -> ids. When full, the table becomes the old generation, from which words in use move back."""

    def __init__(self, enc: Encoder, prefix: str):
        super().__init__()
        self.enc, self.prefix, self.old = enc, prefix, {}
        self.lead = prefix.translate(enc.chars)

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if not word or (self.prefix and word[0].isspace()):
                raise _Whole
            got = self._encode(word)
            if got is None:
                return self._join(word)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def _encode(self, word: str) -> bytes | None:
        enc = self.enc
        if len(word) > LONG:
            if _ODD.search(word):
                raise _Whole
            return None
        if word.isalpha() and (not enc.folds or _latin(word)):
            word = word.lower() if enc.folds else word
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(enc.chars)
            return array("I", [t.id for t in enc.model.tokenize(self.lead + word)]).tobytes()
        if word[-1:] in (",", ".") and _ends_in_letter(word[:-1]):
            return self[word[:-1]] + enc.bare[word[-1]]
        if _ODD.search(word):
            raise _Whole
        return None if "\n" in word else enc.whole(self.prefix + word)

    def _join(self, word: str) -> bytes:
        """Words that aren't remembered: long ones, and those around a line end, which are cut there."""
        head, line, tail = word.partition("\n")
        if line and (head or not self.prefix) and not head[-1:].isspace() and tail and not tail[0].isspace():
            return (self[head] if head else b"") + self.enc.line + self.enc.bare[tail]
        return self.enc.whole(self.prefix + word)


class Encoder:
    """``encode_all(texts)``: for each text, its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model = self.lib.model
        self.chars = stand_ins()
        # Does the tokenizer drop blanks and case, or keep both?
        same = lambda a, b: self.whole(a) == self.whole(b)
        self.folds = same("Word  One", "word one") and same(" a\nb ", "a b")
        self.line = self.whole("\n")
        self.bare, self.spaced = _Memo(self, ""), _Memo(self, " ")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _cache:
            _cache[path] = cls(path)
        return _cache[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def encode(self, text: str) -> bytes:
        if self.folds:
            # Blanks are dropped, so they must be looked for.
            if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
                return self.whole(text)
            return b"".join(map(self.bare.__getitem__, (text.lower() if _latin(text) else text).split()))
        try:
            # Each space stands before a word, and is the word's.
            first, *rest = text.split(" ")
            return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        except _Whole:
            if _ODD.search(text):
                return self.whole(text)
            return b"".join(map(self.bare.__getitem__, _PIECE.findall(text)))


def _ends_in_letter(word: str) -> bool:
    """Does it, as it stands and after composition and lower case?"""
    return word[-1:].isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower()[-1:].isalpha())


def _latin(text: str) -> bool:
    """Only characters up to U+00FF: lower case of each is one character, and nothing composes."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
