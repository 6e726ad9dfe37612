"""Ids of whole texts by public tokenizers, with the ids of frequent words remembered.

Both kinds of tokenizer cut a text before blanks, so what stands between two such places can be
encoded on its own.  Words that were met before are looked up; the library encodes the others, many
at once.  What is remembered is bounded; long words are never remembered.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

REMEMBERED = 800_000
_LONGEST = 64

# A blank or line end after a character that is no white space.  The four separators U+001C to
# U+001F are white space for Python only.
_PLACE = re.compile(r"(?<=[\S\x1c-\x1f])(?=[ \n])")
_RUN = re.compile(r"[^\S\x1c-\x1f][ \n]|\x00")


def cut(text: str) -> list[str]:
    """``text`` in chunks, each a word with the white space before it."""
    if _RUN.search(text):
        return _PLACE.split(text)
    # Every blank and line end is such a place.
    chunks = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
    return chunks if chunks[0] else chunks[1:]


def split(text: str) -> list[str]:
    """``text`` in words, for a tokenizer that drops white space; some may be empty."""
    return text.replace("\n", " ").split(" ")


class Remembered:
    """Packed ids by chunk.  ``encode_new(chunks)`` gives the ids of chunks as lists."""

    def __init__(self, encode_new, dtype=np.int32) -> None:
        self.encode_new, self.dtype, self.held = encode_new, np.dtype(dtype), {}
        self.cut = split if getattr(encode_new, "drops_blanks", False) else cut

    def _packed(self, ids: list[int]) -> bytes:
        packed = array({2: "H", 4: "i"}[self.dtype.itemsize], ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of those chunks that are not remembered; remembers the short ones."""
        new = list(chunks.difference(self.held))
        if not new:
            return {}
        if len(self.held) + len(new) > REMEMBERED:
            # Those in use are encoded again, which is rare and costs no more than a first batch.
            self.held.clear()
            new = list(chunks)
        packed = self._packed
        found = {c: packed(ids) for c, ids in zip(new, self.encode_new(new), strict=True)}
        self.held.update((c, ids) for c, ids in found.items() if len(c) <= _LONGEST)
        return found

    def ids(self, whole: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        texts = [self.cut(text) for text in whole]
        fresh = self.learn(set().union(*texts))
        long = {c: ids for c, ids in fresh.items() if len(c) > _LONGEST}
        held = {**self.held, **long}.__getitem__ if long else self.held.__getitem__
        return [np.frombuffer(b"".join(map(held, chunks)), dtype=self.dtype) for chunks in texts]


def word_tokenizer(path: str):
    """The tokenizer in a JSON file, working in this process alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 characters for
    themselves, the other bytes in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class NewWords:
    """Ids of chunks by a tokenizer of the ``tokenizers`` library.

    Most new chunks are Latin letters, perhaps with a sign behind.  If the tokenizer makes one unit of such letters and
    another of the sign, which is asked of it when it is loaded, its model encodes the unit right away.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        letters = "".join(c for c in map(chr, range(256)) if c.isalpha())
        of_byte = {b: c for c, b in byte_characters().items()}
        self.table = {ord(c): "".join(of_byte[b] for b in c.encode()) for c in letters if not c.isascii()}
        self.form, self.before, self.signs = None, "", {}
        self.drops_blanks = not self._units(" \n ") and self._units(" a\nb ") == self._units("a b")
        alone, before = self._units(letters), self._units(" " + letters)
        for form in (str, str.lower):
            unit = form(letters).translate(self.table)
            if alone == [unit] and len(before) == 1 and before[0].endswith(unit):
                self.form, self.before = form, before[0].removesuffix(unit)
                for sign in ",.;:!?":
                    if self._units(f" {letters}{sign}") == [*before, sign]:
                        self.signs[sign] = [t.id for t in self.model.tokenize(sign)]

    def _units(self, text: str) -> list[str]:
        normal, units = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        return [u for u, _ in units.pre_tokenize_str(normal.normalize_str(text) if normal else text)]

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        found: list = [None] * len(chunks)
        others = []
        form, signs, tokenize = self.form, self.signs, self.model.tokenize
        for i, chunk in enumerate(chunks):
            letters, before, end = chunk, "", signs.get(chunk[-1:])
            if end is not None:
                letters = letters[:-1]
            if letters[:1] == " ":
                letters, before = letters[1:], self.before
            if form is None or not letters.isalpha() or not letters.isascii() and max(letters) > "\xff":
                others.append(i)
                continue
            unit = form(letters) if letters.isascii() else form(letters).translate(self.table)
            ids = [t.id for t in tokenize(before + unit)]
            found[i] = ids + end if end else ids
        encoded = self.tokenizer.encode_batch([chunks[i] for i in others], add_special_tokens=False)
        for i, e in zip(others, encoded, strict=True):
            found[i] = e.ids
        return found
