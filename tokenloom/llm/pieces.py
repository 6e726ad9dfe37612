"""SentencePiece encoding and decoding with a given vocabulary.

A text is cut into the pieces whose scores sum highest, by a streaming Viterbi search: a window of
boundaries no longer than the longest piece is kept, and ids are committed whenever all surviving
paths meet in one boundary, so memory does not grow with the text.  Two kinds of meeting points follow from the vocabulary alone and
are found when it is loaded: before a word mark, if no piece has one inside, around a line end if no longer
piece holds one, and between a letter or digit and a sign that no piece has in that order.  What lies between them is searched once and remembered, up to a bounded number.

Blanks become word marks, one mark is put in front, and characters without a piece become bytes.  A mark
that the text itself holds is written as bytes, so decoding restores every text exactly.  Equal sums go to
the longer last piece.

Defined results: null text has null ids and decodes to null; empty text has no ids; an id outside
the vocabulary, or one that stands for no text, raises; rows may repeat; other columns are kept as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
REMEMBERED = 800_000
_LONGEST_REMEMBERED = 48
_ROWS = 256


class _Remembered(dict):
    """Packed ids by chunk; emptied when it is full."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > _LONGEST_REMEMBERED:
            return b"".join(np.array(part, dtype=np.int32).tobytes() for part in self.pieces.search(chunk))
        if len(self) >= REMEMBERED:
            self.clear()
        packed = array("i", self.pieces.whole(chunk)).tobytes()
        self[chunk] = packed
        return packed


class Pieces:
    """A vocabulary: ``(piece, score, kind)`` by id; kind is ``text``, ``byte`` or ``none``."""

    def __init__(self, entries: list[tuple[str, float, str]]) -> None:
        self.of = {p: (i, s) for i, (p, s, kind) in enumerate(entries) if kind == "text"}
        self.bytes = {
            int(p[3:5], 16): i for i, (p, _, kind) in enumerate(entries) if kind == "byte"
        }
        self.longest = max(map(len, self.of))
        self.unknown = min(s for _, s in self.of.values()) - 10.0
        self.text = [
            p.replace(MARK, " ").encode() if kind == "text"
            else bytes([int(p[3:5], 16)]) if kind == "byte" else None
            for p, _, kind in entries
        ]
        # Nodes are [following characters, score or None, id].
        self.trie: dict[str, list] = {}
        for piece, (i, score) in self.of.items():
            following, node = self.trie, None
            for character in piece:
                node = following.setdefault(character, [{}, None, -1])
                following = node[0]
            node[1:] = [score, i]
        joined = {c for p in self.of if len(p) > 1 for c in p}
        apart = "" if "\n" in joined else "\n"
        marked = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.of)
        # Between these chunks every path has a boundary.
        if marked:
            self.chunks = re.compile("(?s).+")
        else:
            pairs = {p[i : i + 2] for p in self.of for i in range(len(p) - 1)}
            signs = "".join(c for c in ".,;:!?" if not any(x[1] == c and x[0].isalnum() for x in pairs))
            word = f"{MARK}*[^\\W_]+(?=[{signs}])|" if signs else ""
            rest = f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + ("|\n" if apart else "")
            self.chunks = re.compile(word + rest)
        self.remembered = _Remembered(self)

    @classmethod
    def load(cls, model: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        kind = lambda i: (
            "byte" if p.is_byte(i)
            else "none" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "text"
        )
        return cls([(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())])

    def _spelled(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]

    def whole(self, text: str) -> list[int]:
        """Ids of the best path of a short text: the search with all of it in the window."""
        n, trie = len(text), self.trie
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        before, ids = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, j = best[i], i + 1
            node = trie.get(text[i])
            if node is None or node[1] is None:
                if here + self.unknown > best[j]:
                    best[j], before[j], ids[j] = here + self.unknown, i, -1
            while node is not None:
                if node[1] is not None and here + node[1] > best[j]:
                    best[j], before[j], ids[j] = here + node[1], i, node[2]
                if j == n:
                    break
                node = node[0].get(text[j])
                j += 1
        out: list[int] = []
        while n:
            piece, n = ids[n], before[n]
            if piece < 0:
                out += self._spelled(text[n])[::-1]
            else:
                out.append(piece)
        return out[::-1]

    def search(self, text: str, escaped: frozenset[int] = frozenset()):
        """Ids of the best path, as lists, each as soon as it is settled.

        ``escaped``: places whose character must be spelled in bytes.
        """
        of, longest, n = self.of, self.longest, len(text)
        # Per boundary of the window: best sum, boundary before it, id of the piece between.
        best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}
        settled = 0

        def path(end: int, start: int) -> list[int]:
            back: list[int] = []
            while end > start:
                _, before, piece = best[end]
                back += self._spelled(text[before])[::-1] if piece < 0 else [piece]
                end = before
            return back[::-1]

        for i in range(n):
            here = best[i][0]
            # A character on its own, in bytes unless it has a piece.
            character = None if i in escaped else of.get(text[i])
            piece, score = character if character else (-1, self.unknown)
            known = best.get(i + 1)
            if known is None or here + score > known[0]:
                best[i + 1] = (here + score, i, piece)
            if i not in escaped:
                for j in range(i + 2, min(n, i + longest) + 1):
                    if j - 1 in escaped:
                        break
                    found = of.get(text[i:j])
                    if found:
                        known = best.get(j)
                        if known is None or here + found[1] > known[0]:
                            best[j] = (here + found[1], i, found[0])
            if i + 1 - settled >= 2 * longest:
                # Boundaries that a later piece can still start from.
                live = {b for b in best if b > i}
                while len(live) > 1:
                    last = max(live)
                    live.discard(last)
                    live.add(best[last][1])
                meet = live.pop()
                if meet > settled:
                    yield path(meet, settled)
                    for b in [b for b in best if b < meet]:
                        del best[b]
                    settled = meet
        if n > settled:
            yield path(n, settled)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        marked = MARK + text.replace(" ", MARK)
        if MARK in text:
            # Rare: the text holds the mark itself; search it as a whole.
            escaped = frozenset(i + 1 for i, c in enumerate(text) if c == MARK)
            return np.array([i for part in self.search(marked, escaped) for i in part], dtype=np.int32)
        found = map(self.remembered.__getitem__, self.chunks.findall(marked))
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        try:
            if len(ids) and ids.min() < 0:
                raise IndexError
            data = b"".join([text[i] for i in ids.tolist()])
        except (IndexError, TypeError):
            raise ValueError("an id stands for no text in this vocabulary") from None
        return data.decode("utf-8", "surrogatepass")[1:]


_loaded: dict[str, Pieces] = {}


def vocabulary(model: str) -> Pieces:
    """The vocabulary in ``model``, loaded once per Python worker."""
    if model not in _loaded:
        _loaded[model] = Pieces.load(model)
    return _loaded[model]


def _added(df: DataFrame, read: str, added: dict[str, tuple[T.DataType, pa.DataType]], values) -> DataFrame:
    """``df`` with columns made by ``values(cell)`` from the column ``read``.

    A few rows are worked on at a time, so that long texts do not add up.
    """
    names = [c for c in df.columns if c not in added]
    at = df.columns.index(read)
    kinds = [kind for _, kind in added.values()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                made = [values(cell) for cell in part.column(at)]
                columns = [part.column(batch.schema.get_field_index(c)) for c in names]
                columns += [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    fields = [df.schema[c] for c in names]
    schema = T.StructType(fields)
    for name, (spark_type, _) in added.items():
        schema = schema.add(name, spark_type)
    return df.mapInArrow(work, schema)


_IDS = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))


def _coded(cell, model: str) -> np.ndarray | None:
    text = cell.as_py()
    return None if text is None else vocabulary(model).encode(text)


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """Add ``out``: the ids of each text."""
    return _added(docs, text_col, {out: _IDS}, lambda cell: (_coded(cell, model),))


def decode(rows: DataFrame, ids_col: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """Add ``out``: the text of each id array."""

    def text(cell):
        if not cell.is_valid:
            return (None,)
        return (vocabulary(model).decode(cell.values.to_numpy(zero_copy_only=False)),)

    return _added(rows, ids_col, {out: (T.StringType(), pa.string())}, text)


def encode_checked(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Add ``ids`` and ``round_trip``: whether the ids decode to the text, in one pass."""

    def both(cell):
        ids = _coded(cell, model)
        back = None if ids is None else vocabulary(model).decode(ids)
        return ids, back == cell.as_py()

    return _added(docs, text_col, {"ids": _IDS, "round_trip": (T.BooleanType(), pa.bool_())}, both)
