"""Alignment of the tokens of two tokenizers over the same bytes.

A text gives two rows of tokens that cover the same bytes.  All tokens of a portion of documents are
sorted by where they start; a group ends where the next start reaches the highest end so far, that is,
where tokens of both sides end.  Inside, a token is linked with every token of the other side whose bytes overlap
its own.  Documents lie behind each other on one line, so no group or link crosses them.

Every link of the corpus counts for its pair of ids.  The distinct pairs of a document and how often it has them
are staged with it; the counts are summed over all documents, combined before the shuffle, and looked up again by a
join that broadcasts them while they are small and splits hot pairs beyond that.

Defined results: texts that are null or empty, or whose joined tokens of either side differ from a blank and the text, have no
tokens (zeros, empty digest); rows may repeat, each counts; null doc_ids are kept; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import stage
from .words import NewWords, Remembered, byte_characters, word_tokenizer

MARK = "▁"
_TEXT_BYTES = 1 << 19

_ROW = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs array<bigint>, times array<int>"
)


class Side:
    """The tokens of one tokenizer: their ids, and the bytes each stands for."""

    def __init__(self, ids: Remembered, token_bytes: list[bytes]) -> None:
        self.remembered, self.token_bytes = ids, token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], dtype=np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return self.remembered.ids(texts)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


def byte_level(path: str) -> Side:
    """A byte-level tokenizer; what would be special tokens is ordinary text."""
    tokenizer = word_tokenizer(path)
    tokenizer.encode_special_tokens = True
    of = byte_characters()
    entries = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    token_bytes = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries]

    return Side(Remembered(NewWords(tokenizer)), token_bytes)


def piece_level(path: str) -> Side:
    """A piece tokenizer, which puts a word mark before each text by itself."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    if any(len(x) > 1 and "\n" in x or MARK in x.lstrip(MARK) for x in pieces):
        raise ValueError("pieces cross words or lines, so words cannot be encoded one by one")
    mark = p.piece_to_id(MARK)

    def encode_new(chunks: list[str]):
        # A chunk starts with the blank that the mark stands for, or else with a line end.
        found = p.encode([c.removeprefix(" ") for c in chunks], num_threads=1)
        for chunk, ids in zip(chunks, found, strict=True):
            if chunk == " ":
                yield [mark]
            elif chunk[0] == " ":
                yield ids
            else:
                if ids[0] != mark:
                    raise ValueError("a line end is joined with what is before it")
                yield ids[1:]

    token_bytes = [
        bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace(MARK, " ").encode("utf-8", "surrogatepass")
        for i, x in enumerate(pieces)
    ]
    return Side(Remembered(encode_new), token_bytes)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval, given in the order of their starts."""
    reach = np.maximum.accumulate(ends)
    return np.cumsum(np.append(True, starts[1:] >= reach[:-1])) - 1 if len(starts) else starts


def overlapping(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of intervals of two rows that overlap; each row covers its bytes without gaps."""
    first = np.searchsorted(ends_b, starts_a, side="right")
    last = np.searchsorted(starts_b, ends_a, side="left")
    many = last - first
    a = np.repeat(np.arange(len(starts_a)), many)
    before = np.cumsum(many) - many
    return a, np.arange(len(a)) - np.repeat(before, many) + np.repeat(first, many)


class Aligner:
    """Aligns portions of documents."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        # An id in decimal with what follows it: the same side, the other side, or the next group.
        self.written = [f"{i}{after}" for after in ",|;" for i in range(max(len(a.token_bytes), len(b.token_bytes)))]

    def align(self, texts: list[str | None]) -> list[tuple]:
        """``(n_a, n_b, n_groups, n_links, digest, pairs, times)`` of each text."""
        a, b, n = self.a, self.b, len(texts)
        full = [" " + t if t else "" for t in texts]
        ids_a, ids_b = a.ids(full), b.ids(full)
        for i, text in enumerate(full):
            data = text.encode()
            if a.joined(ids_a[i]) != data or b.joined(ids_b[i]) != data:
                ids_a[i] = ids_b[i] = np.zeros(0, dtype=np.int32)
        n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        all_a, all_b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        ends_a, ends_b = np.cumsum(a.lengths[all_a]), np.cumsum(b.lengths[all_b])
        starts_a, starts_b = ends_a - a.lengths[all_a], ends_b - b.lengths[all_b]

        starts = np.concatenate((starts_a, starts_b))
        side = np.repeat([0, 1], [len(all_a), len(all_b)])
        order = np.lexsort((side, starts))
        group = coalesced(starts[order], np.concatenate((ends_a, ends_b))[order])
        doc = np.concatenate((doc_a, doc_b))[order]
        n_groups = np.bincount(doc[np.append(True, group[1:] != group[:-1])[: len(group)]], minlength=n)

        # Inside a group the tokens of A come first, then those of B.
        grouped = np.lexsort((side[order], group))
        group, place = group[grouped], order[grouped]
        of_side = side[place]
        same_group = np.append(group[1:] == group[:-1], False)[: len(group)]
        same_side = np.append(of_side[1:] == of_side[:-1], False)[: len(group)]
        after = np.where(~same_group, 2, np.where(same_side, 0, 1))
        codes = np.concatenate((all_a, all_b))[place] + after * (len(self.written) // 3)
        edges = np.cumsum(n_a + n_b)

        link_a, link_b = overlapping(starts_a, ends_a, starts_b, ends_b)
        of_doc = doc_a[link_a]
        n_links = np.bincount(of_doc, minlength=n)
        width = len(b.token_bytes)
        pair = all_a[link_a] * width + all_b[link_b]
        every = len(a.token_bytes) * width
        found, times = np.unique(of_doc * every + pair, return_counts=True)
        cuts = np.searchsorted(found, np.arange(n + 1) * every)
        found %= every
        times = times.astype(np.int32)
        out = []
        for i, end in enumerate(edges.tolist()):
            digest = ""
            if n_a[i]:
                text = "".join(map(self.written.__getitem__, codes[end - n_a[i] - n_b[i] : end].tolist()))
                digest = hashlib.sha256(text[:-1].encode()).hexdigest()
            kept = slice(cuts[i], cuts[i + 1])
            out.append((n_a[i], n_b[i], n_groups[i], n_links[i], digest, found[kept], times[kept]))
        return out


_aligners: dict = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """Loaded once per Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(byte_level(a_path), piece_level(b_path))
    return _aligners[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of each document, its pairs of linked ids (``a * size of B + b``) and their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path).align
        names = [c.split()[0] for c in _ROW.split(", ")]

        def batch(ids: list, texts: list):
            columns = list(zip(*align(texts), strict=True))
            sizes = np.array([len(p) for p in columns[5]])
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c))) for c in columns[5:]
            ]
            figures = [pa.array(np.array(c, dtype=np.int64)) for c in columns[:4]]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *figures, pa.array(columns[4], pa.string()), *lists], names
            )

        for part in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= _TEXT_BYTES:
                    yield batch(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield batch(ids, texts)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(work, _ROW)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``(pair, n, best)``: the links that hold a pair of ids, and whether no other pair of its B id has more."""
    pairs = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = stage(pairs.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")), "pair_counts")
    b = F.col("pair") % width
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # One row per id of B.
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def align_report(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: tokens, groups, links, how the links fare in the corpus, and a digest of the groups."""
    rows = stage(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts = stage(pair_counts(rows, width), "ranked_pairs")
    figures = ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    pairs = rows.select(*figures, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select(
        *figures, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    found = lookup_join(pairs, counts, ["pair"], "left")
    total = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)
    return (
        found.groupBy(*figures)
        .agg(
            total(F.when(F.col("best"), F.col("times")), "n_best"),
            total(F.col("times") * F.col("n"), "count_sum"),
        )
        .select(*figures[1:6], "n_best", "count_sum", "groups_sha256")
    )
