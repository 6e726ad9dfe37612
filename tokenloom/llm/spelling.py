"""Grouping spelling variants: each word's most frequent neighbour by one edit, and where that leads.

Words near each other by one insertion, deletion or replacement share one half of the asking word as it
is.  So words are dealt to blocks by their possible halves, and each asks in the two blocks of its own halves.  A task
indexes the words of a block by a bidirectional FM-index and searches all that ask there.  A half that
very many words share is split: its words are dealt to several blocks and those that ask do so in each.
Blocks grow in number with the vocabulary, not in size.

Forms always have at least twice the occurrences, so chains end; roots are found by doubling.

Defined results: null and empty texts have no words; a null doc_id is written as nothing before the colon;
repeated rows count again; words of equal count are told apart by code-point order; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import stage
from . import fmindex

# What a word is made of, and one in how many places loses a character.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EVERY = 97

BLOCK_ENTRIES = 20_000
_ASKED = 1000

_NEAR = "word string, n bigint, near string, near_n bigint"


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3
) -> DataFrame:
    """``(word, n)`` of the words with some length and frequency."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("before"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"),
    )
    # Words that are too short even before a character goes are left out early.
    hashed = runs.filter(F.length("run") >= min_length).select(
        "run", F.crc32(F.concat("before", "run").cast("binary")).alias("h")
    )
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % _EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    return (
        words.filter(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


def _dealt(words: DataFrame, block_entries: int) -> DataFrame:
    """``(block, asks, word, n)``: each word in the blocks of all halves of words that may be near it, and,
    marked, where it asks."""
    size = F.length("word")
    left = lambda n: F.concat(F.lit("<"), F.substr("word", F.lit(1), n))
    right = lambda n: F.concat(F.lit(">"), F.substr("word", size - n + 1, n))
    half = lambda of: F.floor(of / 2).cast("int")
    halves = [left(half(size + d)) for d in (-1, 0, 1)] + [right(size + d - half(size + d)) for d in (-1, 0, 1)]
    held = words.select("word", "n", F.explode(F.array_distinct(F.array(*halves))).alias("half"))
    own = F.array(left(half(size)), right(size - half(size)))
    asking = words.select("word", "n", F.explode(own).alias("half"))

    counts = held.groupBy("half").agg(F.count(F.lit(1)).alias("entries"))
    entries = counts.agg(F.coalesce(F.sum("entries"), F.lit(0))).head()[0]
    blocks = max(1, -(-entries // block_entries))
    # At most one row for every ``block_entries`` entries.
    split = stage(
        counts.filter(F.col("entries") > block_entries).select(
            "half", F.ceil(F.col("entries") / block_entries).cast("int").alias("parts")
        ),
        "split_halves",
    )
    common = F.pmod(F.xxhash64("half"), F.lit(blocks)).cast("string")
    part = lambda n: F.concat(F.col("half"), F.lit("/"), n.cast("string"))
    held = lookup_join(held, split, ["half"], "left").select(
        F.when(F.col("parts").isNull(), common)
        .otherwise(part(F.pmod(F.xxhash64("word"), F.col("parts"))))
        .alias("block"),
        F.lit(False).alias("asks"), "word", "n",
    )
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), part)
    asking = lookup_join(asking, split, ["half"], "left").select(
        F.explode(F.when(F.col("parts").isNull(), F.array(common)).otherwise(every)).alias("block"),
        F.startswith(F.col("half"), F.lit("<")).alias("left"), "word", "n",
    )
    # A word asks once in a block for each of its halves.
    held = held.select("block", "asks", F.lit(False).alias("left"), "word", "n")
    return held.unionByName(asking.withColumn("asks", F.lit(True)))


class _Block:
    """The words of one block, indexed when the first one asks."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.counts: list[int] = []
        self.index = None

    def add(self, word: str, n: int) -> None:
        # Sorted; a word is dealt to a block once for each of its halves there.
        if not self.words or self.words[-1] != word:
            self.words.append(word)
            self.counts.append(n)

    def _symbols(self, word: str) -> np.ndarray:
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        # A character that no word has is a symbol that occurs nowhere.
        return np.where(known, at + 1, len(self.alphabet) + 1)

    def ask(self, words: list[str], exact_left: bool) -> Iterator[tuple[int, str, int]]:
        """``(which, near word, its count)`` for all words that ask for one of their halves."""
        if not self.words:
            return
        if self.index is None:
            points = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            self.alphabet = np.unique(points)
            self.index = fmindex.Index(list(map(self._symbols, self.words)), len(self.alphabet) + 2)
        sizes = np.array([len(w) for w in words])
        patterns = np.zeros((len(words), int(sizes.max())), dtype=np.int64)
        for row, word in zip(patterns, words, strict=True):
            row[: len(word)] = self._symbols(word)
        for which, at in zip(*(x.tolist() for x in fmindex.near(self.index, patterns, sizes, exact_left)), strict=True):
            word, found = words[which], self.words[at]
            # With the left half as it is, the other search finds it.
            if exact_left or not found.startswith(word[: len(word) // 2]):
                yield which, found, self.counts[at]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, block, waiting = None, _Block(), []

    def answered() -> Iterator[pa.RecordBatch]:
        for left in (True, False):
            asking = [(w, n) for w, n, its in waiting if its == left]
            for start in range(0, len(asking), _ASKED):
                part = asking[start : start + _ASKED]
                found = list(block.ask([w for w, _ in part], left))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[i][0] for i, _, _ in found], pa.string()),
                        pa.array([part[i][1] for i, _, _ in found], pa.int64()),
                        pa.array([w for _, w, _ in found], pa.string()),
                        pa.array([n for _, _, n in found], pa.int64()),
                    ],
                    ["word", "n", "near", "near_n"],
                )
        waiting.clear()

    for batch in batches:
        for name, asks, left, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != current:
                yield from answered()
                current, block = name, _Block()
            if not asks:
                block.add(word, n)
            else:
                waiting.append((word, n, left))
                if len(waiting) >= 4 * _ASKED:
                    yield from answered()
    yield from answered()


def near_words(words: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs of ``words`` that one edit apart, both ways."""
    dealt = _dealt(words, block_entries)
    return (
        dealt.repartition("block")
        .sortWithinPartitions("block", "asks", "word")
        .select("block", "asks", "left", "word", "n")
        .mapInArrow(_search, _NEAR)
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` by following ``form``, twice as far in every round."""
    steps = stage(forms.select("word", F.col("form").alias("root")).filter("root IS NOT NULL"), "roots")
    while True:
        # ``steps`` has a row for each word that leads on; its root may lead on itself.
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = lookup_join(steps, onward, ["root"], "left")
        moved = stage(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        steps = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            return steps


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    words = stage(word_counts(docs, id_col, text_col), "words")
    # Most frequent first, then the smallest in code-point order, which is that of the bytes.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    grouped = near_words(words, block_entries).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best")
    )
    joined = lookup_join(words, stage(grouped, "near_words"), ["word"], "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    forms = stage(
        joined.select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    return lookup_join(forms, _roots(forms), ["word"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
