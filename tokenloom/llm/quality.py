"""Quality rules: per-document figures and lines that a host repeats.

Each text is read once: its figures and the hash of each line are staged
without the text.  Lines are then counted over the distinct documents of their
host (the ``source``); a line that more than ``greatest(min_docs, share * documents of
the host)`` documents have is boilerplate.  A document is depleted, and
rejected, when less than half of its words are left without those lines.

Defined results: null text counts as empty; a null source is a host of its
own; exact copies within a host are one document to the counts, each row
still gets its verdict; rows may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import stage
from .text import WORD, host_key, let, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20
SHARE_PERCENT = 10
# The characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(word_array: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def windows(w):
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return let(
            hashed,
            lambda h: F.transform(
                F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
            ),
        )

    def covered(placed):
        # Sorted by window, equal windows are neighbours.
        same = lambda x, j: F.get(placed, j)["h"].eqNullSafe(x["h"])
        repeated = F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1))
        spread = F.transform(
            repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)
        )
        return F.size(F.array_distinct(F.flatten(spread)))

    def count(h):
        placed = F.sort_array(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        )
        # Most short texts repeat nothing and need no sorting.
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h), let(placed, covered)
        ).otherwise(0)

    return let(windows(word_array), count)


def _line_keys(lines: Column) -> Column:
    """Per line with a word: hash of its lower-cased words, and their number."""
    return F.transform(
        F.transform(lines, words),
        lambda w: F.struct(
            F.xxhash64(F.lower(F.array_join(w, " "))).alias("key"), F.size(w).alias("n")
        ),
    )


def _figures(docs: DataFrame, carry: list[str], text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        *[F.col(c).alias(f"_in_{c}") for c in carry],
        host_key(F.col(host_col)).alias("_host"),
        F.xxhash64(text).alias("_text_key"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        words(F.col(text_col)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    return read.select(
        *[f"_in_{c}" for c in carry],
        "_host",
        "_text_key",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("bigint").alias("n_repeat_words"),
        _line_keys(F.col("_lines")).alias("_keys"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _boilerplate(rows: DataFrame, min_docs: int, share_percent: int) -> DataFrame:
    """``(_host, key)`` of the lines above the limits."""
    documents = rows.select(
        "_host", "_text_key", F.array_distinct(F.col("_keys.key")).alias("keys")
    ).dropDuplicates(["_host", "_text_key"])
    totals = documents.groupBy("_host").agg(F.count(F.lit(1)).alias("total"))
    counts = (
        documents.select("_host", F.explode("keys").alias("key"))
        .groupBy("_host", "key")
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter(F.col("docs") > min_docs)
    )
    above = F.col("docs") * 100 > F.col("total") * share_percent
    return counts.join(totals, "_host").filter(above).select("_host", "key")


def quality_rules(
    docs: DataFrame,
    carry: list[str],
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    share_percent: int = SHARE_PERCENT,
) -> DataFrame:
    """``carry`` columns, the figures, ``base_failed``, ``removed_words``,
    ``removed_keys`` (hashes of the boilerplate lines found) and ``kept``.

    ``carry`` may name any columns of ``docs``, the text among them.
    """
    rows = stage(_figures(docs, carry, text_col, host_col), "quality")
    frequent = stage(_boilerplate(rows, min_docs, share_percent), "boilerplate")
    lines = rows.select("_row", "_host", F.explode("_keys").alias("_line")).select(
        "_row", "_host", "_line.key", "_line.n"
    )
    removed = (
        lookup_join(lines, frequent, ["_host", "key"], "left_semi")
        .groupBy("_row")
        .agg(F.sum("n").alias("_removed"), F.collect_set("key").alias("removed_keys"))
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    left = rows.join(removed, "_row", "left").withColumn(
        "removed_words", F.coalesce("_removed", F.lit(0)).cast("bigint")
    )
    depleted = 2 * (F.col("n_words") - F.col("removed_words")) < F.col("n_words")
    return left.select(
        *[F.col(f"_in_{c}").alias(c) for c in carry],
        *FIGURES,
        base.alias("base_failed"),
        "removed_words",
        F.coalesce("removed_keys", F.array().cast("array<bigint>")).alias("removed_keys"),
        (~base & ~depleted).alias("kept"),
    )


def without_lines(text: Column, keys: Column) -> Column:
    """``text`` without the lines whose hash is in ``keys``."""

    def stays(line):
        key = F.xxhash64(F.lower(F.array_join(words(line), " ")))
        return ~(line.rlike(WORD) & F.array_contains(keys, key))

    cleaned = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    return F.when(F.size(keys) == 0, text).otherwise(cleaned)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents the rules keep, without their boilerplate lines."""
    names = docs.columns
    # Positions stand for names, so that no column of ``docs`` clashes.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, host = (f"c{names.index(c)}" for c in ("text", "source"))
    judged = quality_rules(plain, plain.columns, text, host, **limits).filter("kept")
    cleaned = judged.withColumn(text, without_lines(F.col(text), F.col("removed_keys")))
    return cleaned.select(*plain.columns).toDF(*names)
