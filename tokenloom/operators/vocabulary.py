"""Token counts and the vocabulary built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..plans.lookup import lookup_join
from ..plans.ordering import dense_index, running
from .tokens import typed_key, unknown_key

VOCAB_SCHEMA = "id int, t_type string, token string, key string, count bigint"
FIRST_SEEN = "first_seen"
LOCATED_SCHEMA = "t_type string, token string, count bigint, first_seen struct<path: string, pos: int>"
_POSITIONS = 1 << 31
# The type of _first_seen.
_SEEN = "decimal(32,0)"


def _first_seen(doc: Column, pos: Column) -> Column:
    # (document, position) as one ordered number: a decimal keeps the minimum
    # in the hash aggregate, a struct would force a sort of all tokens.
    base = doc.cast("decimal(20,0)") * F.lit(_POSITIONS).cast("decimal(10,0)")
    return base + pos.cast("decimal(10,0)")


def _least_seen(tokens: DataFrame, doc_col: str) -> Column:
    """The least :func:`_first_seen`.  Documents with small numbers, as most have, are compared as plain integers, which
    takes a fraction of the time."""
    doc, pos = F.col(doc_col), F.col("pos")
    seen = _first_seen(doc, pos)
    if not isinstance(tokens.schema[doc_col].dataType, T.IntegralType):
        return F.min(seen)
    doc = doc.cast("bigint")
    small = doc.between(F.lit(-_POSITIONS), F.lit(_POSITIONS - 1))
    packed = F.shiftleft(doc, 31).bitwiseOR(pos.cast("bigint"))
    return F.least(F.min(F.when(small, packed)).cast(_SEEN), F.min(F.when(~small, seen)))


def token_frequency(tokens: DataFrame, doc_col: str | None = None) -> DataFrame:
    """``(t_type, token, count)``, with ``first_seen`` when ``doc_col`` is given.

    Counts are combined before the shuffle, so a token that makes up half the
    corpus costs one row per task.
    """
    aggregates = [F.count(F.lit(1)).alias("count")]
    if doc_col is not None:
        aggregates.append(_least_seen(tokens, doc_col).alias(FIRST_SEEN))
    return tokens.groupBy("t_type", "token").agg(*aggregates)


def located_frequency(frequency: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts with ``first_seen`` as ``(path, pos)`` in place of a document number.

    A place by path stays the same when files are added, so counts of several sets of
    files can be merged.  ``documents`` are ``(doc_id, path)``; only one row a token is joined.
    """
    seen = frequency.withColumn("doc_id", F.expr(f"{FIRST_SEEN} div {_POSITIONS}"))
    pos = F.pmod(F.col(FIRST_SEEN), F.lit(_POSITIONS)).cast("int")
    return lookup_join(seen, documents, ["doc_id"], "inner").select(
        "t_type", "token", "count", F.struct("path", pos.alias("pos")).alias(FIRST_SEEN)
    )


def merge_frequencies(parts: DataFrame) -> DataFrame:
    """One count of the counts of several sets of files, which share no file.

    Sums and least places, so any grouping of the sets gives the same; no rows give none.
    The order by path is that of :func:`token_frequency` over documents numbered by path.
    """
    return parts.groupBy("t_type", "token").agg(
        F.sum("count").alias("count"), F.min(FIRST_SEEN).alias(FIRST_SEEN)
    )


def most_common(frequency: DataFrame) -> DataFrame:
    return frequency.orderBy(F.desc("count"), "t_type", "token")


def above_threshold(
    frequency: DataFrame, threshold: int = L.FREQUENCY_THRESHOLD, open_types=L.OPEN_CLASS_TYPES
) -> DataFrame:
    """Tokens counted more than ``threshold`` times, and all closed-class ones."""
    return frequency.filter(
        (F.col("count") > threshold) | ~F.col("t_type").isin(*open_types)
    )


def reserved_entries(spark: SparkSession, open_types=L.OPEN_CLASS_TYPES) -> DataFrame:
    """The start token and one unknown token per open-class type."""
    rows = [(L.START_ID, None, L.START_TOKEN, L.START_TOKEN, 0)] + [
        (i, t, L.UNKNOWN_TOKEN, unknown_key(t), 0)
        for i, t in enumerate(sorted(open_types), start=1)
    ]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def build_vocab(
    frequency: DataFrame, threshold: int = L.FREQUENCY_THRESHOLD, open_types=L.OPEN_CLASS_TYPES
) -> DataFrame:
    """The vocabulary: start, unknowns, then kept tokens in first-seen order.

    ``frequency`` needs ``first_seen``.  A literal spelled like the unknown
    token shares the reserved entry of its type, so keys stay unique.
    """
    kept = above_threshold(frequency, threshold, open_types).filter(
        (F.col("token") != L.UNKNOWN_TOKEN) | ~F.col("t_type").isin(*open_types)
    )
    ranked = dense_index(kept, [F.col(FIRST_SEEN)], "rank", "vocab-order")
    offset = 1 + len(open_types)
    entries = ranked.select(
        (F.col("rank") + offset).cast("int").alias("id"),
        "t_type",
        "token",
        typed_key().alias("key"),
        "count",
    )
    return reserved_entries(frequency.sparkSession, open_types).unionByName(entries)


def run_metadata(vocab: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row of run settings: defaults, overridden by ``stored``, with the
    vocabulary size filled in.  ``stored`` has one row or none; more raise."""
    defaults = dict(L.DEFAULT_HPARAMS)
    row = vocab.agg(F.count(F.lit(1)).cast("int").alias("n_vocab"))
    if stored is None:
        return row.select("n_vocab", *[F.lit(v).alias(k) for k, v in defaults.items() if k != "n_vocab"])
    known = [k for k in defaults if k in stored.columns and k != "n_vocab"]
    extra = [k for k in stored.columns if k not in defaults]
    several = F.when(
        F.count(F.lit(1)) > 1, F.raise_error(F.lit("several rows of run settings")).cast("int")
    )
    one = stored.agg(
        several.alias("_several"), *[F.any_value(c).alias(c) for c in [*known, *extra]]
    )
    # Both sides are single rows.
    joined = row.join(one.filter(F.col("_several").isNull()), F.lit(True), "left")
    return joined.select(
        "n_vocab",
        *[
            (F.coalesce(k, F.lit(v)) if k in known else F.lit(v)).alias(k)
            for k, v in defaults.items()
            if k != "n_vocab"
        ],
        *extra,
    )


def quoted(token: Column) -> Column:
    """Token in quotes with escapes, as in a report (ASCII escapes only)."""
    escaped = F.replace(token, F.lit("\\"), F.lit("\\\\"))
    named = {9: "\\t", 10: "\\n", 13: "\\r"}
    for code in [*range(32), 127]:
        char, name = chr(code), named.get(code, f"\\x{code:02x}")
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    double = F.contains(token, F.lit("'")) & ~F.contains(token, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def rare_tokens_by_type(
    frequency: DataFrame, threshold: int = L.FREQUENCY_THRESHOLD, part_size: int = 1000
) -> DataFrame:
    """Rare tokens of each type in count order, quoted.

    A type's list is cut into parts of ``part_size`` tokens: names alone can
    have more rare spellings than one row or one task could hold.
    """
    rare = frequency.filter(F.col("count") <= threshold).select("t_type", "token", "count")
    ranked = running(
        rare, ["t_type"], [F.desc("count"), F.col("token")], {"rank": F.lit(1)}, "rare-order"
    )
    part = F.floor((F.col("rank") - 1) / part_size).cast("int")
    return (
        ranked.groupBy("t_type", part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", quoted(F.col("token")).alias("q")))).alias("_s"))
        .select("t_type", "part", F.transform("_s", lambda s: s["q"]).alias("tokens"))
    )


def report_lines(frequency: DataFrame) -> DataFrame:
    """``key: count`` lines by descending count."""
    return most_common(frequency).select(
        F.format_string("%s: %d", typed_key(), F.col("count")).alias("line")
    )


def rare_lines(rare: DataFrame) -> DataFrame:
    """``type ==> [tokens]`` lines of :func:`rare_tokens_by_type`."""
    return rare.orderBy("t_type", "part").select(
        F.format_string(
            "%s ==> [%s]", F.col("t_type"), F.array_join("tokens", ", ")
        ).alias("line")
    )
