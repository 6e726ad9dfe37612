"""Joining a large table to a table with unique keys.

The lookup side is broadcast only after its size was measured.  Beyond the
limit both sides are shuffled, with the hot keys taken out first: a key that
holds as many rows as an average shuffle partition is hot, so there are never
more hot keys than partitions (or ``_HOT_SHARE``, if those are fewer) and their
lookup rows can be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT = 64 * 1024 * 1024
_HOT_SHARE = 1000
_ROW_OVERHEAD = 32


def hot_share(spark: SparkSession) -> int:
    """A key with at least one row in so many is hot."""
    return max(_HOT_SHARE, int(spark.conf.get("spark.sql.shuffle.partitions")))




def _width(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        small = isinstance(field.dataType.elementType, T.IntegerType | T.FloatType)
        size = F.greatest(F.coalesce(F.size(field.name), F.lit(0)), F.lit(0))
        return (4 if small else 8) * size + 16
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Bytes ``df`` takes in memory, measured by one distributed pass."""
    row = sum((_width(f) for f in df.schema.fields), F.lit(_ROW_OVERHEAD))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).head()[0]


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_LIMIT,
    fits: bool | None = None,
) -> DataFrame:
    """Join ``facts`` to ``table`` (unique on ``on``).

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``.
    ``table`` is read twice, and ``facts`` several times when the table is
    large, so stage what is costly to compute.  A caller that joins to the same table many times measures it once and
    passes ``fits``.
    """
    on = list(on)
    if fits is None:
        fits = measured_bytes(table) <= limit
    if fits:
        return facts.join(F.broadcast(table), on, how)
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    # The total is one row.
    hot = (
        counts.join(F.broadcast(total), F.col("_n") * hot_share(facts.sparkSession) >= F.col("_total"))
        .select(*on)
    )
    hot_table = table.join(F.broadcast(hot), on, "left_semi")
    hot_facts = facts.join(F.broadcast(hot), on, "left_semi")
    cold_facts = facts.join(F.broadcast(hot), on, "left_anti")
    return hot_facts.join(F.broadcast(hot_table), on, how).unionByName(
        cold_facts.join(table.hint("merge"), on, how)
    )


def counted_lookup(
    facts: DataFrame, table: DataFrame, on: Sequence[str], count: str, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Left join of ``facts`` to a ``table`` that knows its own frequencies.

    ``count`` holds how many facts a row of ``table`` stands for, so the hot keys are known
    beforehand and ``facts`` are read once: rows with a hot key take their values from a
    broadcast and are spread over the shuffle by a key that matches nothing.  ``on`` are strings.
    """
    on = list(on)
    values = [c for c in table.columns if c not in [*on, count]]
    if measured_bytes(table) <= limit:
        return facts.join(F.broadcast(table.drop(count)), on, "left")
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("_total"))
    share = hot_share(facts.sparkSession)
    # The total is one row; the hot keys are fewer than ``share`` rows.
    hot = table.join(F.broadcast(total), F.col(count) * share >= F.col("_total")).select(
        *on, F.lit(True).alias("_is_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values]
    )
    marked = facts.join(F.broadcast(hot), on, "left")
    spread = F.concat(F.lit("\u0000"), F.pmod(F.monotonically_increasing_id(), F.lit(share)).cast("string"))
    keys = {f"_key_{c}": F.when(F.col("_is_hot"), spread).otherwise(F.col(c)) for c in on}
    cold = table.select(
        *[F.col(c).alias(f"_key_{c}") for c in on], *[F.col(c).alias(f"_cold_{c}") for c in values]
    )
    joined = marked.withColumns(keys).join(cold.hint("merge"), list(keys), "left")
    return joined.select(
        *[F.col(c) for c in facts.columns],
        *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values],
    )
