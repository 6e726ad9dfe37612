"""Keyed permutations of ``0 .. n - 1`` as column arithmetic.

An index is split into two digits, which are moved in turn by a number made of the other one and a key (a
Feistel network on mixed radices).  The two radices multiply to a little more than ``n``; whatever
lands beyond ``n`` is moved again until it does not (cycle walking), so the places are exactly those below ``n``.
Nothing is sorted or shuffled: the place of a row follows from its index alone, on any machine and at any time.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 4
MAX_ROWS = 1 << 60
# Multipliers and prime moduli below 2 ** 31, so that no product leaves 64 bits.
_MIX = ((48271, 2147483647), (69621, 2147483629))


def round_keys(seed: int, epoch: int) -> list[int]:
    """A number below ``2 ** 28`` for each round."""
    names = (f"{seed}-{epoch}-{i}" for i in range(ROUNDS))
    return [int(hashlib.md5(name.encode()).hexdigest()[:7], 16) for name in names]


def radices(n: int) -> tuple[int, int]:
    """Two numbers of about ``sqrt(n)`` whose product is ``n`` or a little more."""
    if n > MAX_ROWS:
        raise ValueError(f"{n} rows are more than {MAX_ROWS}")
    high = math.isqrt(max(n, 1) - 1) + 1
    return high, -(-max(n, 1) // high)


def _moved(digit: Column, by: Column, key: Column, radix: int) -> Column:
    for factor, prime in _MIX:
        by = (by * F.lit(factor).cast("bigint") + key) % F.lit(prime).cast("bigint")
    return (digit + by) % F.lit(radix).cast("bigint")


def _once(index: Column, n: int, keys: list[int]) -> Column:
    """All rounds once: a permutation of the numbers below the product of the radices."""
    high, low = radices(n)
    radix = F.lit(low).cast("bigint")

    def both(digits: Column, key: Column) -> Column:
        first = _moved(digits["a"], digits["b"], key, high)
        return F.struct(first.alias("a"), _moved(digits["b"], first, key, low).alias("b"))

    # Integer division, as a quotient of doubles is not exact beyond 53 bits.
    start = F.struct(F.call_function("div", index, radix).alias("a"), (index % radix).alias("b"))
    rounds = F.array(*[F.lit(k).cast("bigint") for k in keys])
    return F.aggregate(rounds, start, both, lambda digits: digits["a"] * radix + digits["b"])


def _walks(spark: SparkSession, n: int, keys: list[int]) -> int:
    """How often an index may have to be moved again: the longest chain of numbers from ``n`` on that leads back
    below ``n``.  There are at most about ``sqrt(n)`` such numbers, and one small job finds it.  Numbers that lead to each
    other in a circle are never met from below."""
    high, low = radices(n)
    size = F.lit(n).cast("bigint")
    beyond, most = spark.range(n, high * low).select(F.col("id").alias("at")), 8
    while True:
        start = F.struct(F.col("at").alias("at"), F.lit(0).alias("steps"))

        def on(walk: Column, _: Column) -> Column:
            further = F.struct(_once(walk["at"], n, keys).alias("at"), (walk["steps"] + 1).alias("steps"))
            return F.when(walk["at"] >= size, further).otherwise(walk)

        walk = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, on)
        back = F.col("walk.at") < size
        found = beyond.select(walk.alias("walk")).agg(
            F.max(F.when(back, F.col("walk.steps"))).alias("steps"), F.count_if(~back).alias("open")
        ).head()
        # A chain meets each number beyond once, so what is open after that many steps is a circle.
        if not found.open or most >= high * low - n:
            return found.steps or 0
        most *= 2


def permuted(rows: DataFrame, index: str, name: str, n: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``rows`` with ``name``: the place of ``index`` (``0 .. n - 1``) in the order of ``seed`` and ``epoch``.

    A null index has a null place.  ``n`` is up to ``2 ** 60``.
    """
    keys = round_keys(seed, epoch)
    walks = _walks(rows.sparkSession, n, keys)
    place = _once(F.col(index).cast("bigint"), n, keys)
    if walks:
        again = lambda at, _: F.when(at >= F.lit(n).cast("bigint"), _once(at, n, keys)).otherwise(at)
        place = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), place, again)
    return rows.withColumn(name, place)
