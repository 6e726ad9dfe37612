"""Array column functions for sequences and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDS = "array<int>"


def require_pairs(ids: Column) -> Column:
    """``ids``, or an error when they are too few for one (input, target) pair."""
    return F.when(F.size(ids) > 1, ids).otherwise(
        F.raise_error(F.lit("a sequence needs more than one token")).cast(_IDS)
    )


def chunk_count(length: Column, n_ctx: int) -> Column:
    return F.greatest(F.ceil(length / n_ctx), F.lit(1)).cast("int")


def chunks(ids: Column, n_ctx: int) -> Column:
    """Slices of ``n_ctx`` ids, the last one as long as what is left."""
    last = chunk_count(F.size(ids), n_ctx) - 1
    return F.transform(
        F.sequence(F.lit(0), last), lambda j: F.slice(ids, j * n_ctx + 1, n_ctx)
    )


def shifted(chunk: Column) -> tuple[Column, Column]:
    """All but the last id, and all but the first."""
    pairs = F.greatest(F.size(chunk) - 1, F.lit(0))
    return F.slice(chunk, 1, pairs), F.slice(chunk, 2, pairs)


def padded(ids: Column, width: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), width - F.size(ids)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """``-log softmax(logits)[target]``, in double precision and without overflow."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(
        logits, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - top)
    )
    return F.log(total) + top - F.get(logits, target).cast("double")


def argmax(logits: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def top_k(logits: Column, k: int) -> Column:
    """``array<struct<score, id>>`` of the ``k`` best, lower index first on ties."""
    pairs = F.transform(logits, lambda v, i: F.struct(v.alias("score"), (-i).alias("neg")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return F.transform(
        best, lambda p: F.struct(p["score"].alias("score"), (-p["neg"]).alias("id"))
    )
