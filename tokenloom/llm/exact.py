"""Exact deduplication through an extendible-hash index on shared files.

Keys are 64-bit hashes of the texts.  The directory starts as one slot and doubles as long as
a bucket holds more than ``bucket_keys`` distinct keys and the depth allows; buckets are
ranges of keys, each owned by one task.  Rows are dealt to the bucket files in the shared folder, sorted by key.
An owner streams its file: rows of one key form a chain in which texts are compared byte by byte, so
colliding texts stay apart.  Only texts whose key occurs more than once travel, and each
reading task sends equal texts once, so a group of copies of any size costs one row per task.

Defined results: null text counts as empty; rows with the same text form one group whatever else
differs; the largest doc_id stays (null ids never do, unless all are null); repeated rows of that id are all
marked kept, as they are one row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import new_path, stage

BUCKET_KEYS = 8192
MAX_DEPTH = 16
_FLUSH_BYTES = 64 * 1024 * 1024

_ROW = "bucket int, key bigint, digest string, text string, keep_id bigint, n bigint"
_ENTRY = "bucket int, key bigint, chain int, digest string, keep_id bigint, n bigint"


def _slot(depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)


def directory(cells: dict[int, int], bucket_keys: int, max_depth: int) -> list[int]:
    """Bucket of each slot, from the number of keys per ``max_depth``-bit prefix.

    The list has ``2 ** depth`` slots; a bucket covers the neighbouring slots with its prefix.
    """
    slots, depth = [(0, 0)], 0  # (prefix, local depth) of the bucket in each slot
    while True:
        held: dict[tuple[int, int], int] = {b: 0 for b in slots}
        for cell, n in cells.items():
            held[slots[cell >> (max_depth - depth)]] += n
        overfull = {b for b, n in held.items() if n > bucket_keys}
        if not any(local < max_depth for _, local in overfull):
            break
        if any(local == depth for _, local in overfull):
            slots, depth = [b for b in slots for _ in range(2)], depth + 1
        slots = [
            (slot >> (depth - b[1] - 1), b[1] + 1) if b in overfull and b[1] < depth else b
            for slot, b in enumerate(slots)
        ]
    number = {b: i for i, b in enumerate(dict.fromkeys(slots))}
    return [number[b] for b in slots]


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal texts of one reading task become one row; memory is bounded by flushing."""
    held: dict[str, list] = {}
    size = 0

    def flush():
        rows = [(b, k, d, t, i, n) for t, (b, k, d, i, n) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["bucket", "key", "digest", "text", "keep_id", "n"])

    for batch in batches:
        for b, k, d, t, i in zip(
            batch.bucket, batch.key, batch.digest, batch.text, batch.doc_id, strict=True
        ):
            i = None if pd.isna(i) else int(i)
            if t in held:
                entry = held[t]
                entry[4] += 1
                entry[3] = i if entry[3] is None else entry[3] if i is None else max(entry[3], i)
            else:
                held[t] = [b, k, d, i, 1]
                size += len(t)
                if size > _FLUSH_BYTES:
                    yield flush().astype({"keep_id": "Int64"})
                    size = 0
    yield flush().astype({"keep_id": "Int64"})


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One entry per distinct text of the sorted bucket file."""
    columns = ["bucket", "key", "chain", "digest", "keep_id", "n"]
    current, chain = None, []
    for batch in batches:
        out = []
        for b, k, d, t, i, n in zip(*(batch[c] for c in batch.columns), strict=True):
            if (b, k) != current:
                out += [(*current, j, *e[1:]) for j, e in enumerate(chain)] if chain else []
                current, chain = (b, k), []
            i = None if pd.isna(i) else int(i)
            for entry in chain:
                if entry[0] == t:  # compares the bytes
                    entry[3] += n
                    entry[2] = i if entry[2] is None else entry[2] if i is None else max(entry[2], i)
                    break
            else:
                chain.append([t, d, i, n])
        yield pd.DataFrame(out, columns=columns).astype({"keep_id": "Int64"})
    rest = [(*current, j, *e[1:]) for j, e in enumerate(chain)] if chain else []
    yield pd.DataFrame(rest, columns=columns).astype({"keep_id": "Int64"})


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_keys: int = BUCKET_KEYS,
    max_depth: int = MAX_DEPTH,
    hash_of=F.xxhash64,
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256, bucket, chain)`` per row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), hash_of(text).alias("key")
    )
    keys = stage(
        texts.select("doc_id", "key", F.sha2(F.col("text"), 256).alias("digest")), "keys"
    )
    counted = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key_counts")
    # At most 2 ** max_depth rows.
    cells = {
        r.slot: r.n
        for r in counted.groupBy(_slot(max_depth).alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    slots = directory(cells, bucket_keys, max_depth)
    depth = len(slots).bit_length() - 1
    bucket = F.element_at(F.lit(slots), _slot(depth) + 1).alias("bucket")
    repeated = stage(counted.filter(F.col("rows") > 1).select("key"), "repeated_keys")

    alone = lookup_join(keys, repeated, ["key"], "left_anti").select(
        bucket, "key", "digest", F.lit("").alias("text"), F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("n"),
    )
    together = lookup_join(texts, repeated, ["key"], "left_semi").select(
        bucket, "key", F.sha2("text", 256).alias("digest"), "text", "doc_id"
    )
    dealt = alone.unionByName(together.mapInPandas(_combine, _ROW))
    files = new_path(spark, "bucket_files")
    (
        dealt.repartition(max(slots) + 1, "bucket")
        .sortWithinPartitions("bucket", "key")
        .write.option("compression", "lz4_raw")
        .partitionBy("bucket")
        .parquet(files)
    )
    stored = spark.read.schema(_ROW).parquet(files)
    owned = stored.select("bucket", "key", "digest", "text", "keep_id", "n")
    entries = stage(
        owned.repartition(max(slots) + 1, "bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInPandas(_own, _ENTRY),
        "hash_index",
    )
    found = lookup_join(keys, entries, ["key", "digest"], "left")
    return found.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "bucket",
        "chain",
    )
