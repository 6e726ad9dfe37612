"""Spreading work that is heavier than its input is large."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, key: str) -> DataFrame:
    """``scan`` with enough partitions to keep all cores busy.

    Lexing costs far more than reading, so a scan with fewer partitions than
    cores is repartitioned, into as many as the data is worth (adaptive
    execution merges the small ones).  That only happens to small inputs: a
    large one already has more partitions than cores and is not shuffled.
    Meant for plain scans, whose partitions are known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(key)
