"""Mixing sources to target weights by systematic sampling.

Target sizes follow from the sizes of the sources alone: shares of 150 % of all words by
weight, stopped at twice a source's size, what is above reshared.  The stopped sources are
those with the smallest size per weight, so one sorted running sum over the sources finds
them.  Within a source every document expects ``target / size`` copies; the expectations are
summed in the order of the documents' sizes, one random offset is added per source, and a document
is emitted once per whole number its part of the sum crosses.  Neighbours in that order are of
nearly equal size, so the words taken miss the target by little more than one document.

Running sums span sorted blocks, so a source may hold any share of the rows.

Defined results: null text has size 0 and is never emitted; a null source is a source of its
own, ordered last; a source without words has target 0; rows may repeat, each counts;
an empty table gives an empty result.  The offset depends on the seed and the source only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import dense_index, running
from ..plans.staging import stage
from .text import WORD, host_key

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MOST_COPIES = 2
SEED = 17


def source_targets(sized: DataFrame, total_percent: int = TOTAL_PERCENT) -> DataFrame:
    """``(host, docs, source_size, target)`` per source of ``(host, size)`` rows."""
    sums = sized.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")
    )
    # The null source has the empty key, which would sort first.
    by_name = [F.col("host") == "", F.col("host")]
    named = dense_index(sums, by_name, "nth_source", "sources")
    cycle = F.pmod(F.col("nth_source"), F.lit(len(WEIGHTS)))
    weight = F.when(cycle == 0, WEIGHTS[0]).when(cycle == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    weighted = named.withColumn("weight", weight.cast("bigint"))
    # Stopped are the sources with the least size per weight.  With the first ones stopped, what is
    # left of the total is shared by the weights that are left.
    order = [F.col("source_size") / F.col("weight"), F.col("nth_source")]
    ranked = running(
        weighted.withColumn("one", F.lit(0)),
        ["one"],
        order,
        {"sizes_to": F.col("source_size"), "weights_to": F.col("weight")},
        "targets",
    )
    ranked = stage(ranked, "ranked")
    whole = ranked.agg(F.sum("source_size").alias("sizes"), F.sum("weight").alias("weights"))
    with_whole = ranked.crossJoin(F.broadcast(whole))  # one row
    # In hundredths: what is left before this source, and its part of it.
    left = total_percent * F.col("sizes") - 100 * MOST_COPIES * (F.col("sizes_to") - F.col("source_size"))
    weights_left = F.col("weights") - F.col("weights_to") + F.col("weight")
    stopped = left * F.col("weight") >= 100 * MOST_COPIES * F.col("source_size") * weights_left
    marked = with_whole.select(
        "host", "docs", "source_size", "weight", "sizes", "weights", stopped.alias("stopped")
    )
    gone = marked.agg(
        F.coalesce(F.sum(F.when(F.col("stopped"), F.col("source_size"))), F.lit(0)).alias("size_gone"),
        F.coalesce(F.sum(F.when(F.col("stopped"), F.col("weight"))), F.lit(0)).alias("weight_gone"),
    )
    rest = total_percent * F.col("sizes") - 100 * MOST_COPIES * F.col("size_gone")
    share = (rest * F.col("weight")).cast("double") / (
        100 * (F.col("weights") - F.col("weight_gone"))
    ).cast("double")
    target = F.when(
        F.col("stopped"), (MOST_COPIES * F.col("source_size")).cast("double")
    ).otherwise(share)
    return marked.crossJoin(F.broadcast(gone)).select(  # one row
        "host", "docs", "source_size", target.alias("target")
    )


def offset(host: Column, seed: int) -> Column:
    """One number in [0, 1) per source."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), host)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``(id, size, source_size, target, copies, taken)`` per row of ``docs``;
    ``keep`` names columns of ``docs`` to carry along."""
    keep = keep or []
    # Ties in size are broken by id and hash of the text: equal rows may swap places, with no effect.
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            host_key(F.col(source_col)).alias("host"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
            .cast("bigint")
            .alias("size"),
            text_key.alias("text_key"),
            *[F.col(c).alias(f"in_{c}") for c in keep],
        ),
        "sized",
    )
    targets = stage(source_targets(sized.select("host", "size")), "source_targets")
    narrow = sized.select("host", "size", "id", "text_key", *[f"in_{c}" for c in keep])
    order = [F.col("size"), F.col("id"), F.col("text_key")]
    placed = running(narrow, ["host"], order, {"nth": F.lit(1)}, "mix_order")
    joined = placed.join(targets, "host")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = joined.withColumn("rate", rate).withColumn("shift", offset(F.col("host"), seed))
    upto = lambda k: F.floor(k.cast("double") * F.col("rate") + F.col("shift"))
    copies = (upto(F.col("nth")) - upto(F.col("nth") - 1)).cast("bigint")
    return rated.withColumn("copies", copies).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *[f"in_{c}" for c in keep],
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as many times as it is emitted."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    where = {n: f"c{names.index(n)}" for n in ("doc_id", "text", "source")}
    planned = mix_plan(
        plain, where["doc_id"], where["text"], where["source"], seed, keep=plain.columns
    )
    emitted = planned.filter(F.col("taken") > 0)
    return emitted.select(
        *[f"in_{c}" for c in plain.columns],
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy").toDF(*names)
