"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles.  Two documents link when the sets share
at least 80 % of their union, so their symmetric difference is at most ``D = (a + b) / 9``.

Sketch: every shingle is one bit of a long bit vector, and the sketch of a set is the XOR of its
bits.  The Hamming distance of two sketches never exceeds the symmetric difference of the sets.  Sizes are
cut into bands by the factor 1.5; for the smaller document's band the largest ``D`` is known and the vector is cut
into more than ``D`` blocks.  By the pigeonhole principle linked documents agree in a block, so
they meet in a join on (band, block, content); a document joins with the blocks of its own band and
of the band below if it is close enough.  Empty blocks say nothing and are left out; only a document with too few
others uses them, which keeps the principle true.  A block's content stands as a 64-bit XOR of its bits.

Documents that meet are not paired with each other but with the least of them.  A second, dense
sketch of 512 bits with the same bound drops most pairs, the rest are verified on the whole texts.  Where a meeting place
still holds documents of different components, its pairs across components are verified too, so no link is lost.
Equal sets are one document in all this.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows that share a
doc_id are one document, linked through any of them; a null doc_id links with nothing and has a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import new_path, stage, temporary
from .components import components
from .shingles import WIDTH, arrow_bytes, mix, shingle_sets

THRESHOLD = (80, 100)
_BAND = 1.5
_WORDS = 8  # of 64 bits in the dense sketch
_ROWS = 200_000


def most_different(a: int, b: int, threshold: tuple[int, int]) -> int:
    """The largest symmetric difference of linked sets with these sizes."""
    part, whole = threshold
    return (whole - part) * (a + b) // (whole + part)


class Bands:
    """Size bands and the number of blocks of each."""

    def __init__(self, threshold: tuple[int, int]) -> None:
        self.threshold = threshold
        self.starts = [1]

    def _reach(self, n: int) -> None:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * _BAND)))

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """``(band, D, blocks)`` for each band in which a set of size ``n`` has to appear."""
        self._reach(n)
        part, whole = self.threshold
        out = []
        for j in range(len(self.starts) - 1):
            low, high = self.starts[j], self.starts[j + 1] - 1
            # As the smaller set of size a, or the larger one of a set of the band.
            if low <= n and n * part <= high * whole:
                most = most_different(high, high * whole // part, self.threshold)
                blocks = math.ceil(1.2 * (most + 1)) + 1 if most else 1
                out.append((j, most, blocks))
        return out


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the blocks of one set; ``shingles`` are sorted and distinct."""
    keys = []
    high = shingles >> np.uint64(32)
    bits = mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    for band, most, blocks in bands.of(len(shingles)):
        # Blocks are ranges of the vector, so sorted shingles have sorted blocks.
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        content = np.bitwise_xor.reduceat(bits, starts)
        number = block[starts]
        if len(starts) <= most:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), number)
            number = np.concatenate((number, empty))
            content = np.concatenate((content, np.zeros(len(empty), dtype=np.uint64)))
        place = mix(number + np.uint64(1) + (np.uint64(band + 1) << np.uint64(40)))
        keys.append(mix(content ^ place))
    return np.concatenate(keys).view(np.int64)


def sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the shingles at each of ``bits`` places, a power of two."""
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8))


def dense_sketch(shingles: np.ndarray) -> list[int]:
    return sketch(shingles, 64 * _WORDS).view(np.int64).tolist()


def fine_sketch(shingles: np.ndarray) -> bytes:
    """As many bits as shingles at least, so that it tells large sets apart, too."""
    return sketch(shingles, 1 << max(6 + _WORDS.bit_length(), (len(shingles) - 1).bit_length())).tobytes()


def fine_distance(x: bytes, y: bytes) -> int:
    """Hamming distance; the longer sketch is folded to the length of the other."""
    a, b = (np.frombuffer(s, dtype=np.uint8) for s in sorted((x, y), key=len))
    while len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(b) // 2), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


_READ = "id bigint, n bigint, same binary, sketch array<bigint>, fine binary"
_ARROW_READ = pa.schema(
    [
        ("id", pa.int64()),
        ("n", pa.int64()),
        ("same", pa.binary()),
        ("sketch", pa.list_(pa.int64())),
        ("fine", pa.binary()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size, digest and sketches of each set."""
    for batch in batches:
        columns: list[list] = [[] for _ in _ARROW_READ]
        texts = arrow_bytes(batch.column(1))
        for doc, shingles in zip(batch.column(0).to_pylist(), shingle_sets(texts, width), strict=True):
            row = (doc, len(shingles), None, None, None)
            if doc is not None and len(shingles):
                same = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                row = (doc, len(shingles), same, dense_sketch(shingles), fine_sketch(shingles))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        made = [pa.array(c, f.type) for c, f in zip(columns, _ARROW_READ, strict=True)]
        yield pa.RecordBatch.from_arrays(made, schema=_ARROW_READ)


def _keys(batches: Iterator[pa.RecordBatch], width: int, threshold) -> Iterator[pa.RecordBatch]:
    bands = Bands(threshold)
    keys: list[np.ndarray] = []
    docs: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        made = [pa.array(np.concatenate(c)) for c in (keys, docs)]
        keys.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays(made, ["key", "id"])

    size = 0
    for batch in batches:
        texts = arrow_bytes(batch.column(1))
        for doc, shingles in zip(batch.column(0).to_pylist(), shingle_sets(texts, width), strict=True):
            if len(shingles):
                keys.append(signatures(shingles, bands))
                docs.append(np.full(len(keys[-1]), doc, dtype=np.int64))
                size += len(keys[-1])
            if size > _ROWS:
                yield flush()
                size = 0
    if keys:
        yield flush()


def _may_link(threshold: tuple[int, int]) -> Column:
    """Sizes and dense sketches of ``a`` and ``b`` allow a link."""
    part, whole = threshold
    a, b = F.col("a.n"), F.col("b.n")
    apart = sum(
        F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i])) for i in range(_WORDS)
    )
    sizes = (F.least(a, b) * whole >= F.greatest(a, b) * part)
    return sizes & (apart * (whole + part) <= (a + b) * (whole - part))


def _verify(pairs: DataFrame, sketched: DataFrame, texts: DataFrame, width: int, threshold) -> DataFrame:
    """The pairs ``(u, v)`` that link, judged on the whole texts.

    Before texts are fetched, the fine sketches drop the pairs they rule out.
    """
    part, whole = threshold

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            apart = [fine_distance(x, y) for x, y in zip(batch.fine_u, batch.fine_v, strict=True)]
            yield batch.loc[
                np.array(apart, dtype=np.int64) * (whole + part)
                <= (batch.n_u + batch.n_v) * (whole - part),
                ["u", "v"],
            ]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (shingle_sets(arrow_bytes(batch.column(i)), width) for i in (2, 3))
            linked = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    def ends(table: DataFrame, *columns: str) -> list[DataFrame]:
        return [
            table.select(F.col("id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in columns])
            for e in ("u", "v")
        ]

    side_u, side_v = ends(sketched, "n", "fine")
    possible = stage(
        pairs.join(side_u, "u")
        .join(side_v, "v")
        .select("u", "v", "n_u", "n_v", "fine_u", "fine_v")
        .mapInPandas(near, "u bigint, v bigint")
        .distinct(),
        "near_pairs",
    )
    wanted = stage(possible.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "wanted")
    text_u, text_v = ends(lookup_join(texts, wanted, ["id"], "left_semi"), "text")
    both = possible.join(text_u, "u").join(text_v, "v")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(check, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: tuple[int, int] = THRESHOLD,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row of ``docs``."""
    spark = docs.sparkSession
    path = new_path(spark, "near_duplicates")
    # Only the result is kept of what is staged on the way.
    with temporary(spark):
        found = _near_duplicates(docs, id_col, text_col, width, threshold)
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int, threshold) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    read = stage(texts.mapInArrow(lambda batches: _read(batches, width), _READ), "sketches")
    rows = read.filter(F.col("same").isNotNull())
    classes = stage(rows.groupBy("same").agg(F.min("id").alias("least")), "equal_sets")
    of_row = lookup_join(rows, classes, ["same"], "inner")
    # From here on the least document of equal sets stands for all of them.
    sketched = stage(
        of_row.filter("id = least").dropDuplicates(["id", "same"]).select("id", "n", "sketch", "fine"),
        "classes",
    )
    # Different sets under one id are linked by that.
    one_id = of_row.groupBy("id").agg(
        F.min("least").alias("v"), F.max("least").alias("most"), F.collect_set("least").alias("all")
    )
    equal = stage(
        one_id.filter("v < most").select(F.explode("all").alias("u"), "v").filter("u <> v"),
        "equal_links",
    )
    plain = texts.filter(F.col("id").isNotNull())
    readers = lookup_join(plain, sketched.select("id").distinct(), ["id"], "left_semi")

    # Meeting places with two documents or more.
    at = W.partitionBy("key")
    met = readers.mapInArrow(
        lambda batches: _keys(batches, width, threshold), "key bigint, id bigint"
    )
    places = stage(
        met.withColumns(
            {"least": F.min("id").over(at), "most": F.max("id").over(at)}
        ).filter("least < most").select("key", "id", "least"),
        "meetings",
    )
    star = places.filter("id <> least").groupBy(F.col("least").alias("v"), F.col("id").alias("u")).agg(
        F.count(F.lit(1)).alias("times")
    )
    candidates = stage(_close(star, sketched, threshold), "star_pairs")

    # First one verified pair per document, then what still joins different components.
    best = candidates.groupBy("u").agg(
        F.max(F.struct("times", (-F.col("v")).alias("v"))).alias("best")
    ).select("u", (-F.col("best.v")).alias("v"))
    links = stage(_verify(best, sketched, plain, width, threshold).unionByName(equal), "links_1")
    found = components(links)

    rest = _across(candidates.join(best, ["u", "v"], "left_anti").select("u", "v"), found)
    links = stage(links.unionByName(_verify(rest, sketched, plain, width, threshold)), "links_2")
    found = components(links)

    # Places that still hold several components: their pairs across components.
    placed = _labelled(places.select("key", "id"), "id", found, "component")
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("first"), F.max("component").alias("last")
    ).filter("first < last").select("key")
    open_places = stage(placed.join(mixed, "key"), "open_places")
    rows = open_places.join(sketched.select("id", "n", "sketch"), "id")
    rows = stage(rows, "open_sketches")
    crossing = F.col("a.component") < F.col("b.component")
    tried = candidates.select("u", "v").unionByName(
        candidates.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )
    pairs = (
        rows.alias("a")
        .join(rows.alias("b"), (F.col("a.key") == F.col("b.key")) & crossing & _may_link(threshold))
        .select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
        .distinct()
        .join(tried, ["u", "v"], "left_anti")
    )
    last = stage(_verify(stage(pairs, "open_pairs"), sketched, plain, width, threshold), "links_3")
    found = components(links.unionByName(last))

    rows = lookup_join(read.select("id", "n", "same"), classes, ["same"], "left")
    start = F.coalesce("least", "id")
    named = _labelled(rows.select("id", "n", start.alias("start")), "start", found, "component_id")
    return named.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def _close(pairs: DataFrame, sketched: DataFrame, threshold) -> DataFrame:
    """The pairs that sizes and dense sketches do not rule out."""
    side = lambda name: sketched.select(F.col("id").alias(name), F.struct("n", "sketch").alias(f"_{name}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    renamed = joined.withColumnsRenamed({"_u": "a", "_v": "b"})
    return renamed.filter(_may_link(threshold)).groupBy("u", "v").agg(F.max("times").alias("times"))


def _labelled(rows: DataFrame, node: str, found: DataFrame, name: str) -> DataFrame:
    """Add the component of ``node`` as ``name``."""
    of = found.select(F.col("node").alias(node), F.col("component").alias("_component"))
    joined = lookup_join(rows, of, [node], "left")
    return joined.withColumn(name, F.coalesce("_component", node)).drop("_component")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    both = _labelled(_labelled(pairs, "u", found, "_cu"), "v", found, "_cv")
    return both.filter("_cu <> _cv").select("u", "v")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group: the one whose id names the component.

    Rows that share an id are one document and stay or go together; a null id always stays.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    judged = near_duplicates(plain, doc_id, text, **settings)
    gone = judged.filter(F.col(doc_id) != F.col("component_id")).select(doc_id).distinct()
    return lookup_join(plain, gone, [doc_id], "left_anti").toDF(*names)
