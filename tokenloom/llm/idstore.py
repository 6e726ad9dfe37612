"""Token ids of documents in raw shard files, with keyed access by a minimal perfect hash.

Texts are sorted by document, encoded by a public tokenizer and written by the tasks that hold them.
Files of the shared folder:

- a shard is a head of 16 bytes (magic, version, bytes per id, two zeros) and then the ids of one
  document after the other as little-endian unsigned numbers of two or four bytes;
- an index file holds blocks; a block has the levels of a minimal perfect hash and then, slot by
  slot, records of 20 bytes: fingerprint, shard, place of the first id in its shard, number of ids.

``write_ids`` returns a ``Store``.  ``Store.find`` takes any number of keys: each goes to its block, its slot
follows from the bits of the levels, and a key that was never stored is told by its fingerprint
(one in 2^32 is not).  ``Store.read`` then reads the ids at the places found.  Tasks name their files
anew on every attempt, and only those that a finished task names in its result are ever read, so a lost executor leaves
nothing behind that counts.

Defined results: null text counts as empty, so its ids are the end id alone; null doc_ids come last;
rows of one doc_id follow each other in the order of a hash of their texts, their key finds the first of them, and rows
without a key of their own are read by place; an empty table gives a store without shards; other
columns play no part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import new_path, stage
from . import perfect
from .files import file_system
from .words import NewWords, Remembered, word_tokenizer

SHARD_BYTES = 256 * 1024 * 1024
BLOCK_KEYS = 8192
_TEXT_BYTES = 1 << 20
_READ_BYTES = 8 * 1024 * 1024
_HEAD, _HEAD_BYTES = "<8sIHH", 16
_MAGIC, _VERSION = b"TLIDS\x00\x00\x00", 1
_RECORD = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u4")])

_ROW = "doc_id bigint, shard string, part bigint, at bigint, n bigint"
_BLOCK = "block bigint, file string, offset bigint, bytes bigint, keys bigint"
_PLACE = "key bigint, shard_no bigint, at bigint, n bigint"


def _encoder(tokenizer: str, dtype) -> Remembered:
    held = _encoders.get((tokenizer, dtype))
    if held is None:
        held = _encoders[tokenizer, dtype] = Remembered(NewWords(word_tokenizer(tokenizer)), dtype)
    return held


_encoders: dict = {}


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Rows of about a megabyte of text at a time: ids and texts."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(doc_id.as_py())
            texts.append(text)
            size += len(text)
            if size >= _TEXT_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


@dataclass
class Store:
    """What was written: ``rows`` (doc_id, shard_no, at, n, first) of every document, ``shards``
    (shard_no, path, base) and ``blocks`` (block, file, offset, bytes, keys), all staged tables."""

    rows: DataFrame
    shards: DataFrame
    blocks: DataFrame
    n_blocks: int
    width: int
    folder: str

    def find(self, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
        """``(key, shard_no, at, n)`` of every key that is stored."""
        folder, n_blocks = self.folder, self.n_blocks
        if not n_blocks:
            return keys.sparkSession.createDataFrame([], _PLACE)

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = perfect.block_of(perfect.mixed(batch.column(0).to_numpy()), n_blocks)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks)], ["key", "block"])

        asked = keys.select(F.col(key_col).cast("bigint").alias("key")).filter("key IS NOT NULL")
        asked = asked.mapInArrow(named, "key bigint, block bigint")
        asked = lookup_join(asked, self.blocks.select("block", "file", "offset", "bytes"), ["block"], "inner")
        # Keys of a block are spread if they are many: a block may be read by several tasks.
        dealt = asked.repartition("block", F.shiftright(F.xxhash64("key"), 62)).sortWithinPartitions("block")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, _ = file_system(folder)
            current, block = None, None
            for batch in batches:
                numbers = batch.column("block").to_numpy()
                edges = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else []
                for start, end in zip(edges, [*edges[1:], len(numbers)], strict=True):
                    if numbers[start] != current:
                        current = numbers[start]
                        with system.open_input_file(batch.column("file")[start].as_py()) as file:
                            file.seek(batch.column("offset")[start].as_py())
                            block = Block(file.read(batch.column("bytes")[start].as_py()))
                    keys = batch.column("key").to_numpy()[start:end]
                    held, records = block.find(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[held])]
                        + [pa.array(records[c].astype(np.int64)) for c in ("shard", "at", "n")],
                        ["key", "shard_no", "at", "n"],
                    )

        return dealt.mapInArrow(look, _PLACE)

    def read(self, places: DataFrame, results: dict[str, str], take) -> DataFrame:
        """``(key, start, n)`` and the columns ``results`` (name to type) of every place.

        ``take`` turns the ids of one document, an array of unsigned numbers, into their values.
        ``start`` counts the ids of all documents before it.
        """
        folder, width = self.folder, self.width
        kinds = ", ".join(f"{c} {t}" for c, t in results.items())
        schema = "key bigint, start bigint, n bigint" + (f", {kinds}" if kinds else "")
        joined = lookup_join(places, self.shards, ["shard_no"], "inner")
        # Neighbours are read together; the pieces of a shard spread over tasks.
        piece = F.floor(F.col("at") * width / _READ_BYTES)
        dealt = joined.repartition("shard_no", piece).sortWithinPartitions("shard_no", "at")

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, _ = file_system(folder)
            path, file = None, None
            for batch in batches:
                names = batch.column("path").to_pylist()
                at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
                out: list[list] = [[] for _ in results]
                for i, name in enumerate(names):
                    if name != path:
                        path, file = name, _opened(system, name, width)
                    file.seek(_HEAD_BYTES + int(at[i]) * width)
                    data = file.read(int(n[i]) * width)
                    if len(data) != n[i] * width:
                        raise ValueError(f"{name} ends inside a document")
                    for values, value in zip(out, take(np.frombuffer(data, dtype=f"<u{width}")), strict=True):
                        values.append(value)
                starts = pa.array(batch.column("base").to_numpy() + at)
                columns = [batch.column("key"), starts, batch.column("n"), *map(pa.array, out)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n", *results])

        return dealt.select("key", "path", "at", "n", "base").mapInArrow(load, schema)


def _opened(system, name: str, width: int):
    file = system.open_input_file(name)
    magic, version, kept, _ = struct.unpack(_HEAD, file.read(_HEAD_BYTES))
    if (magic, version, kept) != (_MAGIC, _VERSION, width):
        raise ValueError(f"{name} is no shard of this store")
    return file


class Block:
    """One block of an index file."""

    def __init__(self, data: bytes) -> None:
        n, count = struct.unpack_from("<II", data)
        sizes = np.frombuffer(data, dtype="<u4", count=count, offset=8)
        at = 8 + 4 * count
        self.levels = []
        for size in sizes.tolist():
            packed = np.frombuffer(data, dtype=np.uint8, count=size // 8, offset=at)
            self.levels.append(np.unpackbits(packed).astype(bool))
            at += size // 8
        self.records = np.frombuffer(data, dtype=_RECORD, count=n, offset=at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ``keys`` are held, and their records."""
        hashes = perfect.mixed(keys)
        slots = perfect.slots(self.levels, hashes)
        held = slots >= 0
        held[held] = self.records["mark"][slots[held]] == perfect.fingerprint(hashes[held])
        return held, self.records[slots[held]]


def packed_block(keys: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """The bytes of a block of distinct keys."""
    hashes = perfect.mixed(keys)
    levels = perfect.build(hashes)
    records = np.empty(len(keys), dtype=_RECORD)
    slots = perfect.slots(levels, hashes)
    for name, values in (("mark", perfect.fingerprint(hashes)), ("shard", shard), ("at", at), ("n", n)):
        records[name][slots] = values
    head = struct.pack(f"<II{len(levels)}I", len(keys), len(levels), *map(len, levels))
    return head + b"".join(np.packbits(bits).tobytes() for bits in levels) + records.tobytes()


def _write_shards(folder: str, tokenizer: str, end_id: int, width: int, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        encoder = _encoder(tokenizer, f"<u{width}")
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        out, name, at, part = None, "", 0, -1
        for doc_ids, texts in _portions(batches):
            names, parts, places, sizes = [], [], [], []
            for ids in encoder.ids(texts):
                if out is None:
                    name, at, part = f"{base}/{uuid.uuid4().hex}.ids", 0, part + 1
                    out = system.open_output_stream(name, compression=None)
                    out.write(struct.pack(_HEAD, _MAGIC, _VERSION, width, 0))
                out.write(ids.tobytes() + end)
                names.append(name)
                parts.append(part)
                places.append(at)
                sizes.append(len(ids) + 1)
                at += len(ids) + 1
                if at * width >= shard_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(names, pa.string())]
                + [pa.array(x, pa.int64()) for x in (parts, places, sizes)],
                ["doc_id", "shard", "part", "at", "n"],
            )
        if out is not None:
            out.close()

    return write


def _write_blocks(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name, out, offset = f"{base}/{uuid.uuid4().hex}.index", None, 0
        current, held = None, []

        def close_block():
            nonlocal offset
            keys, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
            data = packed_block(keys, *columns)
            out.write(data)
            row = (int(current), name, offset, len(data), len(keys))
            offset += len(data)
            return pa.RecordBatch.from_pylist(
                [dict(zip(("block", "file", "offset", "bytes", "keys"), row, strict=True))]
            )

        for batch in batches:
            numbers = batch.column("block").to_numpy()
            if not len(numbers):
                continue
            if out is None:
                out = system.open_output_stream(name, compression=None)
            columns = [batch.column(c).to_numpy() for c in ("doc_id", "shard_no", "at", "n")]
            edges = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
            for start, end in zip(edges, [*edges[1:], len(numbers)], strict=True):
                if numbers[start] != current:
                    if held:
                        yield close_block()
                    current, held = numbers[start], []
                held.append([c[start:end] for c in columns])
        if held:
            yield close_block()
        if out is not None:
            out.close()

    return write


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 2,
    shard_bytes: int = SHARD_BYTES,
    block_keys: int = BLOCK_KEYS,
) -> Store:
    """Encode ``docs`` into shards and index them by document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Equal rows of one document are told apart by a number, so a sort block never has to hold them all.
    ready = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    ).orderBy(F.asc_nulls_last("doc_id"), "tie", "row")
    folder = new_path(spark, "id_shards")
    # What the tasks return is staged with the key, so shards can be put in order.
    keyed = ready.select("doc_id", "text")
    written = stage(
        keyed.mapInArrow(_write_shards(folder, tokenizer, end_id, width, shard_bytes), _ROW).withColumn(
            "task", F.spark_partition_id()
        ),
        "id_rows",
    )
    # One row a shard, that is one for 256 MB of ids or for a sort block.  Sort blocks are numbered in order.
    by_shard = written.groupBy("shard").agg(
        F.min("task").alias("task"), F.min("part").alias("part"), F.sum("n").alias("ids")
    )
    order = W.orderBy("task", "part")
    before = F.coalesce(F.sum("ids").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = stage(
        by_shard.select(
            (F.row_number().over(order) - 1).cast("bigint").alias("shard_no"),
            F.col("shard").alias("path"),
            before.alias("base"),
        ),
        "id_shards",
    )
    named = shards.select("shard_no", F.col("path").alias("shard"))
    rows = lookup_join(written, named, ["shard"], "inner").select("doc_id", "shard_no", "at", "n")
    place = F.struct("shard_no", "at")
    firsts = (
        rows.filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min(F.struct("shard_no", "at", "n")).alias("first"), F.count(F.lit(1)).alias("rows"))
    )
    firsts = stage(firsts, "id_keys")
    repeated = firsts.filter("rows > 1").select("doc_id", F.struct("first.shard_no", "first.at").alias("kept"))
    rows = stage(
        lookup_join(rows, stage(repeated, "id_repeats"), ["doc_id"], "left").select(
            "doc_id", "shard_no", "at", "n",
            (F.col("doc_id").isNotNull() & (F.col("kept").isNull() | (place == F.col("kept")))).alias("first"),
        ),
        "id_places",
    )
    n_keys = firsts.count()
    n_blocks = -(-n_keys // block_keys)
    index = new_path(spark, "id_index")

    def named_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = perfect.block_of(perfect.mixed(batch.column(0).to_numpy()), n_blocks)
            yield batch.append_column("block", pa.array(blocks))

    keys = firsts.select("doc_id", "first.shard_no", "first.at", "first.n")
    blocks = stage(
        keys.mapInArrow(named_blocks, "doc_id bigint, shard_no bigint, at bigint, n bigint, block bigint")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_write_blocks(index), _BLOCK),
        "id_blocks",
    )
    return Store(rows, shards, blocks, n_blocks, width, folder)


def crc32(ids: np.ndarray) -> tuple[int]:
    """The checksum of ids as little-endian unsigned 32-bit numbers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def stored_checksums(store: Store) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files.

    Documents are found by key; rows without a key of their own by their place.
    """
    keyed = store.find(store.rows.filter("first").select("doc_id"))
    others = store.rows.filter("NOT first").select(F.col("doc_id").alias("key"), "shard_no", "at", "n")
    places = stage(keyed.unionByName(others), "id_found")
    return store.read(places, {"ids_crc32": "bigint"}, crc32).select(
        F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32"
    )
