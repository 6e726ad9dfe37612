"""Zip archives as tables of their members."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = "user string, repo string, member_path string, content binary, error string"
# Larger files do not fit into a cell.
MAX_ARCHIVE_BYTES = (1 << 31) - 1024

_MEMBERS = pa.schema(
    [
        ("user", pa.string()),
        ("repo", pa.string()),
        ("member_path", pa.string()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
_BAD = (
    zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, OSError, EOFError, ValueError,
    NotImplementedError, RuntimeError,
)


def named(archives: DataFrame) -> DataFrame:
    """Add ``user`` and ``repo`` from the name of the file in ``path``."""
    stem = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    return archives.withColumns(
        {
            "user": F.substring_index(stem, "_", 1),
            "repo": F.regexp_replace(stem, F.lit("^[^_]*_"), F.lit("")),
        }
    )


def _archive_files(spark: SparkSession, directory: str) -> DataFrame:
    return named(
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.zip")
        .load(directory)
    )


def scan_archives(
    spark: SparkSession, directory: str, max_bytes: int = MAX_ARCHIVE_BYTES
) -> DataFrame:
    """``(user, repo, content)`` of ``user_name.zip`` files of up to ``max_bytes``;
    the others are not opened, :func:`oversized_archives` lists them."""
    archives = _archive_files(spark, directory)
    return archives.filter(F.col("length") <= max_bytes).select("user", "repo", "content")


def oversized_archives(
    spark: SparkSession, directory: str, max_bytes: int = MAX_ARCHIVE_BYTES
) -> DataFrame:
    """``(user, repo, error)`` of the archives that are too large, as :func:`rejected`."""
    archives = _archive_files(spark, directory)
    error = F.concat(F.lit("too large: "), F.col("length").cast("string"), F.lit(" bytes"))
    return archives.filter(F.col("length") > max_bytes).select("user", "repo", error.alias("error"))


def unpack_archives(
    archives: DataFrame, suffix: str = ".py", batch_bytes: int = 16 * 1024 * 1024
) -> DataFrame:
    """One row per member of each archive's project folder, the first top-level
    folder by name that is neither hidden nor made by a packing tool; paths start
    with it.  An archive that cannot be read to its end, or has no folder, gives one
    row with ``error`` set and no other, and the run goes on."""

    def members(content: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            # Of equal names the later member counts, as when unpacking.
            by_name = {info.filename: info for info in archive.infolist()}
            tops = [name.split("/")[0] for name in by_name if name.find("/") > 0]
            folders = [top for top in tops if not top.startswith(".") and top != "__MACOSX"]
            if not folders:
                raise zipfile.BadZipFile("no top-level folder")
            root = min(folders) + "/"
            wanted = [
                (name, info)
                for name, info in by_name.items()
                if name.startswith(root) and name.endswith(suffix) and ".." not in name.split("/")
            ]
            # Read through before anything is handed on: all members or none.
            for _, info in wanted:
                with archive.open(info) as member:
                    while member.read(1 << 20):
                        pass
            for name, info in wanted:
                yield name, archive.read(info)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for n in range(batch.num_rows):
                archive = batch.slice(n, 1).to_pylist()[0]
                known = {"user": archive["user"], "repo": archive["repo"]}
                try:
                    for path, content in members(archive["content"]):
                        rows.append(known | {"member_path": path, "content": content})
                        size += len(content)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, _MEMBERS)
                            rows, size = [], 0
                except _BAD as error:
                    rows.append(known | {"error": str(error) or type(error).__name__})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _MEMBERS)

    return archives.select("user", "repo", "content").mapInArrow(expand, MEMBER_SCHEMA)


def rejected(members: DataFrame) -> DataFrame:
    """Archives that could not be unpacked."""
    return members.filter(F.col("error").isNotNull()).select("user", "repo", "error")


def accepted(members: DataFrame) -> DataFrame:
    return members.filter(F.col("error").isNull()).drop("error")
