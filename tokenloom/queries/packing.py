"""Zip archives made from a table, as input for the archive queries and tests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ARCHIVE_SCHEMA = "user string, repo string, content binary"
_ARCHIVES = pa.schema([("user", pa.string()), ("repo", pa.string()), ("content", pa.binary())])


def pack_archives(files: DataFrame, max_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Zip ``(user, repo, path, text)`` rows.  A task fills one
    archive per repository it meets and closes all of them at ``max_bytes``."""

    def packed(groups: dict) -> Iterator[pa.RecordBatch]:
        for (user, repo), members in groups.items():
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                for path, data in members:
                    archive.writestr(path, data)
            row = {"user": user, "repo": repo, "content": buffer.getvalue()}
            yield pa.RecordBatch.from_pylist([row], _ARCHIVES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size = {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                data = row["text"].encode("utf-8")
                groups.setdefault((row["user"], row["repo"]), []).append((row["path"], data))
                size += len(data)
                if size >= max_bytes:
                    yield from packed(groups)
                    groups, size = {}, 0
        yield from packed(groups)

    return files.select("user", "repo", "path", "text").mapInArrow(pack, ARCHIVE_SCHEMA)
