"""Files of a format of their own in the folder all executors share."""

from __future__ import annotations

# Names under which Spark's writers know a store, and those of Arrow's file systems.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "wasbs": "abfss"}


def file_system(address: str):
    """``(file system, path)`` for a folder as Spark names it."""
    from pyarrow import fs

    scheme, mark, rest = address.partition("://")
    if not mark:
        scheme, mark, rest = address.partition(":")
        if scheme == "file" and mark:
            return fs.FileSystem.from_uri(f"file://{rest}")
        return fs.FileSystem.from_uri(address)
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def exists(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound
