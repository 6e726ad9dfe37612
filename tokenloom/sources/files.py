"""Reading repository lists and trees of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.corpus import parse_repo_lines


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_repo_lines(spark.read.text(path))


def decode_utf8(content: Column) -> Column:
    """Text of a file; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def list_source_files(spark: SparkSession, directory: str, suffix: str = ".py") -> DataFrame:
    """``(path, basename, length)`` of the files below ``directory``.

    ``content`` is not selected, so no file is opened.
    """
    return _scan(spark, directory, suffix).select(
        "path", P.basename(F.col("path")).alias("basename"), "length"
    )


def scan_source_files(spark: SparkSession, directory: str, suffix: str = ".py") -> DataFrame:
    """``(user, repo, path, basename, text)`` of ``directory/user/repo/**``."""
    scanned = _scan(spark, directory, suffix)
    path = F.col("path")
    above = F.split(relative_path(spark, directory, path), "/")
    return scanned.select(
        F.get(above, F.lit(0)).alias("user"),
        F.get(above, F.lit(1)).alias("repo"),
        "path",
        P.basename(path).alias("basename"),
        decode_utf8(F.col("content")).alias("text"),
    )


def relative_path(spark: SparkSession, directory: str, path: Column) -> Column:
    """Path below ``directory``; the scan reports absolute URIs.

    The folder is resolved by its file system, and exactly that prefix is cut.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    bare = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.when(bare.startswith(root), F.substring(bare, len(root) + 1, 1 << 30)).otherwise(bare)


def _scan(spark: SparkSession, directory: str, suffix: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .load(directory)
    )
