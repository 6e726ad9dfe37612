"""Choosing the files of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.lookup import BROADCAST_LIMIT, lookup_join
from ..plans.ordering import dense_index

_WHITE = " \t\n\r\f\v"


def parse_repo_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(user, repo)`` from ``user/name`` lines; comments (only when the line
    itself starts with ``#``), blank and malformed lines are dropped."""
    parts = F.split(F.btrim(F.col(col), F.lit(_WHITE)), "/")
    return (
        lines.filter(~F.col(col).startswith("#"))
        .withColumn("_p", parts)
        .filter((F.btrim(F.col(col), F.lit(_WHITE)) != "") & (F.size("_p") == 2))
        .select(F.col("_p")[0].alias("user"), F.col("_p")[1].alias("repo"))
    )


def filter_extension(files: DataFrame, path_col: str = "path", suffix: str = ".py") -> DataFrame:
    return files.filter(P.has_suffix(F.col(path_col), suffix))


def filter_basename(files: DataFrame, path_col: str = "path") -> DataFrame:
    return files.filter(P.is_source_name(P.basename(F.col(path_col))))


def prune_test_dirs(
    files: DataFrame, path_col: str = "path", rooted: bool = True, prefix: str = "test"
) -> DataFrame:
    """Drop files below a folder starting with ``prefix``; with ``rooted`` the
    first component is the project folder, which is exempt."""
    path = F.col(path_col)
    return files.filter(~P.in_test_dir(P.below_root(path) if rooted else path, prefix))


def select_sources(files: DataFrame, path_col: str = "path", suffix: str = ".py") -> DataFrame:
    """All three file rules."""
    return prune_test_dirs(
        filter_basename(filter_extension(files, path_col, suffix), path_col), path_col
    )


def dedup_basename(
    files: DataFrame, repo_cols: Sequence[str] = ("user", "repo"), path_col: str = "path"
) -> DataFrame:
    """One path per repository and basename: the deepest, then the last by name.

    An aggregate rather than a ranking window: it is combined before the
    shuffle, so a basename shared by very many files is no hot group.  Only
    paths take part; join back for contents.
    """
    path = F.col(path_col)
    winner = F.max(F.struct(P.depth(path).alias("depth"), path.alias("path")))
    return (
        files.groupBy(*repo_cols, P.basename(path).alias("basename"))
        .agg(winner.alias("_w"))
        .select(*repo_cols, "basename", F.col("_w.path").alias(path_col))
    )


def skip_ingested(
    files: DataFrame,
    manifest: DataFrame,
    keys: Sequence[str] = ("user", "repo"),
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Files whose repository the manifest does not list."""
    return lookup_join(files, manifest.select(*keys).distinct(), keys, "left_anti", limit)


def choose_files(
    found: DataFrame, suffix: str = ".py", keys: Sequence[str] = ("user", "repo")
) -> DataFrame:
    """The files to take of ``(keys, path, ...)`` rows, with all their columns:
    chosen on the paths alone, joined back to the rest.

    A chosen path is unique in its repository, so the join has no hot key; of rows with
    equal paths the files are the same and all stay.
    """
    narrow = found.select(*keys, "path")
    chosen = dedup_basename(select_sources(narrow, "path", suffix), keys)
    return lookup_join(found, chosen.select(*keys, "path"), [*keys, "path"], "left_semi")


def corpus_stats(files: DataFrame, path_col: str = "path", suffix: str = ".py") -> DataFrame:
    """One row: files in all, files with the suffix."""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(P.has_suffix(F.col(path_col), suffix)).alias("n_source_files"),
    )


def number_documents(files: DataFrame, path_col: str = "path", id_col: str = "doc_id") -> DataFrame:
    """Add a dense document id in path order."""
    return dense_index(files, [F.col(path_col)], id_col, "documents")
