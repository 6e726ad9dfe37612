"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: basenames that are not source files of interest, matched from
# the start of the name.
EXCLUDED_BASENAME = r"^(?:__init__\.py|test_.+\.py)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def below_root(path: Column) -> Column:
    """The path without its first component (an archive's project folder)."""
    return F.regexp_replace(path, F.lit("^[^/]*/"), F.lit(""))


def root_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def depth(path: Column) -> Column:
    """Number of folders above the file."""
    return F.size(F.split(path, "/")) - 1


def has_suffix(path: Column, suffix: str = ".py") -> Column:
    """Case-sensitive end of the name."""
    return path.endswith(suffix)


def is_source_name(name: Column, excluded: str = EXCLUDED_BASENAME) -> Column:
    return ~name.rlike(excluded)


def in_test_dir(path: Column, prefix: str = "test") -> Column:
    """Some folder on a path relative to the root starts with ``prefix``."""
    return path.rlike(rf"(?:^|/)\Q{prefix}\E[^/]*/")


def destination(user: Column, repo: Column, path: Column, base: str = "repositories") -> Column:
    """Where a kept file is filed: flat below its repository."""
    return F.concat_ws("/", F.lit(base), user, repo, basename(path))
