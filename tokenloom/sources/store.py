"""Stored datasets and vocabularies (Parquet)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import paths as P
from ..operators.corpus import choose_files
from ..operators.vocabulary import VOCAB_SCHEMA, rare_lines, report_lines

ENCODED_COLUMN = "ids"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop, hadoop.Path(path).getFileSystem(configuration)


def new_run(dataset: str) -> str:
    """A folder for everything one run of ``dataset`` writes."""
    return f"{dataset.rstrip('/')}.runs/{uuid.uuid4().hex}"


def current_run(spark: SparkSession, dataset: str) -> str | None:
    """The folder of the run that ``dataset`` stands for, if one was published."""
    pointer = f"{dataset.rstrip('/')}.current"
    hadoop, system = _file_system(spark, pointer)
    if not system.exists(hadoop.Path(pointer)):
        return None
    stream = system.open(hadoop.Path(pointer))
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{dataset.rstrip('/')}.runs/{name}"


def publish_run(spark: SparkSession, dataset: str, run: str) -> None:
    """Make ``run`` the current one.  The pointer is replaced in one step, so readers see either
    run as a whole.  The run before stays for those that read it; older ones are removed."""
    dataset = dataset.rstrip("/")
    before = current_run(spark, dataset)
    pointer, fresh = f"{dataset}.current", f"{dataset}.current-{uuid.uuid4().hex}"
    hadoop, system = _file_system(spark, pointer)
    stream = system.create(hadoop.Path(fresh), True)
    try:
        stream.write(bytearray(run.rsplit("/", 1)[1].encode()))
    finally:
        stream.close()
    context = hadoop.FileContext.getFileContext(
        system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(
        system.makeQualified(hadoop.Path(fresh)), system.makeQualified(hadoop.Path(pointer)), options
    )
    kept = {path.rsplit("/", 1)[1] for path in (run, before) if path}
    for status in system.listStatus(hadoop.Path(f"{dataset}.runs")):
        if status.getPath().getName() not in kept:
            system.delete(status.getPath(), True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a table that was written to its end."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def write_encoded(encoded: DataFrame, path: str, redo: bool = False) -> None:
    """Write an encoded dataset; a finished one is kept unless ``redo``.  What a
    failed run left behind is replaced."""
    if redo or not complete(encoded.sparkSession, path):
        encoded.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """An encoded dataset, or that of its current run; a missing one, or one without ids, is an error."""
    run = current_run(spark, path)
    path = path if run is None else f"{run}/dataset"
    if not complete(spark, path):
        raise FileNotFoundError(f"{path} not found or not finished: encode the corpus first")
    encoded = spark.read.parquet(path)
    if ENCODED_COLUMN not in encoded.columns:
        raise ValueError(f"{path} has no column {ENCODED_COLUMN}")
    return encoded


def vocab_path(base: str, threshold: int = L.FREQUENCY_THRESHOLD, corpus: str | None = None) -> str:
    """Vocabularies of different thresholds, and of different corpora, are kept apart."""
    path = f"{base.rstrip('/')}/threshold={threshold}"
    return path if corpus is None else f"{path}/corpus={corpus}"


def write_vocab(vocab: DataFrame, base: str, threshold: int = L.FREQUENCY_THRESHOLD) -> None:
    vocab.write.mode("errorifexists").parquet(vocab_path(base, threshold))


def read_vocab(
    spark: SparkSession,
    base: str,
    threshold: int = L.FREQUENCY_THRESHOLD,
    corpus: str | None = None,
) -> DataFrame:
    return spark.read.schema(VOCAB_SCHEMA).parquet(vocab_path(base, threshold, corpus))


def get_vocab(
    spark: SparkSession,
    base: str,
    build,
    threshold: int = L.FREQUENCY_THRESHOLD,
    corpus: str | None = None,
    redo: bool = False,
) -> DataFrame:
    """The stored vocabulary, or else ``build(threshold)``, stored first; ``redo``
    builds it anew.  ``corpus`` names what it was built from."""
    path = vocab_path(base, threshold, corpus)
    # The marker is written last, so a half-written vocabulary is not reused.
    if redo or not complete(spark, path):
        vocab = build(threshold)
        vocab.write.mode("overwrite").parquet(path)
    vocab = read_vocab(spark, base, threshold, corpus)
    duplicated = vocab.groupBy("key").count().filter(F.col("count") > 1)
    if not duplicated.isEmpty():
        raise ValueError("the vocabulary has duplicate keys")
    return vocab


def write_report(
    frequency: DataFrame, rare: DataFrame, path: str
) -> None:
    """Vocabulary statistics as text: counts, then the rare tokens by type; an
    older report is replaced."""
    report_lines(frequency).write.mode("overwrite").text(f"{path}/counts")
    rare_lines(rare).write.mode("overwrite").text(f"{path}/rare")


def write_table(table: DataFrame, path: str) -> DataFrame:
    """Write ``table``, replacing an older one, and read it back."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_ignored(short: DataFrame, path: str) -> None:
    """The documents left out for their length."""
    short.write.mode("overwrite").parquet(path)


def fingerprint(files: DataFrame, *contents: str) -> str:
    """A name for a set of files, from their paths and contents, in any order."""
    mixed = [
        F.sum(F.xxhash64(F.lit(salt), "path", *contents).cast("decimal(38,0)")).alias(f"mixed{salt}")
        for salt in (0, 1)
    ]
    row = files.agg(F.count(F.lit(1)).alias("n"), *mixed)
    return row.select(F.md5(F.concat_ws("-", "n", "mixed0", "mixed1"))).head()[0]


def read_run(spark: SparkSession, dataset: str):
    """The one row of settings of the current run of ``dataset``."""
    run = current_run(spark, dataset)
    path = f"{dataset}.run" if run is None else f"{run}/settings"
    if not complete(spark, path):
        raise FileNotFoundError(f"{path} not found: encode the corpus first")
    rows = spark.read.parquet(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} does not have exactly one row")
    return rows[0]


def finished_runs(spark: SparkSession, base: str) -> list[str]:
    """The ingestion runs whose manifest was written to its end."""
    return _finished(spark, f"{base}/manifest/run=*")


def _finished(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the tables matching ``pattern`` that were written to their end."""
    hadoop, system = _file_system(spark, pattern)
    marked = system.globStatus(hadoop.Path(f"{pattern}/_SUCCESS")) or []
    return sorted(m.getPath().getParent().getName() for m in marked)


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """``(user, repo)`` of everything ingested into ``base``."""
    runs = [f"{base}/manifest/{run}" for run in finished_runs(spark, base)]
    reader = spark.read.schema("user string, repo string")
    return reader.parquet(*runs) if runs else spark.createDataFrame([], "user string, repo string")


def read_ingested(
    spark: SparkSession, base: str, runs: Sequence[str] | None = None, values: str = "text string"
) -> DataFrame:
    """``(user, repo, path, values)`` of the files of the finished runs, or of ``runs`` alone."""
    schema = f"user string, repo string, path string, {values}"
    folders = [f"{base}/files/{run}" for run in (finished_runs(spark, base) if runs is None else runs)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def file_run(found: DataFrame, repos: DataFrame, base: str, run: str, suffix: str = ".py") -> DataFrame:
    """File the chosen ones of the ``found`` files, and list ``repos`` as taken.

    ``found`` are ``(user, repo, path)`` and any values.  The manifest is written last and
    marks the run as finished; a run of the same name that died is replaced.
    """
    chosen = choose_files(found, suffix)
    filed = P.destination(F.col("user"), F.col("repo"), F.col("path"), base)
    values = [c for c in found.columns if c not in ("user", "repo", "path")]
    files = chosen.select("user", "repo", filed.alias("path"), *values)
    written = write_table(files, f"{base}/files/{run}")
    write_table(repos.select("user", "repo"), f"{base}/manifest/{run}")
    return written


def count_parts(spark: SparkSession, base: str) -> dict[str, list[str]]:
    """The stored counts of ``base``: name of the part, runs it covers.  A run in two parts raises."""
    names = [name.split("=", 1)[1] for name in _finished(spark, f"{base}/counts/covers/part=*")]
    parts: dict[str, list[str]] = {name: [] for name in names}
    if names:
        folders = [f"{base}/counts/covers/part={name}" for name in names]
        # One name for each run, not for each repository or file.
        for row in spark.read.schema("part string, run string").parquet(*folders).toLocalIterator():
            parts[row.part].append(row.run)
    covered = [run for runs in parts.values() for run in runs]
    if len(covered) != len(set(covered)):
        raise ValueError(f"{base}/counts covers a run twice")
    return parts


def write_counts(
    spark: SparkSession, base: str, runs: Sequence[str], lexed: DataFrame, count
) -> None:
    """Store the tokens of ``runs`` and ``count(tokens)`` as one part.  The list of the runs it
    covers is written last; without it the part does not count."""
    name = hashlib.md5(",".join(sorted(runs)).encode()).hexdigest()
    tokens = write_table(lexed, f"{base}/counts/tokens/part={name}")
    write_table(count(tokens), f"{base}/counts/frequency/part={name}")
    covers = spark.createDataFrame([(name, run) for run in sorted(runs)], "part string, run string")
    write_table(covers, f"{base}/counts/covers/part={name}")


def read_counts(spark: SparkSession, base: str, table: str, schema) -> DataFrame:
    """``tokens`` or ``frequency`` of all finished parts."""
    folders = [f"{base}/counts/{table}/part={name}" for name in count_parts(spark, base)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
