"""Taking in new repositories, and encoding new documents, as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lexicon as L
from ..operators import corpus
from ..operators.encoding import encode_documents, long_enough, vocab_fits
from ..plans.lookup import lookup_join
from ..plans.staging import stage, temporary
from ..sources import archives, files, store

DOCUMENT_SCHEMA = "doc_id bigint, text string"
DELIVERY_SCHEMA = "delivery bigint, folder string"
FILE_SCHEMA = "user string, repo string, path string, text string"

# From the rows of a micro-batch and the manifest: files found, repositories taken.
Reader = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def document_stream(
    spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA, files_per_trigger: int = 1000
) -> DataFrame:
    """Documents from Parquet files; each file is taken up once."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stream_encode(
    documents: DataFrame,
    vocab: DataFrame,
    output: str,
    checkpoint: str,
    min_tokens: int = L.MIN_TOKENS,
    on_missing: str = "error",
) -> StreamingQuery:
    """Encode every new document against a fixed, stored vocabulary.

    Runs until all waiting files are done.  Each micro-batch owns one output
    folder, which a replay overwrites, so results are exactly once.
    """

    fits = vocab_fits(vocab)

    def write(batch: DataFrame, batch_id: int) -> None:
        encoded = long_enough(
            encode_documents(batch, vocab, on_missing=on_missing, fits=fits), min_tokens
        )
        encoded.write.mode("overwrite").option("compression", "zstd").parquet(
            f"{output}/batch={batch_id}"
        )

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def archive_stream(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    """``(user, repo, content)`` of ``user_name.zip`` files as they appear; each file is taken up once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(directory)
    )
    return archives.named(found).select("user", "repo", "content")


def read_archives(suffix: str = ".py") -> Reader:
    """Reads the rows of :func:`archive_stream`; an archive that cannot be read to its end is not
    taken, and neither is its repository."""

    def read(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        members = archives.unpack_archives(corpus.skip_ingested(batch, known), suffix)
        members = stage(members, "members")
        bad = archives.rejected(members).select("user", "repo").distinct()
        repos = corpus.skip_ingested(batch.select("user", "repo"), known).distinct()
        found = archives.accepted(members).select(
            "user", "repo", F.col("member_path").alias("path"),
            files.decode_utf8(F.col("content")).alias("text"),
        )
        return found, repos.join(bad, ["user", "repo"], "left_anti")

    return read


def read_deliveries(schema: str = FILE_SCHEMA) -> Reader:
    """Reads the folders that ``(delivery, folder)`` rows announce: Parquet files of ``(user, repo, path)`` and
    any values.  A folder is announced once it is whole.  A repository is taken from its first
    delivery; of several that arrive together, from the lowest number."""

    def read(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = batch.sparkSession
        # The files of a trigger are limited, and so are their announcements.
        rows = batch.select("delivery", "folder").distinct().collect()
        each = [
            spark.read.schema(schema).parquet(row.folder).withColumn("_delivery", F.lit(row.delivery))
            for row in rows
        ]
        if not each:
            empty = spark.createDataFrame([], schema)
            return empty, empty.select("user", "repo")
        found = corpus.skip_ingested(reduce(DataFrame.unionByName, each), known)
        first = found.groupBy("user", "repo").agg(F.min("_delivery").alias("_delivery"))
        first = stage(first, "deliveries")
        kept = lookup_join(found, first, ["user", "repo", "_delivery"], "left_semi")
        return kept.drop("_delivery"), first.select("user", "repo")

    return read


def ingest_batch(batch: DataFrame, base: str, run: str, read: Reader, suffix: str = ".py") -> bool:
    """Take the new repositories of ``batch`` into ``base`` as ``run``; whether there was anything to do.

    A run that is finished is left as it is, one that died is replaced, so a batch may be
    given again at any time.
    """
    spark = batch.sparkSession
    if run in store.finished_runs(spark, base):
        return False
    with temporary(spark):
        found, repos = read(batch, store.read_manifest(spark, base))
        store.file_run(found, repos, base, run, suffix)
    return True


def stream_ingest(
    arrivals: DataFrame, base: str, checkpoint: str, read: Reader, suffix: str = ".py"
) -> StreamingQuery:
    """Take new repositories into ``base`` as they arrive; runs until all waiting files are done.

    Each micro-batch is an ingestion run of its own, named by stream and batch, whose manifest is written
    last.  A batch that Spark replays finds its run finished, or replaces what it left behind.  A repository of
    an earlier run is not taken again.  What is taken can be encoded, and counted run by run,
    like anything else in ``base``.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        # The identity is kept in the checkpoint, so a new checkpoint is another stream.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise ValueError("the stream has no identity")
        ingest_batch(batch, base, f"run={stream}-{batch_id:09d}", read, suffix)

    return (
        arrivals.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
