"""The runs of the library end to end: ingest, encode, fit, complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as L
from .functions import paths as P
from .operators import completion, corpus, encoding, metrics, sequences, vocabulary
from .operators.tokens import explode_tokens, lex_documents
from .plans.lookup import BROADCAST_LIMIT, measured_bytes
from .plans.staging import stage, temporary
from .sources import archives, files, store

TOKENS_SCHEMA = "path string, tokens array<struct<t_type: string, token: string>>"


def ingest(
    spark: SparkSession,
    source: str,
    base: str = "repositories",
    suffix: str = ".py",
    packed: bool = True,
) -> int:
    """Take the source files of new repositories into ``base``; the number taken.

    ``source`` holds ``user_repo.zip`` archives, or with ``packed=False`` a tree
    ``user/repo/**``.  Files are chosen on their paths alone, one per basename and
    repository; the contents of the chosen ones follow and are filed as
    ``repositories/user/repo/basename``.  The manifest is written last: a run that
    died before counts for nothing, a repository in the manifest is not taken again.
    Archives that cannot be read are listed under ``rejected``.
    """
    run = uuid.uuid4().hex
    with temporary(spark):
        known = store.read_manifest(spark, base)
        if packed:
            members = archives.unpack_archives(
                corpus.skip_ingested(archives.scan_archives(spark, source), known), suffix
            )
            members = stage(members, "members")
            bad = archives.rejected(members).unionByName(archives.oversized_archives(spark, source))
            bad.write.parquet(f"{base}/rejected/run={run}")
            # All archives read to their end, also those without a source file.
            repos = corpus.skip_ingested(archives.scan_archives(spark, source).select("user", "repo"), known)
            repos = repos.join(bad.select("user", "repo"), ["user", "repo"], "left_anti").distinct()
            found = archives.accepted(members).select(
                "user", "repo", F.col("member_path").alias("path"),
                files.decode_utf8(F.col("content")).alias("text"),
            )
        else:
            scanned = files.scan_source_files(spark, source, suffix)
            below = P.below_root(files.relative_path(spark, source, F.col("path")))
            found = corpus.skip_ingested(
                scanned.select("user", "repo", below.alias("path"), "text"), known
            )
            repos = found.select("user", "repo").distinct()
        return store.file_run(found, repos, base, f"run={run}", suffix).count()


def count_runs(spark: SparkSession, base: str = "repositories") -> DataFrame:
    """``(t_type, token, count, first_seen)`` of all files ingested into ``base``.

    Tokens and counts of the ingestion runs are stored below ``counts``; only files of runs that
    were not counted before are opened, and those are counted together.  All is then merged.
    The result, and the vocabulary built from it, is that of one count over all files.  A text that
    is null counts as empty.
    """
    known = {run for runs in store.count_parts(spark, base).values() for run in runs}
    new = [run for run in store.finished_runs(spark, base) if run not in known]
    if new:
        with temporary(spark):
            texts = store.read_ingested(spark, base, new).select("path", F.coalesce("text", F.lit("")).alias("text"))

            def count(lexed: DataFrame) -> DataFrame:
                paths = stage(corpus.number_documents(lexed.select("path")), "numbers")
                numbered = _join_numbers(lexed, paths).select("doc_id", "tokens")
                counts = vocabulary.token_frequency(explode_tokens(numbered), "doc_id")
                return vocabulary.located_frequency(stage(counts, "frequency"), paths)

            store.write_counts(spark, base, new, lex_documents(texts, "path"), count)
    return vocabulary.merge_frequencies(
        store.read_counts(spark, base, "frequency", vocabulary.LOCATED_SCHEMA)
    )


def _sources(spark: SparkSession, folder: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """``(path, length)`` of the files of the tree ``folder``, and ``(path, text)``."""
    listed = files.list_source_files(spark, folder, suffix).select("path", "length")
    return listed, files.scan_source_files(spark, folder, suffix).select("path", "text")


def _join_numbers(lexed: DataFrame, numbers: DataFrame) -> DataFrame:
    if measured_bytes(numbers) <= BROADCAST_LIMIT:
        return lexed.join(F.broadcast(numbers), "path")
    return stage(lexed.join(numbers.hint("merge"), "path"), "numbered")


def _numbered(lexed: DataFrame, listed: DataFrame) -> DataFrame:
    """Lexed files with a document id in path order.  Only paths are sorted."""
    return _join_numbers(lexed, stage(corpus.number_documents(listed.select("path")), "numbers"))


def encode(
    spark: SparkSession,
    dataset_dir: str = "repositories",
    token_count_threshold: int = L.MIN_TOKENS,
    output_file: str = "dataset",
    frequency_threshold: int = L.FREQUENCY_THRESHOLD,
    redo: bool = False,
    model_dir: str = "models",
    suffix: str = ".py",
    on_missing: str = "error",
) -> bool:
    """Encode the source files below ``dataset_dir`` into ``output_file``.

    A finished output is kept unless ``redo``; tells whether it was written.
    Texts are lexed where they are read, and only the tokens are staged.  Of an ingested folder only files
    of runs not counted before are read; see :func:`count_runs`.

    A run writes dataset, vocabulary and settings into a folder of its own below ``.runs``; a pointer
    file, replaced last, makes it the current one.  Until then, and if the run dies, the dataset is the old one with
    its own vocabulary and settings.  Beside the dataset, ``.ignored`` lists the
    files of the current run that are too short to keep, ``.report`` the vocabulary statistics.
    """
    if not store.exists(spark, dataset_dir):
        raise FileNotFoundError(f"{dataset_dir} not found: unpack the repositories first")
    if not redo and (store.current_run(spark, output_file) or store.complete(spark, output_file)):
        return False
    run = store.new_run(output_file)
    with temporary(spark):
        if store.exists(spark, f"{dataset_dir}/manifest"):
            counted = stage(count_runs(spark, dataset_dir), "frequency")
            read = store.read_counts(spark, dataset_dir, "tokens", TOKENS_SCHEMA)
            lexed = _numbered(read, read)
            tokens = lexed.select("doc_id", "tokens")
        else:
            listed, texts = _sources(spark, dataset_dir, suffix)
            lexed = _numbered(stage(lex_documents(texts, "path"), "lexed"), listed)
            tokens = lexed.select("doc_id", "tokens")
            counted = stage(vocabulary.token_frequency(explode_tokens(tokens), "doc_id"), "frequency")
        # Two corpora with the same tokens under the same paths have the same vocabulary.
        name = store.fingerprint(lexed, "tokens")
        vocab = store.get_vocab(
            spark, f"{model_dir}/vocab",
            lambda threshold: vocabulary.build_vocab(counted, threshold),
            frequency_threshold, name,
        )
        vocab = store.write_table(vocab, f"{run}/vocab")
        settings = vocabulary.run_metadata(vocab).select(
            "*",
            F.lit(frequency_threshold).alias("threshold"),
            F.lit(token_count_threshold).alias("min_tokens"),
            F.lit(name).alias("corpus"),
            F.lit(f"{model_dir}/vocab").alias("vocab_base"),
        )
        store.write_table(settings, f"{run}/settings")
        # Each token gives one id and the start token one more, so short files are
        # known before they are encoded.
        long_enough = F.size("tokens") + 1 >= token_count_threshold
        encoded = encoding.encode_lexed(tokens.filter(long_enough), vocab, on_missing=on_missing)
        store.write_encoded(encoded, f"{run}/dataset")
        short = lexed.filter(~long_enough).select("doc_id", (F.size("tokens") + 1).alias("n_tokens"), "path")
        short = store.write_table(short, f"{run}/ignored")
        store.publish_run(spark, output_file, run)
        store.write_ignored(short, f"{output_file}.ignored")
        rare = vocabulary.rare_tokens_by_type(counted.drop(vocabulary.FIRST_SEEN), frequency_threshold)
        store.write_report(counted, rare, f"{output_file}.report")
    return True


def batches(
    spark: SparkSession,
    dataset: str = "dataset",
    batch_size: int = L.BATCH_SIZE,
    n_ctx: int = L.N_CTX,
    seed: int = 0,
    epoch: int = 0,
) -> DataFrame:
    """Padded batches of one epoch.  The shuffle covers all sequences, so there
    is no buffer size to choose.

    The sequences of a run are numbered once, and the numbers are stored with it; the order of an epoch is a
    permutation of them, so epochs after the first sort nothing."""
    encoded = store.read_encoded(spark, dataset)
    folder = store.current_run(spark, dataset)
    path = f"{folder}/index/n_ctx={n_ctx}" if folder else None
    if path and store.complete(spark, path):
        index = spark.read.parquet(path)
    else:
        index = sequences.sequence_index(encoded, n_ctx)
        index = store.write_table(index, path) if path else stage(index, "index")
    return sequences.epoch_batches(encoded, index, batch_size, n_ctx, seed, epoch)


def dataset_vocab(spark: SparkSession, dataset: str = "dataset") -> DataFrame:
    """The vocabulary that ``dataset`` was encoded with."""
    if folder := store.current_run(spark, dataset):
        return store.read_table(spark, f"{folder}/vocab", vocabulary.VOCAB_SCHEMA)
    run = store.read_run(spark, dataset)
    return store.read_vocab(spark, run.vocab_base, run.threshold, run.corpus)


def fit(
    spark: SparkSession,
    dataset: str = "dataset",
    k: int = 2,
    n_ctx: int = L.N_CTX,
    held_out: DataFrame | None = None,
    redo: bool = False,
) -> DataFrame:
    """Next-token counts of a dataset for contexts of up to ``k`` ids; counting
    needs one pass, not epochs.

    The counts are stored with the run they were made from, so another run has its own.  With
    ``held_out`` documents ``(doc_id, text)``, loss and accuracy of the counts on
    them, shorter contexts included, are written to ``.metrics``, eight neighbouring ids to a batch.
    """
    run = store.read_run(spark, dataset)
    encoded = store.read_encoded(spark, dataset)
    folder = store.current_run(spark, dataset) or f"{dataset}.counts/corpus={run.corpus}/threshold={run.threshold}"
    path = f"{folder}/counts/n_ctx={n_ctx}/k={k}"
    if redo or not store.complete(spark, path):
        pairs = sequences.shift_pairs(sequences.chunk_sequences(encoded, n_ctx))
        store.write_table(completion.backoff_counts(pairs, k), path)
    counts = spark.read.parquet(path)
    if held_out is not None:
        vocab = dataset_vocab(spark, dataset)
        coded = encoding.encode_documents(held_out, vocab, on_missing="null")
        pairs = sequences.shift_pairs(sequences.chunk_sequences(encoding.long_enough(coded, 2), n_ctx))
        judged = metrics.backoff_metrics(
            pairs.withColumn("batch", F.floor(F.col("doc_id") / L.BATCH_SIZE)), counts, run.n_vocab, k, ["batch"]
        )
        store.write_table(judged, f"{dataset}.metrics")
    return counts


def complete(
    spark: SparkSession,
    counts: DataFrame | None = None,
    vocab: DataFrame | None = None,
    src: str | None = None,
    file: str | None = None,
    k: int = 2,
    dataset: str | None = None,
) -> DataFrame:
    """Complete the line that follows a source text, given as ``src`` or in
    ``file``: ``(prompt_id, completion, n_generated, status)``.

    Counts and vocabulary are those given, or those stored for ``dataset``.
    """
    if (src is None) == (file is None):
        raise ValueError("give either src or file")
    if dataset is not None:
        counts = fit(spark, dataset, k) if counts is None else counts
        vocab = dataset_vocab(spark, dataset) if vocab is None else vocab
    if counts is None or vocab is None:
        raise ValueError("give counts and vocab, or a dataset")
    if src is not None:
        prompt = spark.createDataFrame([("src", src)], "prompt_id string, text string")
    else:
        prompt = (
            spark.read.format("binaryFile")
            .load(file)
            .select(F.col("path").alias("prompt_id"), files.decode_utf8(F.col("content")).alias("text"))
        )
    encoded = encoding.encode_documents(prompt, vocab, "prompt_id", on_missing="null")
    choices = completion.next_choices(counts, vocab)
    return completion.complete_lines(encoded, choices, k)
