"""The registered queries: one per operator, each over whole tables.

The given tables play the parts of a source corpus: ``documents`` are source
files, ``pages`` give paths and repository lines, ``conversations`` prompts,
``embeddings`` score vectors, ``events`` a batch log, ``labels`` a manifest.
Arrays are returned as comma-joined text, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import commands
from ..functions import lexicon as L
from ..functions import paths as P
from ..functions.lexing import lex, typed_raw
from ..operators import completion, corpus, encoding, metrics, sequences, vocabulary
from ..operators import tokens as tok
from ..plans.lookup import lookup_join
from ..plans.ordering import dense_index
from ..plans.parallel import spread
from ..plans.staging import discard, drop_shuffles, new_path, stage
from ..sources import archives, files, store
from ..streaming import ingest
from .packing import pack_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEPARATOR = "\u001e<end of file>\u001e"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _joined(array: str, separator: str = ",") -> Column:
    return F.array_join(F.col(array).cast("array<string>"), separator)


def _lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(tok.lex_documents(_documents(spark, sf_dir)), "lexed")


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.token_frequency(tok.tokenize(_documents(spark, sf_dir)))


def _vocab(lexed: DataFrame) -> DataFrame:
    frequency = vocabulary.token_frequency(tok.explode_tokens(lexed), "doc_id")
    return stage(vocabulary.build_vocab(frequency), "vocab")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Encoded documents of sufficient length, and the vocabulary."""
    lexed = _lexed(spark, sf_dir)
    vocab = _vocab(lexed)
    encoded = stage(encoding.long_enough(encoding.encode_lexed(lexed, vocab)), "encoded")
    # The tokens take more than the texts, and nothing reads them, or the shuffles of their counts, from here on.
    discard(lexed)
    drop_shuffles(spark)
    return encoded, vocab


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file list made from the document ids, with every kind of path the file
    rules tell apart."""
    folder = F.element_at(
        F.array(
            *map(
                F.lit,
                ["", "src/", "tests/", "src/testing/", "unittests/", "src/core/", "testdata/x/"],
            )
        ),
        (F.col("doc_id") % 7 + 1).cast("int"),
    )
    special = ["__init__.py", "test_a.py", "tests.py", "conftest.py", "a_test.py", "setup.cfg", "A.PY"]
    name = F.coalesce(
        F.get(F.array(*map(F.lit, special)), (F.col("doc_id") % 11).cast("int")),
        F.concat(F.lit("mod_"), (F.col("doc_id") % 50).cast("string"), F.lit(".py")),
    )
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("user"),
        F.col("source").alias("repo"),
        F.concat(F.col("source"), F.lit("-main/"), folder, name).alias("path"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of each page."""
    bare = F.regexp_replace("url", "^https?://|[?#].*$", "")
    return _table(spark, sf_dir, "pages").select(
        "page_id",
        F.substring_index(bare, "/", 1).alias("host"),
        F.rtrim(F.regexp_replace(bare, "^[^/]*/", ""), F.lit("/")).alias("path"),
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("logits"),
        F.pmod("label", F.size("embedding")).alias("target"),
        F.floor(F.col("vec_id") / 8).alias("batch"),
        (F.floor(F.col("vec_id") / 8) % 5).alias("epoch"),
    )


def _prompts(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    """Encoded turns; a token the vocabulary cannot express has a null id."""
    turns = _table(spark, sf_dir, "conversations")
    turns = turns.withColumn("prompt_id", F.concat_ws("-", "conv_id", "turn"))
    return encoding.encode_documents(turns, vocab, "prompt_id", on_missing="null")


# --- scans, sources, sinks ---------------------------------------------------


@query
def repo_list(spark, sf_dir):
    lines = _table(spark, sf_dir, "pages").select(
        F.regexp_replace("url", "^https?://[^/]*/", "").alias("line")
    )
    # Fragments lead the line, which makes it a comment.
    lines = lines.select(F.regexp_replace("line", "^([^#]*)(#.*)$", "$2$1").alias("line"))
    return corpus.parse_repo_lines(lines, "line")


@query
def scan_source_files(spark, sf_dir):
    tree = new_path(spark, "tree")
    (
        _table(spark, sf_dir, "documents")
        .select("lang", "source", "text")
        .write.partitionBy("lang", "source")
        .option("maxRecordsPerFile", 1000)
        .option("lineSep", SEPARATOR)
        .text(tree)
    )
    scanned = files.scan_source_files(spark, tree, ".txt")
    texts = F.split("text", SEPARATOR)
    value = lambda col: F.substring_index(col, "=", -1).alias(col)
    return scanned.select(
        value("user"), value("repo"), F.explode(F.slice(texts, 1, F.size(texts) - 1)).alias("text")
    )


@query
def utf8_replace(spark, sf_dir):
    content = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-8"), F.unhex(F.lit("E282")))
    return _documents(spark, sf_dir).select("doc_id", files.decode_utf8(content).alias("text"))


def _archived(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("-main/src/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return pack_archives(
        docs.select(F.col("lang").alias("user"), F.col("source").alias("repo"), path.alias("path"), "text")
    )


@query
def unpack_archives(spark, sf_dir):
    members = archives.unpack_archives(_archived(spark, sf_dir))
    return archives.accepted(members).select(
        "user", "repo", "member_path", files.decode_utf8(F.col("content")).alias("text")
    )


@query
def write_encoded(spark, sf_dir):
    lexed = _lexed(spark, sf_dir)
    path = new_path(spark, "dataset")
    encoded = encoding.long_enough(encoding.encode_lexed(lexed, _vocab(lexed)))
    store.write_encoded(encoded, path)
    store.write_encoded(encoded.limit(0), path)  # kept: the dataset exists
    return spark.read.parquet(path).select("doc_id", _joined("ids").alias("ids"), "n_tokens")


@query
def read_encoded(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    path = new_path(spark, "dataset")
    store.write_encoded(encoded, path, redo=True)
    return store.read_encoded(spark, path).select("doc_id", _joined("ids").alias("ids"), "n_tokens")


@query
def vocab_roundtrip(spark, sf_dir):
    lexed = _lexed(spark, sf_dir)
    base = new_path(spark, "vocabularies")

    def build(threshold):
        frequency = vocabulary.token_frequency(tok.explode_tokens(lexed), "doc_id")
        return vocabulary.build_vocab(frequency, threshold)

    store.get_vocab(spark, base, build, 5)
    return store.get_vocab(spark, base, build, 5)


@query
def vocab_report_lines(spark, sf_dir):
    frequency = stage(_frequency(spark, sf_dir), "frequency")
    rare = vocabulary.rare_tokens_by_type(frequency)
    path = new_path(spark, "report")
    store.write_report(frequency, rare, path)
    return spark.read.text([f"{path}/counts", f"{path}/rare"]).withColumnRenamed("value", "line")


@query
def ignored_documents(spark, sf_dir):
    lexed = _lexed(spark, sf_dir)
    encoded = encoding.encode_lexed(lexed, _vocab(lexed))
    return encoding.document_lengths(encoding.too_short(encoded))


@query
def run_metadata(spark, sf_dir):
    return vocabulary.run_metadata(_vocab(_lexed(spark, sf_dir)))


# --- filters -----------------------------------------------------------------


@query
def filter_extension(spark, sf_dir):
    return corpus.filter_extension(_listing(spark, sf_dir))


@query
def filter_basename(spark, sf_dir):
    return corpus.filter_basename(_listing(spark, sf_dir))


@query
def prune_test_dirs(spark, sf_dir):
    return corpus.prune_test_dirs(_listing(spark, sf_dir))


@query
def select_sources(spark, sf_dir):
    return corpus.dedup_basename(corpus.select_sources(_listing(spark, sf_dir)))


@query
def dedup_basename(spark, sf_dir):
    return corpus.dedup_basename(_pages(spark, sf_dir), ["host"])


@query
def skip_ingested(spark, sf_dir):
    manifest = _table(spark, sf_dir, "labels")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return corpus.skip_ingested(docs, manifest, ["doc_id"])


def _found_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, hosts as repositories; ``plain`` for pages served without encryption."""
    pages = _pages(spark, sf_dir).join(
        _table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("content")), "page_id"
    )
    return pages.select(
        F.regexp_extract("host", r"[^.]+\.[^.]+$", 0).alias("user"),
        F.col("host").alias("repo"),
        F.concat_ws("/", "host", "path").alias("path"),
        "page_id",
        "content",
        F.col("url").startswith("http://").alias("plain"),
    )


@query
def ingest_pages(spark, sf_dir):
    """Two runs, hosts as repositories: pages served without encryption, then
    all pages; the second run skips the hosts of the first."""
    found = _found_pages(spark, sf_dir)
    base = new_path(spark, "repositories")
    plain = found.filter("plain")
    store.write_table(plain.select("user", "repo").distinct(), f"{base}/manifest/run=1")
    new = corpus.skip_ingested(found, store.read_manifest(spark, base))
    runs = [corpus.choose_files(files_of, "") for files_of in (plain, new)]
    return runs[0].unionByName(runs[1].select(*runs[0].columns)).select(
        "user", "repo", P.destination(F.col("user"), F.col("repo"), F.col("path")).alias("path"),
        "page_id", "content",
    )


@query
def stream_ingest_pages(spark, sf_dir):
    """As ``ingest_pages``, by a stream of announced deliveries, one to a trigger."""
    root = new_path(spark, "deliveries")
    found = stage(_found_pages(spark, sf_dir), "pages")
    for number, part in enumerate([found.filter("plain"), found], start=1):
        folder = f"{root}/{number}"
        part.drop("plain").write.parquet(folder)
        announced = spark.createDataFrame([(number, folder)], ingest.DELIVERY_SCHEMA)
        announced.coalesce(1).write.mode("append").parquet(f"{root}/announced")
    base, values = f"{root}/repositories", "page_id bigint, content string"
    arrivals = ingest.document_stream(spark, f"{root}/announced", ingest.DELIVERY_SCHEMA, 1)
    read = ingest.read_deliveries(f"user string, repo string, path string, {values}")
    ingest.stream_ingest(arrivals, base, f"{root}/state", read, "").awaitTermination()
    filed = store.read_ingested(spark, base, values=values)
    return filed.withColumn("path", F.replace("path", F.lit(base), F.lit("repositories")))


@query
def drop_comments(spark, sf_dir):
    raw = tok.raw_tokens(_table(spark, sf_dir, "pages"), "page_id", "html")
    return tok.drop_excluded(raw).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.max("pos").alias("last_pos")
    )


@query
def trim_leading_newlines(spark, sf_dir):
    header = "#!/bin/run\n# note\n\n\n"
    docs = spread(
        _documents(spark, sf_dir).withColumn("text", F.concat(F.lit(header), "text")), "doc_id"
    )
    both = docs.select(
        "doc_id",
        lex("text").alias("trimmed"),
        F.size(lex("text", trim=False)).alias("n_untrimmed"),
    )
    return both.select(
        "doc_id",
        F.get("trimmed", F.lit(0))["token"].alias("first_token"),
        F.size("trimmed").alias("n_trimmed"),
        "n_untrimmed",
    )


@query
def min_length_documents(spark, sf_dir):
    lexed = _lexed(spark, sf_dir)
    encoded = encoding.encode_lexed(lexed, _vocab(lexed))
    return encoding.document_lengths(encoding.long_enough(encoded))


@query
def vocab_threshold(spark, sf_dir):
    return vocabulary.above_threshold(_frequency(spark, sf_dir))


@query
def padding_mask(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    masked = sequences.padding_mask(sequences.padded_batches(encoded))
    return masked.select(
        "batch_id",
        "row_in_batch",
        F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask"),
    )


# --- lexing ------------------------------------------------------------------


@query
def lex_tokens(spark, sf_dir):
    docs = spread(_documents(spark, sf_dir), "doc_id")
    return docs.select("doc_id", typed_raw("text").alias("tokens")).select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.array_join(
            F.transform("tokens", lambda t: F.concat(t["t_type"], F.lit("="), t["token"])), " "
        ).alias("tokens"),
    )


@query
def string_literals(spark, sf_dir):
    pages = tok.tokenize(_table(spark, sf_dir, "pages"), "page_id", "html")
    return pages.filter(F.col("t_type").isin(L.STRING_SINGLE, L.STRING_DOUBLE))


@query
def normalize_whitespace(spark, sf_dir):
    blanks = tok.tokenize(_table(spark, sf_dir, "pages"), "page_id", "html").filter(
        F.col("t_type") == L.TEXT
    )
    return blanks.groupBy("page_id").agg(
        F.count_if(F.col("token") == L.END_OF_LINE).alias("n_lines"),
        F.count_if(F.col("token") == L.SPACE).alias("n_spaces"),
        F.count_if(F.col("token") == L.TAB).alias("n_tabs"),
    )


@query
def token_positions(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn(
        "turn_id", F.concat_ws("-", "conv_id", "turn")
    )
    return tok.tokenize(turns, "turn_id")


@query
def contextual_types(spark, sf_dir):
    # Common words become statement heads.
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" def ")), F.lit(" of "), F.lit(" class "))
    typed = tok.raw_tokens(_documents(spark, sf_dir).withColumn("text", text))
    return typed.filter(
        F.col("t_type").isin(
            L.NAME_FUNCTION, L.NAME_CLASS, L.NAME_NAMESPACE, L.NAME_DECORATOR,
            L.STRING_AFFIX, L.DOCSTRING, L.COMMENT, L.HASHBANG,
        )
    )


@query
def typed_keys(spark, sf_dir):
    return _frequency(spark, sf_dir).select(tok.typed_key().alias("key"), "count")


@query
def split_keys(spark, sf_dir):
    keys = _frequency(spark, sf_dir).select(tok.typed_key().alias("key"))
    return tok.split_key(keys)


@query
def open_class_tokens(spark, sf_dir):
    kept = tok.keep_open_class(tok.tokenize(_documents(spark, sf_dir)))
    return kept.groupBy("t_type", "token").agg(F.count(F.lit(1)).alias("n"))


@query
def path_parts(spark, sf_dir):
    path = F.col("path")
    return _listing(spark, sf_dir).select(
        "doc_id",
        P.root_of(path).alias("root"),
        P.below_root(path).alias("inner_path"),
        P.basename(path).alias("basename"),
        P.depth(path).alias("depth"),
        P.destination(F.col("user"), F.col("repo"), path).alias("destination"),
    )


# --- vocabulary --------------------------------------------------------------


@query
def token_frequency(spark, sf_dir):
    return _frequency(spark, sf_dir)


@query
def most_common_tokens(spark, sf_dir):
    return vocabulary.most_common(_frequency(spark, sf_dir))


@query
def rare_tokens_by_type(spark, sf_dir):
    rare = vocabulary.rare_tokens_by_type(_frequency(spark, sf_dir))
    return rare.select("t_type", "part", _joined("tokens", ", ").alias("tokens"))


@query
def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(_listing(spark, sf_dir))


@query
def build_vocab(spark, sf_dir):
    return _vocab(_lexed(spark, sf_dir))


@query
def merged_vocab(spark, sf_dir):
    """As ``build_vocab``, from counts of two runs: documents with labels were counted first,
    and the others, when they came, by themselves."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.format_string("%020d", "doc_id").alias("path")
    )
    labelled = _table(spark, sf_dir, "labels").select("doc_id").distinct()
    base = new_path(spark, "repositories")
    for run, how in (("run=1", "left_semi"), ("run=2", "left_anti")):
        files_of = lookup_join(docs, labelled, ["doc_id"], how)
        named = files_of.select(F.lit("u").alias("user"), F.lit(run).alias("repo"), "path", "text")
        store.write_table(named, f"{base}/files/{run}")
        store.write_table(spark.createDataFrame([("u", run)], "user string, repo string"), f"{base}/manifest/{run}")
        counted = commands.count_runs(spark, base)
    return stage(vocabulary.build_vocab(stage(counted, "frequency")), "vocab")


@query
def vocab_ids(spark, sf_dir):
    tokens = tok.tokenize(_documents(spark, sf_dir))
    return vocabulary.build_vocab(
        vocabulary.token_frequency(tokens, "doc_id"), threshold=0
    ).select("id", "key")


# --- encoding ----------------------------------------------------------------


@query
def encode_tokens(spark, sf_dir):
    lexed = _lexed(spark, sf_dir)
    encoded = encoding.encode_tokens(tok.explode_tokens(lexed), _vocab(lexed))
    return encoded.groupBy("t_type", "id").agg(F.count(F.lit(1)).alias("n"))


@query
def encode_documents(spark, sf_dir):
    lexed = _lexed(spark, sf_dir)
    encoded = encoding.encode_lexed(lexed, _vocab(lexed))
    return encoded.select("doc_id", _joined("ids").alias("ids"), "n_tokens")


@query
def encode_large_vocabulary(spark, sf_dir):
    """As ``encode_documents``, by the path for vocabularies beyond a broadcast."""
    lexed = _lexed(spark, sf_dir)
    encoded = encoding.encode_lexed(lexed, _vocab(lexed), limit=0)
    return encoded.select("doc_id", _joined("ids").alias("ids"), "n_tokens")


@query
def document_lengths(spark, sf_dir):
    lexed = _lexed(spark, sf_dir)
    return encoding.document_lengths(encoding.encode_lexed(lexed, _vocab(lexed)))


@query
def decode_tokens(spark, sf_dir):
    encoded, vocab = _corpus(spark, sf_dir)
    counts = encoded.select(F.explode("ids").alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return encoding.decode_tokens(counts, vocab).select("id", "piece", "n")


@query
def decode_documents(spark, sf_dir):
    encoded, vocab = _corpus(spark, sf_dir)
    return encoding.decode_documents(encoded, vocab)


# --- sequences and batches ---------------------------------------------------


@query
def chunk_sequences(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    chunks = sequences.chunk_sequences(encoded)
    return chunks.select("doc_id", "chunk_no", _joined("chunk").alias("chunk"))


@query
def shift_pairs(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    pairs = sequences.shift_pairs(sequences.chunk_sequences(encoded, 100))
    return pairs.select("doc_id", "chunk_no", _joined("x").alias("x"), _joined("y").alias("y"))


@query
def shuffle_sequences(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    chunks = sequences.chunk_sequences(encoded).withColumn("length", F.size("chunk")).drop("chunk")
    shuffled = sequences.shuffle_sequences(chunks, seed=7)
    return dense_index(shuffled, [F.col("key")], "place", "shuffled")


@query
def padded_batches(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    batches = sequences.padded_batches(encoded)
    return batches.withColumn("x", _joined("x")).withColumn("y", _joined("y"))


@query
def epoch_batches(spark, sf_dir):
    """The batches of two epochs from one stored numbering of the sequences."""
    encoded, _ = _corpus(spark, sf_dir)
    index = stage(sequences.sequence_index(encoded), "index")
    both = [
        sequences.epoch_batches(encoded, index, seed=3, epoch=e).withColumn("epoch", F.lit(e)) for e in (0, 1)
    ]
    batches = both[0].unionByName(both[1])
    return batches.withColumn("x", _joined("x")).withColumn("y", _joined("y"))


# --- metrics -----------------------------------------------------------------


@query
def masked_loss(spark, sf_dir):
    loss = metrics.masked_loss(_scores(spark, sf_dir), ["batch"])
    return loss.withColumn("loss", F.round("loss", 6))


@query
def token_accuracy(spark, sf_dir):
    accuracy = metrics.token_accuracy(_scores(spark, sf_dir), ["batch"])
    return accuracy.select(
        "batch",
        F.round("accuracy", 6).alias("accuracy"),
        F.round("masked_accuracy", 6).alias("masked_accuracy"),
    )


@query
def epoch_metrics(spark, sf_dir):
    batches = metrics.batch_metrics(_scores(spark, sf_dir), ["epoch", "batch"])
    epochs = metrics.epoch_metrics(batches)
    return epochs.withColumn("loss", F.round("loss", 6)).withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query
def running_metrics(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("epoch"),
        "ts",
        "event_id",
        F.col("value").alias("loss"),
        (F.col("event_type") == "click").cast("double").alias("accuracy"),
    )
    running = metrics.running_metrics(log, ["ts", "event_id"], every=10)
    return running.withColumn("loss", F.round("loss", 4)).withColumn(
        "accuracy", F.round("accuracy", 4)
    )


@query
def heldout_metrics(spark, sf_dir):
    """Next-token counts of the documents, judged on the benchmark."""
    encoded, vocab = _corpus(spark, sf_dir)
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    coded = encoding.long_enough(encoding.encode_documents(items, vocab, on_missing="null"), 2)
    pairs = sequences.shift_pairs(sequences.chunk_sequences(coded))
    judged = metrics.ngram_metrics(
        pairs.withColumn("batch", F.floor(F.col("doc_id") / 8)),
        _counts(encoded, 1), vocab.count(), ["batch"],
    )
    return judged.withColumns({c: F.round(c, 6) for c in ("loss", "accuracy")})


@query
def heldout_backoff(spark, sf_dir):
    """As ``heldout_metrics``, for contexts of up to 1, 2 and 3 ids backing off to shorter ones."""
    encoded, vocab = _corpus(spark, sf_dir)
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    coded = encoding.long_enough(encoding.encode_documents(items, vocab, on_missing="null"), 2)
    asked = sequences.shift_pairs(sequences.chunk_sequences(coded))
    asked = stage(asked.withColumn("batch", F.floor(F.col("doc_id") / 8)), "asked")
    pairs = sequences.shift_pairs(sequences.chunk_sequences(encoded))
    counts = stage(completion.backoff_counts(pairs, 3), "counts")
    n_vocab = vocab.count()
    judged = [
        metrics.backoff_metrics(asked, counts, n_vocab, k, ["batch"]).withColumn("k", F.lit(k))
        for k in (1, 2, 3)
    ]
    return reduce(DataFrame.unionByName, judged).withColumns(
        {c: F.round(c, 6) for c in ("loss", "accuracy")}
    )


# --- next-token counts and completion ----------------------------------------


def _counts(encoded: DataFrame, k: int) -> DataFrame:
    pairs = sequences.shift_pairs(sequences.chunk_sequences(encoded))
    return completion.next_token_counts(pairs, k)


def _choices(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """What follows contexts of up to ``k`` ids, and the vocabulary."""
    encoded, vocab = _corpus(spark, sf_dir)
    pairs = sequences.shift_pairs(sequences.chunk_sequences(encoded))
    counts = completion.backoff_counts(pairs, k)
    return stage(completion.next_choices(counts, vocab), "choices"), vocab


@query
def next_token_counts(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    both = [_counts(encoded, k).withColumn("k", F.lit(k)) for k in (1, 2)]
    return both[0].unionByName(both[1]).withColumn("context", _joined("context"))


@query
def backoff_counts(spark, sf_dir):
    """Contexts of up to three ids, of one count of the steps."""
    encoded, _ = _corpus(spark, sf_dir)
    pairs = sequences.shift_pairs(sequences.chunk_sequences(encoded))
    return completion.backoff_counts(pairs, 3).withColumn("context", _joined("context"))


@query
def top_k_next(spark, sf_dir):
    encoded, _ = _corpus(spark, sf_dir)
    best = completion.top_k_next(_counts(encoded, 1))
    return best.withColumn("context", _joined("context"))


@query
def top_k_candidates(spark, sf_dir):
    best = completion.top_k_candidates(_scores(spark, sf_dir), ["vec_id"])
    return best.withColumn("score", F.col("score").cast("double"))


@query
def choose_candidate(spark, sf_dir):
    vocab = _vocab(_lexed(spark, sf_dir))
    best = completion.top_k_candidates(_scores(spark, sf_dir), ["vec_id"])
    decoded = encoding.decode_tokens(best, vocab)
    return completion.choose_candidate(decoded, ["vec_id"])


@query
def complete_token(spark, sf_dir):
    choices, vocab = _choices(spark, sf_dir, 2)
    prompts = _prompts(spark, sf_dir, vocab).select(
        "prompt_id", completion.last_context(F.col("ids"), 2).alias("context")
    )
    chosen = completion.chosen(stage(prompts, "prompts"), choices, 2)
    return chosen.withColumn("context", _joined("context"))


@query
def complete_line(spark, sf_dir):
    choices, vocab = _choices(spark, sf_dir, 3)
    return completion.complete_lines(_prompts(spark, sf_dir, vocab), choices, 3)


# --- streaming ---------------------------------------------------------------


@query
def stream_encode(spark, sf_dir):
    vocab = _vocab(_lexed(spark, sf_dir))
    output, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-state")
    # A pattern, so that the table may be one file or a folder of parts.
    stream = ingest.document_stream(spark, f"{sf_dir}/documents.parquet*")
    ingest.stream_encode(stream, vocab, output, checkpoint).awaitTermination()
    return spark.read.parquet(f"{output}/batch=*").select(
        "doc_id", _joined("ids").alias("ids"), "n_tokens"
    )
