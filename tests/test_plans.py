"""Building blocks under skew, and the shape of the plans built from them."""

import itertools

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import encoding, sequences, vocabulary
from tokenloom.operators import tokens as tok
from tokenloom.plans import lookup, ordering, parallel, staging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_blocks(spark):
    """Keep sorts of small data in several partitions."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


@pytest.fixture
def facts(spark):
    # Two thirds of the rows share one key; some keys have no match.
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1)).alias("k"), "id"
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_paths_agree(spark, facts, how):
    table = spark.range(0, 2000, 2).unionByName(spark.range(1, 2)).select(
        F.col("id").alias("k"), (F.col("id") * 10).alias("v")
    )
    expected = facts.join(table, "k", how)
    for limit in (0, 10**9):
        got = lookup.lookup_join(facts, table, ["k"], how, limit)
        assert got.columns == expected.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_lookup_broadcasts_only_below_the_limit(spark, facts):
    table = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert "SortMergeJoin" not in plan(lookup.lookup_join(facts, table, ["k"]))
    assert "SortMergeJoin" in plan(lookup.lookup_join(facts, table, ["k"], limit=1000))
    assert lookup.measured_bytes(table) >= 1000 * 12


def test_dense_index_spans_blocks(spark, many_blocks):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v")).repartition(7)
    rows = ordering.dense_index(df, [F.col("v")], "n", "test").collect()
    assert sorted((r.n, r.v) for r in rows) == [(i, i) for i in range(1000)]
    assert ordering.dense_index(df.limit(0), [F.col("v")], "n", "test").count() == 0


def test_running_sums_of_a_hot_group_cross_blocks(spark, many_blocks):
    rows = [(1 if i % 4 else i, i, i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(5)
    sums = {"n": F.lit(1), "total": F.col("v")}
    got = ordering.running(df, ["g"], [F.col("o")], sums, "test").collect()
    expected = []
    for g, members in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        total = 0
        for n, (_, o, v) in enumerate(members, start=1):
            total += v
            expected.append((g, o, v, n, total))
    assert sorted(tuple(r) for r in got) == sorted(expected)
    blocks = ordering.sorted_blocks(df, [F.col("g"), F.col("o")], "test")
    assert blocks.filter("g = 1").select("block").distinct().count() > 1


def test_shared_folder_is_the_configured_one(spark, tmp_path):
    assert staging.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = staging.stage(spark.range(5), "numbers")
    assert all(staging.shared_dir(spark) in f for f in staged.inputFiles())
    assert staged.count() == 5


def test_spread_only_below_the_core_count(spark):
    assert "Exchange" in plan(parallel.spread(spark.range(10).coalesce(1), "id"))
    wide = spark.range(0, 10, 1, 8)
    assert parallel.spread(wide, "id") is wide


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame(
        [(i, f"a{i % 9} = b{i % 4}\nc = a{i % 9}\n" * 3) for i in range(40)],
        "doc_id bigint, text string",
    )
    lexed = staging.stage(tok.lex_documents(docs), "lexed")
    frequency = vocabulary.token_frequency(tok.explode_tokens(lexed), "doc_id")
    return lexed, staging.stage(vocabulary.build_vocab(frequency, 3), "vocab")


def test_counts_are_combined_before_the_only_shuffle(small):
    frequency = plan(vocabulary.token_frequency(tok.explode_tokens(small[0]), "doc_id"))
    assert frequency.count("Exchange") == 1
    assert "partial_count" in frequency and "SortAggregate" not in frequency


def test_encoding_shuffles_once(small):
    encoded = plan(encoding.encode_lexed(*small))
    assert "BroadcastHashJoin" in encoded
    assert encoded.count("Exchange hashpartitioning") == 1


def test_batches_have_no_global_window_over_rows(small):
    encoded = staging.stage(encoding.encode_lexed(*small), "encoded")
    batches = plan(sequences.padded_batches(encoded))
    # Places are staged; the ids of small data do not move at all.
    assert "Exchange SinglePartition" not in batches
    assert "Exchange hashpartitioning" not in batches


def test_large_vocabulary_reads_tokens_once(small, spark):
    lexed, vocab = small
    tokens = tok.explode_tokens(lexed)
    encoded = encoding.encode_tokens(tokens, vocab, limit=0)
    shape = plan(encoded)
    assert shape.count("Generate") == 1 and "SortMergeJoin" in shape
    expected = encoding.encode_tokens(tokens, vocab).select(*encoded.columns).collect()
    assert sorted(map(str, encoded.collect())) == sorted(map(str, expected))


def test_counted_lookup_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "_HOT_SHARE", 10)
    facts = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.lit(1)).cast("string").alias("k"), "id"
    )
    table = facts.filter("id % 3 = 0").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("v")
    )
    expected = sorted(map(str, facts.join(table.drop("n"), "k", "left").select("k", "id", "v").collect()))
    for limit in (-1, 10**9):
        got = lookup.counted_lookup(facts, table, ["k"], "n", limit)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == expected


def test_temporary_tables_are_removed(spark):
    with staging.temporary(spark):
        path = staging.stage(spark.range(3), "numbers").inputFiles()[0]
        inner = staging.new_path(spark, "unused")
    from tokenloom.sources import store

    assert not store.exists(spark, path) and not store.exists(spark, inner)


def test_encoding_files_sorts_no_texts(spark, tmp_path):
    from tokenloom import commands

    folder = tmp_path / "repositories/u/r"
    folder.mkdir(parents=True)
    (folder / "a.py").write_text("x = 1\n")
    listed, texts = commands._sources(spark, str(tmp_path / "repositories"), ".py")
    lexed = commands._numbered(staging.stage(tok.lex_documents(texts, "path"), "lexed"), listed)
    assert "rangepartitioning" not in plan(tok.lex_documents(texts, "path"))
    assert "Exchange hashpartitioning" not in plan(lexed) and lexed.head().doc_id == 0
