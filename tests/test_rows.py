"""Encoding of whole rows, and the files tables are staged in."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import lexicon as L
from tokenloom.operators import encoding, vocabulary
from tokenloom.operators import tokens as tok
from tokenloom.plans.staging import stage
from tokenloom.queries import catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_files_are_ones_the_reader_takes(spark):
    # LZ4_RAW pages of some sizes cannot be read back: "all input must be consumed".
    staged = stage(spark.range(3), "numbers")
    assert all("lz4" not in name for name in staged.inputFiles()) and staged.count() == 3


def test_tokens_are_kept_no_longer_than_needed(spark, tmp_path, monkeypatch):
    made = []

    def recorded(df, label):
        made.append((label, staged := stage(df, label)))
        return staged

    monkeypatch.setattr(catalog, "stage", recorded)
    text = "a = b + 1\n" * 4
    spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    encoded, vocab = catalog._corpus(spark, str(tmp_path))
    left = {label: Path(df.inputFiles()[0].removeprefix("file://")).exists() for label, df in made}
    assert left == {"lexed": False, "vocab": True, "encoded": True}
    assert encoded.count() == 2 and encoding.decode_documents(encoded, vocab).count() == 2


def test_encoding_moves_only_documents_that_share_an_id(spark):
    texts = [(i, f"x{i % 7} = {i % 3}\n" * 2) for i in range(20)]
    texts += [(3, "x1 = 2\n"), (3, ""), (None, "x2 = 1\n"), (None, None), (30, None), (31, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    lexed = stage(tok.lex_documents(docs), "lexed")
    frequency = vocabulary.token_frequency(tok.explode_tokens(lexed), "doc_id")
    vocab = stage(vocabulary.build_vocab(frequency.filter("t_type IS NOT NULL"), 2), "vocab")
    encoded = encoding.encode_lexed(lexed, vocab)
    # The vocabulary is looked up inside of the rows: no row of the plan holds a token.
    assert "Generate" not in _plan(encoded)
    plain = encoding.encode_tokens(tok.explode_tokens(lexed, outer=True), vocab)
    expected = encoding.collect_ids(plain).withColumn("n_tokens", F.size("ids"))
    assert sorted(map(str, encoded.collect())) == sorted(map(str, expected.collect()))


def test_first_places_of_small_and_large_document_numbers(spark):
    rows = [(d, p, t) for d in (5, -7, 1 << 40, -(1 << 40), None) for p, t in ((3, f"t{d}"), (1, f"t{d}"), (2, "all"))]
    rows += [(5, 9, "some"), (1 << 40, 0, "some")]
    tokens = spark.createDataFrame(rows, "doc_id bigint, pos int, token string").withColumn("t_type", F.lit(L.NAME))
    counted = vocabulary.token_frequency(tokens, "doc_id")
    # Plain integers where they hold the place.
    assert "shiftleft" in _plan(counted)
    seen = {r.token: (r["count"], r.first_seen) for r in counted.collect()}
    places = {f"t{d}": (2, None if d is None else (d << 31) + 1) for d in (5, -7, 1 << 40, -(1 << 40), None)}
    assert seen == places | {"all": (5, -(1 << 71) + 2), "some": (2, (5 << 31) + 9)}
    assert counted.schema["first_seen"].dataType.simpleString() == "decimal(32,0)"


def test_decoding_moves_only_documents_that_share_an_id(spark):
    vocab = spark.createDataFrame(
        [(0, None, "<|start|>"), (1, "Token.Name", "a"), (7, "Token.Name", "b")],
        "id int, t_type string, token string",
    )
    rows = [(1, [0, 1, 7]), (2, []), (3, None), (4, [1, None]), (5, [7, 99]), (6, [1]), (6, [7, 7]), (None, [1]), (None, [7])]
    coded = stage(spark.createDataFrame(rows, "doc_id int, ids array<int>"), "encoded")
    decoded = encoding.decode_documents(coded, vocab, on_missing="null")
    # The pieces of documents with an id of their own are never rows of their own.
    assert "Union" in _plan(decoded)
    plain = encoding.decode_documents(coded, vocab, limit=0, on_missing="null")
    assert sorted(map(str, decoded.collect())) == sorted(map(str, plain.collect()))


def _rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_filter_by_length_encodes_each_document_once(spark):
    docs = spark.createDataFrame([(1, "a = b + 1\n" * 4), (2, "x\n"), (2, "y\n"), (3, None)], "doc_id long, text string")
    lexed = stage(tok.lex_documents(docs), "lexed")
    frequency = vocabulary.token_frequency(tok.explode_tokens(lexed), "doc_id")
    encoded = encoding.encode_lexed(lexed, stage(vocabulary.build_vocab(frequency, 0), "vocab"))
    kept = encoding.long_enough(encoded, 5)
    assert kept.columns == encoded.columns
    assert _rows_of(kept) == _rows_of(stage(encoded, "encoded").filter("size(ids) >= 5"))
    # Each lookup of a document's tokens hashes them; a filter must not.
    filters = [line for line in _plan(kept).splitlines() if "Filter" in line]
    assert not any("xxhash64" in line for line in filters)


def test_texts_of_single_tokens_need_no_array_for_each(spark):
    """Several tabs, comments and docstrings among tokens that stand for themselves."""
    text = '\n\nif x:\n        y = "s"  # note\n    """doc"""\n            z(1)\n'
    docs = spark.createDataFrame([(1, text), (2, "a  b\n"), (3, "    c\n"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: [t.token for t in r.tokens] for r in tok.lex_documents(docs).collect()}
    end, tab, space = L.END_OF_LINE, L.TAB, L.SPACE
    assert got[1] == [
        "if", space, "x", ":", end, tab, tab, "y", space, "=", space, "s", space, end, tab, end,
        tab, tab, tab, "z", "(", "1", ")", end,
    ]
    assert got[2] == ["a", space, "b", end]
    assert got[3] == [tab, "c", end]
    assert got[4] == []


def test_a_large_vocabulary_moves_rare_tokens_alone(spark):
    texts = [(i, f"x{i % 7} = {i % 3}\n" * 2) for i in range(20)]
    texts += [(3, "x1 = 2\n"), (3, ""), (None, "x2 = 1\n"), (None, None), (30, None), (31, ""), (32, "once = 0\n")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    lexed = stage(tok.lex_documents(docs), "lexed")
    frequency = vocabulary.token_frequency(tok.explode_tokens(lexed), "doc_id")
    vocab = stage(vocabulary.build_vocab(frequency.filter("t_type IS NOT NULL"), 2), "vocab")
    plain = encoding.encode_tokens(tok.explode_tokens(lexed, outer=True), vocab)
    expected = encoding.collect_ids(plain, add_start=False)
    # No entry, some and all of them are frequent.
    for share in (1, 20, 10**6):
        found = encoding._encode_rare(lexed, vocab, "doc_id", "error", L.OPEN_CLASS_TYPES, share)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())), share
    encoded = encoding.encode_lexed(lexed, vocab, limit=0)
    # Every token was a row before; now the rare ones that were staged.
    assert "posexplode" not in _plan(encoded)


def test_a_large_vocabulary_tells_what_it_lacks(spark):
    lexed = spark.createDataFrame(
        [(1, [("Token.Keyword", "if"), ("Token.Keyword", "else"), (None, None)])],
        "doc_id int, tokens array<struct<t_type: string, token: string>>",
    )
    vocab = spark.createDataFrame(
        [(50, "Token.Keyword", "if", "k", 3)], "id int, t_type string, token string, key string, count bigint"
    )
    found = encoding.encode_lexed(lexed, vocab, add_start=False, on_missing="null", limit=0)
    assert [tuple(r) for r in found.collect()] == [(1, [50, None, None], 3)]
    with pytest.raises(Exception, match="not in the vocabulary"):
        encoding.encode_lexed(lexed, vocab, limit=0).collect()
