"""Counts, vocabulary, encoding and decoding on the worked example."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tokenloom.functions import lexicon as L
from tokenloom.operators import encoding, vocabulary
from tokenloom.operators import tokens as tok
from tokenloom.plans.staging import stage

TEXT = "x = 1\ny = x\n"
IDS = [0, 15, 16, 17, 16, 3, 18, 9, 16, 17, 16, 15, 18]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(7, TEXT)], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def vocab(documents):
    return stage(_vocab(documents, 1), "vocab")


def _vocab(documents, threshold):
    frequency = vocabulary.token_frequency(tok.tokenize(documents), "doc_id")
    return vocabulary.build_vocab(frequency, threshold)


def test_vocabulary_layout(vocab):
    rows = {r.id: (r.t_type, r.token) for r in vocab.collect()}
    assert rows[0] == (None, L.START_TOKEN)
    assert [rows[i] for i in range(1, 15)] == [
        (t, L.UNKNOWN_TOKEN) for t in sorted(L.OPEN_CLASS_TYPES)
    ]
    assert [rows[i] for i in range(15, 19)] == [
        (L.NAME, "x"), (L.TEXT, L.SPACE), (L.OPERATOR, "="), (L.TEXT, L.END_OF_LINE),
    ]
    assert len(rows) == 19


def test_threshold_is_strict(spark):
    text = "a " * 20 + "b " * 21
    docs = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    kept = {r.token for r in _vocab(docs, 20).collect()}
    assert "b" in kept and "a" not in kept


def test_literal_spelled_like_the_unknown_token(spark):
    docs = spark.createDataFrame([(0, "x = '<|unknown|>'\n" * 3)], "doc_id bigint, text string")
    vocab = stage(_vocab(docs, 1), "vocab")
    assert vocab.select("key").distinct().count() == vocab.count()
    encoded = encoding.encode_documents(docs, vocab).head().ids
    assert encoded.count(8) == 3  # the unknown single-quoted string


def test_ids_do_not_depend_on_partitioning(spark):
    texts = [(i, f"v{i % 5} = {i}\nw{i} = v{i % 3}\n") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    one = _vocab(docs.coalesce(1), 2).collect()
    many = _vocab(docs.repartition(13), 2).collect()
    assert sorted(one) == sorted(many)
    assert sorted(r.id for r in one) == list(range(len(one)))


def test_encode_and_decode(documents, vocab):
    encoded = encoding.encode_documents(documents, vocab)
    row = encoded.head()
    assert (row.ids, row.n_tokens) == (IDS, 13)
    decoded = encoding.decode_documents(encoded, vocab).head().text
    assert decoded == "x = <|unknown|>\n<|unknown|> = x\n"
    no_start = encoding.encode_documents(documents, vocab, add_start=False).head().ids
    assert no_start == IDS[1:]


def test_large_vocabulary_path_gives_the_same(documents, vocab):
    encoded = encoding.encode_documents(documents, vocab, limit=0)
    assert encoded.head().ids == IDS
    decoded = encoding.decode_documents(encoded, vocab, limit=0).head().text
    assert decoded == "x = <|unknown|>\n<|unknown|> = x\n"


def test_decoded_pieces(spark):
    rows = [
        (None, L.START_TOKEN, ""),
        (L.TEXT, L.TAB, "    "),
        (L.STRING_DOUBLE, "abc", "'abc'"),
        (L.STRING_SINGLE, L.UNKNOWN_TOKEN, "'<|unknown|>'"),
        (L.NAME, "a_b", "a_b"),
    ]
    df = spark.createDataFrame(rows, "t_type string, token string, expected string")
    piece = encoding.decoded_text(F.col("t_type"), F.col("token"))
    assert df.filter(piece != F.col("expected")).isEmpty()


def test_missing_closed_class_token(spark, vocab):
    docs = spark.createDataFrame([(0, "x + x\n")], "doc_id bigint, text string")
    with pytest.raises(PySparkException, match="not in the vocabulary"):
        encoding.encode_documents(docs, vocab).collect()
    lenient = encoding.encode_documents(docs, vocab, on_missing="null").head()
    assert lenient.ids == [0, 15, 16, None, 16, 15, 18]
    with pytest.raises(ValueError):
        encoding.encode_documents(docs, vocab, on_missing="skip")


def test_length_bounds_and_empty_documents(spark, vocab):
    docs = spark.createDataFrame(
        [(0, ""), (1, "x x x x"), (2, "x x x x x"[:8] + "\nx")], "doc_id bigint, text string"
    )
    encoded = encoding.encode_documents(docs, vocab)
    lengths = {r.doc_id: r.n_tokens for r in encoding.document_lengths(encoded).collect()}
    assert lengths == {0: 1, 1: 9, 2: 12}
    assert {r.doc_id for r in encoding.long_enough(encoded, 10).collect()} == {2}
    assert {r.doc_id for r in encoding.too_short(encoded, 10).collect()} == {0, 1}
    assert {r.doc_id for r in encoding.long_enough(encoded, 9).collect()} == {1, 2}


def test_keys(spark):
    df = spark.createDataFrame([(L.NAME, "a_b"), (L.OPERATOR, "|")], "t_type string, token string")
    keys = df.select(tok.typed_key().alias("key"))
    assert {r.key for r in keys.collect()} == {"|Token.Name|_a_b", "|Token.Operator|_|"}
    back = tok.split_key(keys).select("t_type", "token")
    assert sorted(back.collect()) == sorted(df.collect())


def test_report(spark, documents):
    frequency = vocabulary.token_frequency(tok.tokenize(documents))
    lines = [r.line for r in vocabulary.report_lines(frequency).collect()]
    assert lines[0] == "|Token.Text|_<|space|>: 4"
    rare = vocabulary.rare_tokens_by_type(frequency, threshold=1)
    assert [r.line for r in vocabulary.rare_lines(rare).collect()] == [
        "Token.Literal.Number.Integer ==> ['1']", "Token.Name ==> ['y']",
    ]


def test_rare_tokens_come_in_parts(spark):
    rows = [(L.NAME, f"n{i:03d}", 1 + i % 3) for i in range(250)]
    frequency = spark.createDataFrame(rows, "t_type string, token string, count bigint")
    parts = vocabulary.rare_tokens_by_type(frequency, part_size=100).orderBy("part").collect()
    assert [len(p.tokens) for p in parts] == [100, 100, 50]
    expected = [f"'{t}'" for _, t, _ in sorted(rows, key=lambda r: (-r[2], r[1]))]
    assert [t for p in parts for t in p.tokens] == expected


@pytest.mark.parametrize("token", ["a", "a'b", 'a"b', "a'\"b", "a\\b", "a\nb", "a\tb"])
def test_quoted_matches_repr(spark, token):
    df = spark.createDataFrame([(token,)], "token string")
    assert df.select(vocabulary.quoted(F.col("token"))).head()[0] == repr(token)


def test_run_metadata(spark, vocab):
    assert vocabulary.run_metadata(vocab).head().asDict() == {
        "n_vocab": 19, "n_embd": 768, "n_ctx": 1024, "n_head": 12, "n_layer": 12,
    }
    stored = spark.createDataFrame([(5, 256, None)], "n_vocab int, n_ctx int, n_head int")
    merged = vocabulary.run_metadata(vocab, stored).head().asDict()
    assert merged == {"n_vocab": 19, "n_embd": 768, "n_ctx": 256, "n_head": 12, "n_layer": 12}


def test_start_key_and_unknown_ids(spark):
    keys = spark.createDataFrame([("<|start|>",), ("|Token.Name|_a_b",)], "key string")
    got = [(r.t_type, r.token) for r in tok.split_key(keys).collect()]
    assert got == [(None, "<|start|>"), ("Token.Name", "a_b")]
    vocab = spark.createDataFrame(
        [(0, None, "<|start|>"), (1, "Token.Name", "a")], "id int, t_type string, token string"
    )
    coded = spark.createDataFrame([(7, [0, 1, 99, 1]), (8, []), (9, [1])], "doc_id int, ids array<int>")
    for limit in (0, 10**9):
        with pytest.raises(PySparkException, match="id 99"):
            encoding.decode_documents(coded, vocab, limit=limit).collect()
        rows = encoding.decode_documents(coded, vocab, limit=limit, on_missing="null").collect()
        assert {r.doc_id: r.text for r in rows} == {7: None, 8: "", 9: "a"}
