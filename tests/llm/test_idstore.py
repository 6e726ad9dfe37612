"""Raw id files and their minimal perfect hash, against plain encoding in one process."""

import random
import zlib

import numpy as np
import pytest
from corpus import documents, words

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenloom.llm import idstore, perfect  # noqa: E402
from tokenloom.llm.words import cut, word_tokenizer  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
END = 2
ODD = ["a  b\n\n c\t\x1c d\xa0 e", "<|endoftext|> x<|startoftext|>", " \n", "é́ ǅ İ 中文 \U0001f600", "\x00 \x00a"]


def expected(rows):
    tokenizer = word_tokenizer(WORDS)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    start, out = 0, []
    for doc_id, text in ordered:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def stored(spark, rows, **options):
    store = idstore.write_ids(documents(spark, rows), WORDS, END, **options)
    return store, sorted(map(tuple, idstore.stored_checksums(store).collect()), key=repr)


def test_cut_is_whole():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t\r\x00\x1c\x85\xa0ab.é中'") for _ in range(rng.randint(0, 14)))
        assert "".join(cut(text)) == text


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "block_keys": 7}])
def test_matches_plain_encoding(spark, options):
    rng = random.Random(5)
    rows = [(i * 37 - 500, " ".join(words(i, rng.randint(1, 60)))) for i in range(150)]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    rows += [(20_000, None), (20_001, ""), (20_002, "x" * 300_000), (2**62, "far"), (-(2**62), "near")]
    store, got = stored(spark, rows, **options)
    assert got == expected(rows)
    if options:
        assert store.shards.count() > 5 and store.n_blocks > 5


def test_repeated_and_null_documents(spark):
    rows = [(1, "one one"), (1, "two"), (1, "two"), (None, "none"), (None, None), (2, "three")]
    got = stored(spark, rows)[1]
    total = sum(r[2] for r in got)
    assert sorted((r[0], r[2], r[3]) for r in got if r[0]) == sorted(
        (r[0], r[2], r[3]) for r in expected(rows) if r[0]
    )
    spans = sorted((r[1], r[1] + r[2]) for r in got)
    assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == total
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [1, 1, 1, 2, None, None]


def test_empty_table(spark):
    assert stored(spark, [])[1] == []


def test_keys_that_were_never_stored(spark):
    rows = [(i, f"text {i}") for i in range(0, 600, 3)]
    store, _ = stored(spark, rows, block_keys=50)
    asked = spark.createDataFrame([(i,) for i in range(-50, 700)] + [(None,), (3,)], "doc_id bigint")
    found = sorted(r.key for r in store.find(asked).collect())
    assert found == sorted([*range(0, 600, 3), 3])


def test_other_columns_play_no_part(spark):
    docs = documents(spark, [(1, "a b")]).selectExpr("*", "1 AS shard", "2 AS key", "3 AS at", "4 AS row", "5 AS tie")
    assert idstore.stored_checksums(idstore.write_ids(docs, WORDS, END)).count() == 1


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 5000):
        keys = np.unique(rng.integers(-(2**63), 2**63, n, dtype=np.int64))
        hashes = perfect.mixed(keys)
        levels = perfect.build(hashes)
        assert sorted(perfect.slots(levels, hashes)) == list(range(len(keys)))
        assert sum(map(len, levels)) < 8 * len(keys) + 200


def test_a_cut_shard_raises(spark):
    store, _ = stored(spark, [(i, "some text") for i in range(5)])
    path = store.shards.head().path
    with open(path, "r+b") as file:
        file.truncate(20)
    with pytest.raises(Exception, match="ends inside a document"):
        idstore.stored_checksums(store).collect()
