"""Cross-tokenizer alignment against plain loops over the tokens."""

import hashlib
import random
from collections import Counter

import pytest
from corpus import documents, words

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

from tokenloom.llm import alignment  # noqa: E402
from tokenloom.llm.words import byte_characters  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b\n\n c\t\x1c d\xa0 e ", "<|endoftext|> <s> </s><unk>", " \n", " ", "   x", "é́ İ 中文 \U0001f600 ﷺ",
    "\x00 \x00a", "holds ▁ the mark", "​ ", "don't\r\n stop", "<0x41> x", "\n", "\n\n x",
]


BYTES = tokenizers.Tokenizer.from_file(PATHS[0])
BYTES.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(text):
    """Ids and bytes of both sides, by encoding the whole text at once."""
    byte_level, pieces = BYTES, PIECES
    of = byte_characters()
    a = byte_level.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(of[c] for c in byte_level.id_to_token(i)) for i in a]
    b = pieces.encode(text)
    b_bytes = [
        bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
        else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b
    ]
    return a, a_bytes, b, b_bytes


def spans(ids, parts):
    at, out = 0, []
    for i, part in zip(ids, parts, strict=True):
        out.append((i, at, at + len(part)))
        at += len(part)
    return out


def brute(rows):
    plain, count = [], Counter()
    for doc_id, text in rows:
        a, a_bytes, b, b_bytes = tokens(text) if text else ([], [], [], [])
        full = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != full or b"".join(b_bytes) != full:
            a, a_bytes, b, b_bytes = [], [], [], []
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups = []
        for start, end in zip([0, *ends], ends, strict=False):
            inside = lambda side: ",".join(str(i) for i, s, e in side if start <= s and e <= end)
            groups.append(f"{inside(sa)}|{inside(sb)}")
        links = [(i, j) for i, s, e in sa for j, t, f in sb if s < f and t < e]
        count.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        plain.append((doc_id, len(a), len(b), len(groups), links, digest))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(
        (
            (d, n_a, n_b, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest)
            for d, n_a, n_b, g, links, digest in plain
        ),
        key=repr,
    )


def report(spark, rows):
    found = alignment.align_report(documents(spark, rows), *PATHS)
    assert found.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
    return sorted(map(tuple, found.collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(i, rng.randint(1, 40)))) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200, None), (201, ""), (None, "none has an id"), (7, "again"), (7, "again"), (300, "ab-" * 400)]
    rows += [
        (400 + i, "".join(rng.choice(["a", " ", "  ", "\n", "é", "don't", "中", "\t", "▁", "1", ".", "</s>"]) for _ in range(12)))
        for i in range(60)
    ]
    got = report(spark, rows)
    assert got == brute(rows)
    assert sum(r[1] == 0 for r in got) >= 3 and sum(r[3] < r[1] for r in got) > 20


def test_counts_that_are_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(alignment, "lookup_join", lambda *a: __import__("tokenloom.plans.lookup").plans.lookup.lookup_join(*a, limit=0))
    rows = [(i, " ".join(words(i, 30))) for i in range(25)]
    assert report(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert report(spark, []) == []
    docs = documents(spark, [(1, "a b")]).selectExpr("*", "1 AS pairs", "2 AS n_a", "3 AS _row", "4 AS times")
    assert alignment.align_report(docs, *PATHS).count() == 1


def test_words_are_encoded_as_in_the_whole_text():
    a, b = alignment.byte_level(PATHS[0]), alignment.piece_level(PATHS[1])
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\r", "\x1c", "\xa0", "x", "é", "́", "中", "▁", "<s>", "'s", "9", ".", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        whole = tokens(text)
        assert a.ids([" " + text])[0].tolist() == whole[0], repr(text)
        if "▁" not in text:
            assert b.ids([" " + text])[0].tolist() == whole[2], repr(text)
