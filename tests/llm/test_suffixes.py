import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from corpus import documents, varied, words
from tokenloom.llm import suffixes
from tokenloom.llm.bwt import shared_prefixes


def brute(rows, length):
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, text in texts:
        for p in range(len(text) - length + 1):
            key = text[p : p + length]
            first[key] = min(i, first.get(key, i))
    out = []
    for i, text in texts:
        gone = [False] * len(text)
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=50, gram=16):
    docs = documents(spark, rows).withColumnRenamed("lang", "doc")
    got = suffixes.span_report(docs, length=length, gram=gram).collect()
    expected = [(i, *b) for (i, _), b in zip(rows, brute(rows, length), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    return got


def test_repeats(spark):
    rng = random.Random(8)
    rows = [(i * 3, " ".join(words(i, rng.choice([2, 15, 120]), 90))) for i in range(30)]
    passage = " ".join(words(77, 30, 900))
    for i in range(25):
        tokens = rng.choice(rows)[1].split()
        text = " ".join(varied(i, tokens, rng.choice([0, 0.02, 0.1])))
        cut = rng.randrange(len(passage))
        rows.append((200 - i, text[: len(text) // 2] + passage[cut:] + text[len(text) // 2 :]))
    rows += [(300, None), (301, ""), (302, passage[:50]), (303, passage[:49]), (None, passage), (None, passage + "!")]
    rows += [(304, "ab" * 70), (305, "ba" * 60), (306, "é" * 60), (307, "x" + "é" * 60), (308, "\x00" * 80), (309, "\x00" * 99)]
    rows += [rows[2], (rows[3][0], rows[4][1]), (1000, rows[5][1])]
    got = check(spark, rows)
    assert sum(r.n_removed > 0 for r in got) > 15


@pytest.mark.parametrize(("length", "gram"), [(12, 4), (20, 9)])
def test_small_alphabets(spark, length, gram):
    rng = random.Random(length)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(60)]
    check(spark, rows, length, gram)


def test_shared_prefixes():
    rng = random.Random(6)
    for length in (3, 7, 8, 20, 50):
        texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 160))) for _ in range(30)]
        texts += [texts[0], texts[1][3:], b"\x00" * 70, b"\x00" * 64]
        group, text, offset = shared_prefixes(texts, length)
        got = {}
        for g, t, o in zip(group.tolist(), text.tolist(), offset.tolist(), strict=True):
            got.setdefault(g, set()).add((t, o))
        places = {}
        for t, data in enumerate(texts):
            for o in range(len(data) - length + 1):
                places.setdefault(data[o : o + length], set()).add((t, o))
        expected = [p for p in places.values() if len(p) > 1]
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected))


def crowd(n):
    """A phrase, then what differs in each document, two of which have it in common."""
    phrase = " ".join(words(5, 16, 900))
    return [(i, f"{phrase} no {(i - i % 2) * 7919:012d} of {(i - i % 2) * 104729:015d} and {i}") for i in range(n)]


def test_crowded_anchors(spark, monkeypatch):
    looked_up, calls = suffixes._looked_up, []
    monkeypatch.setattr(suffixes, "_looked_up", lambda df, n: calls.append(df.count()) or looked_up(df, n))
    rows = crowd(26_000)
    got = check(spark, rows)
    assert calls and calls[0] > 10_000
    assert sum(r.n_removed > 0 for r in got) == len(rows) - 1


def test_one_anchor_is_indexed_in_bounded_parts(monkeypatch):
    sizes = []

    def indexed(texts, length):
        sizes.append(sum(map(len, texts)))
        return shared_prefixes(texts, length)

    monkeypatch.setattr(suffixes, "shared_prefixes", indexed)
    fixed = "a phrase of thirty-three bytes or"
    contexts = sorted({f"{fixed}{'x' * 16}{i:034d}".encode() for i in range(60_000)})
    columns = ["key", "context", "doc", "text_key", "start", "anchor"]
    frames = (
        pd.DataFrame(
            [(7, c, n + k, 1, 0, len(fixed)) for k, c in enumerate(contexts[n : n + 10_000])], columns=columns
        )
        for n in range(0, len(contexts), 10_000)
    )
    rows = pd.concat(list(suffixes._repeated(frames, 50, 16)))
    assert max(sizes, default=0) <= 1 << 21
    assert sorted(rows.context) == contexts and set(rows.to - rows["from"]) == {83}


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    raw = np.frombuffer(" ".join(words(1, 3000)).encode(), dtype=np.uint8)
    whole = suffixes.anchor_ranges(raw, 50, 16)
    monkeypatch.setattr(suffixes, "_PIECE", 700)
    for a, b in zip(whole, suffixes.anchor_ranges(raw, 50, 16), strict=True):
        assert np.array_equal(a, b)


def test_cut_and_empty(spark):
    text = "the quick brown fox jumps over the lazy dog again and again, every day"
    docs = documents(spark, [(1, text), (2, "A" + text + "B")]).withColumnRenamed("lang", "_spans")
    cut = suffixes.cut_spans(docs)
    assert cut.columns == [*docs.columns, "kept"]
    assert {r.doc_id: bytes(r.kept) for r in cut.collect()} == {1: text.encode(), 2: b"AB"}
    assert suffixes.span_report(documents(spark, [])).collect() == []
