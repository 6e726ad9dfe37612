"""Spelling variants against comparing all words with all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import fmindex, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_length=5, min_count=3):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= min_length and c >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return sorted((w, form[w], root[w], n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def corpus(seed, n_docs=30, alphabet="abcé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 9))) for _ in range(150)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(200):
            w = base[int(rng.random() ** 2 * len(base))]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", w[at] * 2, "ß", "X"]) + w[at + 1 :]
            words.append(w)
        rows.append((i * 7, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("block_entries", [20_000, 60])
def test_matches_brute_force(spark, block_entries):
    rows = corpus(1) + [(5000, None), (5001, ""), (None, "Wörter wörter WÖrter wörte wörte wörte"), (7, "ababa " * 50), (7, "ababa " * 50)]
    rows.append((8, "zzzzz " * 3 + "zzzzzy " * 7 + "zzzzzyx " * 15 + "zzzzzyxw " * 31))
    found = spelling.spelling_groups(documents(spark, rows), block_entries=block_entries)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, found.collect()))
    assert got == brute(rows)
    assert any(form and root != form for _, form, root, *_ in got) and any(n[4] > 5 for n in got)


def test_half_that_most_words_share(spark):
    # One half holds far more words than a block takes.
    rng = random.Random(4)
    words = ["prefix" + "".join(rng.choice("abcd") for _ in range(rng.randint(5, 7))) for _ in range(400)]
    rows = [(1, " ".join(words * 3)), (2, " ".join(words[:50] * 4))]
    found = spelling.spelling_groups(documents(spark, rows), block_entries=40)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert spelling.spelling_groups(documents(spark, [])).collect() == []
    docs = documents(spark, [(1, "words words words")]).selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS h")
    assert [r.word for r in spelling.spelling_groups(docs).collect()] == ["words"]


def test_a_very_long_word(spark):
    rows = [(1, " ".join(["a" * 6_000] * 3 + ["a" * 5_999] * 7 + ["b" * 5] * 3))]
    got = {(len(r.word), r.n_near, len(r.form or "")) for r in spelling.spelling_groups(documents(spark, rows)).collect()}
    assert got == {(6_000, 1, 5_999), (5_999, 1, 0), (5, 0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25), st.lists(st.text("abcd", min_size=2, max_size=6), min_size=1))
def test_index_finds_all_words_one_edit_away(words, asked):
    words = sorted(words)
    symbols = lambda w: np.array([" abc".find(c) if c != "d" else 4 for c in w], dtype=np.int64)
    index = fmindex.Index([symbols(w) for w in words], 5)
    sizes = np.array([len(a) for a in asked])
    patterns = np.zeros((len(asked), sizes.max()), dtype=np.int64)
    for row, a in zip(patterns, asked, strict=True):
        row[: len(a)] = symbols(a)
    found = set()
    for left in (True, False):
        which, at = fmindex.near(index, patterns, sizes, left)
        found |= {(asked[i], words[j]) for i, j in zip(which, at, strict=True)}
    assert found == {(a, w) for a in asked for w in words if one_edit(a, w)}
