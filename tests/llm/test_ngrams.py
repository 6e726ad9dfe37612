import random

import numpy as np
import pytest

from corpus import documents, varied, words
from tokenloom.llm import ngrams
from tokenloom.llm.components import components
from tokenloom.llm.shingles import shingle_sets


def sets_of(text):
    tokens = [] if text is None else text.encode().lower().split()
    if len(tokens) < 5:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def check(spark, rows):
    got = ngrams.near_duplicates(documents(spark, rows).withColumnRenamed("lang", "n")).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    sizes = sorted((str(i), len(sets_of(t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == expected.get(r.doc_id), r.doc_id
    return expected


def test_groups(spark):
    rng = random.Random(1)
    rows = []
    for i in range(30):
        rows.append((i * 7, " ".join(words(i, rng.choice([3, 6, 12, 40, 200, 900]), 5000))))
    for i in range(50):
        base = rng.choice(rows)[1].split()
        rows.append((300 - i, " ".join(varied(i, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.1])))))
    passage = " ".join(words(99, 60, 5000))
    rows += [(400 + i, " ".join(words(900 + i, 50 + 9 * i, 5000)) + " " + passage) for i in range(12)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE"), (505, "one two"), (None, rows[0][1])]
    rows += [rows[3], (rows[4][0], "another text under an old id of some length here"), (-9, rows[7][1].upper())]
    rows += [(600, "é" * 4 + " É a b c d"), (601, "É" * 4 + " É a b c d")]
    expected = check(spark, rows)
    assert len(set(expected.values())) < len(expected) - 20


def test_chain_without_common_representative(spark):
    # Each links with the next only; the ends are far apart.
    tokens = [f"t{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(tokens[i * 18 : i * 18 + 200])) for i in range(9)]
    expected = check(spark, rows)
    assert set(expected.values()) == {992}


def test_one_of_each(spark):
    rows = [(5, "a b c d e f g"), (3, "A B c d e f g"), (9, "x"), (None, "x"), (7, None)]
    docs = documents(spark, rows).withColumnRenamed("source", "component_id")
    kept = ngrams.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    assert ngrams.one_of_each(documents(spark, [])).collect() == []


def test_signatures_never_miss():
    """Linked sets share a key, whatever their sizes."""
    rng = np.random.default_rng(2)
    bands = ngrams.Bands(ngrams.THRESHOLD)
    for _ in range(400):
        n = int(rng.integers(1, 200)) if rng.random() < 0.7 else int(rng.integers(200, 3000))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 5 + 1))
        add = 0
        while 100 * (len(a) - drop) >= 80 * (len(a) + add + 1) and rng.random() < 0.95:
            add += 1
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**64, add, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        assert np.intersect1d(ngrams.signatures(a, bands), ngrams.signatures(b, bands)).size
        x, y = (np.array(ngrams.dense_sketch(s)).view(np.uint8) for s in (a, b))
        apart = len(a) + len(b) - 2 * both
        assert np.unpackbits(x ^ y).sum() <= apart
        assert ngrams.fine_distance(ngrams.fine_sketch(a), ngrams.fine_sketch(b)) <= apart
        c = np.unique(rng.integers(0, 2**64, len(a), dtype=np.uint64))
        far = ngrams.fine_distance(ngrams.fine_sketch(a), ngrams.fine_sketch(c))
        assert len(a) < 300 or far > len(a) / 4


def test_shingles_do_not_depend_on_the_batch():
    texts = ["a b c d e f", None, "", " x ", "a b c d e f" * 50000, "q" * 9000 + " b"] * 2
    together = list(shingle_sets(texts))
    assert [len(s) for s in together[:4]] == [2, 0, 0, 1]
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(next(shingle_sets([t])), s)
        assert len(s) == len(sets_of(t))


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, links):
    rng = random.Random(4)
    links = links + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(15)]
    root = {i: i for pair in links for i in pair}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    df = spark.createDataFrame(links, "u bigint, v bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: c for i, c in root.items() if i != c}
