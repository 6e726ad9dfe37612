import random
from itertools import combinations

import pytest

from corpus import documents, words
from tokenloom.llm import licenses


def scan(text, **settings):
    return licenses.Scanner(settings.get("templates", licenses.TEMPLATES), 0.8).found(text)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_found(name):
    notice = licenses.TEMPLATES[name]
    before, after = " ".join(words(1, 300)), " ".join(words(2, 300))
    found = {f[0]: f for f in scan(f"{before}\n{notice.upper()}\n{after}")}
    assert found[name][1] == 1.0 and found[name][3] == 300
    assert [f[0] for f in scan(f"{notice} {before} {notice}")].count(name) == 2


def test_changed_words_lower_the_coverage():
    notice = licenses.TEMPLATES["GPL-3.0"].split()
    for k, expected in ((1, True), (2, True), (3, False), (5, False)):
        changed = list(notice)
        for i in range(k):
            changed[2 * i] = f"other{i}"
        found = [f for f in scan("some words first " + " ".join(changed)) if f[0] == "GPL-3.0"]
        assert bool(found) == expected
        if found:
            assert found[0][2] == len(notice) - k


def test_scattered_words_are_no_license():
    gap = " ".join(f"g{i}" for i in range(40))
    assert scan(f" {gap} ".join(licenses.TEMPLATES["MIT"].split())) == []
    assert scan("") == [] and scan(" ".join(words(3, 5000))) == []


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_words_before_a_notice_do_not_cut_it(name):
    notice = licenses.normal_words(licenses.TEMPLATES[name])
    for word in sorted(set(notice)):
        for distance in range(2 * len(notice) + 1):
            before = [word, *(f"g{i}" for i in range(distance))]
            found = [f for f in scan(" ".join([*before, *notice, "after"])) if f[0] == name]
            assert (name, 1.0, len(notice), distance + 1, distance + len(notice)) in found


def test_the_fuller_notice_wins():
    gpl = licenses.TEMPLATES["GPL-3.0"]
    for distance in range(30):
        best = max(scan(f"the {'x ' * distance}{gpl}"), key=lambda f: f[1])
        assert best[:3] == ("GPL-3.0", 1.0, 12)


def best_places(template, need, words, lo, hi):
    """All windows of what is left, the best place first, then both sides of it."""
    places = []
    for start in range(lo, hi):
        if words[start] in template:
            pairs = licenses.align(template, words[start : min(start + 2 * len(template), hi)])
            if len(pairs) >= need:
                first, last = start + pairs[0][1], start + pairs[-1][1]
                places.append((-len(pairs), last - first, start, first, last))
    if not places:
        return []
    n, _, _, first, last = min(places)
    left = best_places(template, need, words, lo, first)
    return [*left, (first, last, -n), *best_places(template, need, words, last + 1, hi)]


def test_places_are_those_of_a_brute_force():
    rng, several = random.Random(4), 0
    for _ in range(400):
        template = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 10))]
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [rng.choice("abcxyz") for _ in range(rng.randrange(8))]
            text += [w for w in template if rng.random() < 0.9]
        got = [f[3:] + f[2:3] for f in scan(" ".join(text), templates={"t": " ".join(template)})]
        need = -(-800 * len(template) // 1000)
        assert got == best_places(template, need, text, 0, len(text))
        several += len(got) > 1
    assert several > 50


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(20))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in combinations(pairs, 2))
        assert len(pairs) <= common(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == common(a, b)


def test_documents(spark):
    rows = [(1, "x " + licenses.TEMPLATES["MIT"]), (2, None), (3, ""), (3, "all rights RESERVED"), (None, "plain")]
    rows.append((4, " ".join(words(5, 60000)) + "\n" + licenses.TEMPLATES["GPL-3.0"]))
    docs = documents(spark, rows).withColumnRenamed("lang", "licenses")
    got = [(r.doc_id, r.license, r.n_found) for r in licenses.best_license(docs).collect()]
    expected = [(1, "MIT", 1), (2, None, 0), (3, None, 0), (3, "reserved", 1), (None, None, 0), (4, "GPL-3.0", 2)]  # its lesser sister, too
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert licenses.best_license(documents(spark, [])).collect() == []
