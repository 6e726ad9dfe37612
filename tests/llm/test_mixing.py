from collections import Counter, defaultdict
from fractions import Fraction

from corpus import documents, words
from tokenloom.llm import mixing


def targets(sizes):
    """Shares by weight, the excess over twice the size reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= above
    return out


def test_targets_and_words_taken(spark):
    rows = []
    for i in range(900):
        source = ["big", "big", "b", None, "", "tiny", "é", "zero"][i % 8 if i > 400 else 0]
        size = 0 if source == "zero" else (1 + i % 37) * (1 if source == "tiny" else 5)
        rows.append((i % 850, " ".join(words(i, size)) or None, source))
    docs = documents(spark, rows)
    got = mixing.mix_plan(docs, keep=["source"]).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    wanted = targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.in_source]
        assert abs(r.target - wanted[r.in_source]) <= 1e-9 * max(1.0, r.target)
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.in_source] += r.taken
        largest[r.in_source] = max(largest[r.in_source], r.size)
    for source in sizes:
        assert abs(taken[source] - wanted[source]) <= 2 * largest[source]
    assert sum(wanted.values()) * 2 == sum(sizes.values()) * 3
    again = mixing.mix_plan(docs.repartition(7), keep=["source"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_corpus(spark):
    docs = documents(spark, [(i, "a b c " * (i + 1), "x") for i in range(20)] + [(99, None, None)])
    docs = docs.withColumnRenamed("lang", "copies")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    planned = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect() if r.taken}
    assert dict(times) == planned and 99 not in times


def test_empty(spark):
    assert mixing.mix_plan(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).collect() == []
