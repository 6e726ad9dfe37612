"""Keyed permutations, and batches whose order is arithmetic."""

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import sequences
from tokenloom.plans import permutation
from tokenloom.plans.staging import stage


def moves_to(index, n, seed, epoch=0):
    """One move of ``index`` with Python's integers."""
    high, low = permutation.radices(n)
    a, b = divmod(index, low)
    for key in permutation.round_keys(seed, epoch):
        a = (a + ((b * 48271 + key) % 2147483647 * 69621 + key) % 2147483629) % high
        b = (b + ((a * 48271 + key) % 2147483647 * 69621 + key) % 2147483629) % low
    return a * low + b


def by_hand(index, n, seed, epoch):
    """Its place, and how often it moved."""
    for moves in range(1, 1000):
        index = moves_to(index, n, seed, epoch)
        if index < n:
            return index, moves
    raise AssertionError("never below n")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1009])
def test_bijection(spark, n):
    for epoch in (0, 1):
        rows = permutation.permuted(spark.range(n), "id", "place", n, 5, epoch).collect()
        assert sorted(r.place for r in rows) == list(range(n))
        assert all(r.place == by_hand(r.id, n, 5, epoch)[0] for r in rows)


def test_walks_are_those_needed(spark):
    for n in (7, 97, 1009):
        keys = permutation.round_keys(5, 0)
        longest = max(by_hand(i, n, 5, 0)[1] for i in range(n)) - 1
        assert longest <= permutation._walks(spark, n, keys) <= 64


def test_numbers_beyond_that_lead_to_each_other(spark):
    # With this seed the one number beyond 3 stays where it is.
    seed = next(s for s in range(99) if moves_to(3, 3, s) == 3)
    rows = permutation.permuted(spark.range(3), "id", "place", 3, seed).collect()
    assert sorted(r.place for r in rows) == [0, 1, 2]


def test_large_numbers_and_nulls(spark):
    n = (1 << 59) + 12345
    ids = [0, 1, (1 << 58) + 1, n - 1]
    rows = spark.createDataFrame([(i,) for i in [*ids, None]], "id bigint")
    # The numbers from n on are many here; no walk is longer than the few moves allowed for.
    keys = permutation.round_keys(0, 0)
    got = {r.id: r.place for r in rows.withColumn("place", permutation._once(F.col("id"), n, keys)).collect()}
    assert got.pop(None) is None
    assert got == {i: by_hand(i, n, 0, 0)[0] for i in ids}
    with pytest.raises(ValueError, match="are more than"):
        permutation.radices((1 << 60) + 1)


def test_neighbours_are_torn_apart(spark):
    n = 10_007
    rows = permutation.permuted(spark.range(n), "id", "place", n, 1, 4).orderBy("id").collect()
    places = [r.place for r in rows]
    near = sum(abs(a - b) < 100 for a, b in zip(places, places[1:]))
    # A random order has some 200 of them.
    assert near < 400
    half = sum(p < n // 2 for p in places[: n // 2])
    assert abs(half - n // 4) < 250


def encoded(spark, sizes):
    rows = [(i, list(range(i, i + size))) for i, size in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, ids array<int>")


def test_batches_of_an_epoch(spark):
    docs = stage(encoded(spark, [2 + (7 * i) % 40 for i in range(61)]), "encoded")
    index = stage(sequences.sequence_index(docs, 16), "index")
    chunks = {
        (r.doc_id, r.chunk_no): r.chunk for r in sequences.chunk_sequences(docs, 16).collect()
    }
    n = len(chunks)
    seen = []
    for epoch in (0, 1):
        batches = sequences.epoch_batches(docs, index, 8, 16, seed=2, epoch=epoch)
        plan = batches._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
        rows = sorted(batches.collect(), key=lambda r: (r.batch_id, r.row_in_batch))
        assert [(r.batch_id, r.row_in_batch) for r in rows] == [divmod(i, 8) for i in range(n)]
        order = {by_hand(i, n, 2, epoch)[0]: key for i, key in enumerate(sorted(chunks))}
        assert [(r.doc_id, r.chunk_no) for r in rows] == [order[i] for i in range(n)]
        for start in range(0, n, 8):
            group = rows[start : start + 8]
            width = max(len(chunks[r.doc_id, r.chunk_no]) for r in group) - 1
            for r in group:
                chunk = chunks[r.doc_id, r.chunk_no]
                pad = [0] * (width - len(chunk) + 1)
                assert (r.width, r.x, r.y) == (width, chunk[:-1] + pad, chunk[1:] + pad)
        seen.append([(r.doc_id, r.chunk_no) for r in rows])
    assert seen[0] != seen[1]


def test_no_sequences(spark):
    docs = encoded(spark, [])
    index = sequences.sequence_index(docs)
    assert sequences.epoch_batches(docs, index).collect() == []
