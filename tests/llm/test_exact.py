import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpus import documents
from tokenloom.llm import exact


def test_directory_splits_only_overfull_buckets():
    cells = {0: 10, 1: 10, 2: 1, 15: 3}
    slots = exact.directory(cells, 10, 4)
    assert len(slots) == 16
    assert slots[0] != slots[1] and len(set(slots[8:])) == 1
    held = defaultdict(int)
    for cell, n in cells.items():
        held[slots[cell]] += n
    assert max(held.values()) <= 11
    assert exact.directory({}, 10, 4) == [0]
    # A bucket of one slot at the full depth stays overfull.
    assert len(exact.directory({3: 99}, 10, 2)) == 4


@pytest.mark.parametrize("colliding", [False, True])
def test_groups(spark, colliding):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100 + i, f"own {i}") for i in range(40)]
    rows += [(5, None), (6, ""), (None, "text 1"), (None, "only null"), (59, "text 3"), (7, "Text 1")]
    rows += [(200 + i, "long " * 50000 + str(i % 2)) for i in range(3)]
    docs = documents(spark, rows).withColumn("digest", F.lit("clash"))
    # With few hashes every chain holds different texts.
    hash_of = (lambda t: F.pmod(F.length(t), F.lit(3)).cast("bigint")) if colliding else F.xxhash64
    got = exact.exact_groups(docs, bucket_keys=8, max_depth=6, hash_of=hash_of).collect()
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    if not colliding:
        assert len({r.bucket for r in got}) > 4 and {r.chain for r in got} == {0}
    else:
        assert max(r.chain for r in got) > 2


def test_empty(spark):
    assert exact.exact_groups(documents(spark, [])).collect() == []
