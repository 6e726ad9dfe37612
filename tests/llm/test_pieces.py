import os
import random

import numpy as np
import pytest

from corpus import documents
from tokenloom.llm import pieces

MARK = pieces.MARK


def small(extra=()):
    rng = random.Random(2)
    entries = [("<unk>", 0.0, "none")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    texts = {MARK, "a", "b", "c", "é", *extra}
    while len(texts) < 60:
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 6)))
        texts.add(rng.choice(["", MARK]) + word)
    return pieces.Pieces(entries + [(t, -rng.random() * 20 - 1, "text") for t in sorted(texts)])


def best_sum(p, text):
    """The highest sum over all segmentations."""
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            found = p.of.get(text[i:j])
            score = found[1] if found else p.unknown if j == i + 1 else None
            if score is not None:
                best[j] = max(best[j], best[i] + score)
    return best[-1]


def sum_of(p, ids):
    by_id = {i: s for i, s in p.of.values()}
    total, run = 0.0, b""
    for i in [*ids, None]:
        if i is not None and i not in by_id:
            run += p.text[i]
            continue
        total += p.unknown * len(run.decode("utf-8", "surrogatepass"))
        run = b""
        total += by_id.get(i, 0.0)
    return total


@pytest.mark.parametrize("extra", [(), (MARK * 2, MARK * 4), (f"a{MARK}b", f"c{MARK}"), ("a\nb",)])
def test_best_path_and_round_trip(extra):
    p, rng = small(extra), random.Random(len(extra))
    for n in [0, 1, 2, 3, *[rng.randrange(400) for _ in range(60)]]:
        text = "".join(rng.choice("aaabbbccc  é\nz𝔘") for _ in range(n))
        ids = p.encode(text)
        assert p.decode(ids) == text
        if text:
            marked = MARK + text.replace(" ", MARK)
            assert sum_of(p, ids.tolist()) == pytest.approx(best_sum(p, marked))
            streamed = [i for part in p.search(marked) for i in part]
            assert sum_of(p, streamed) == pytest.approx(best_sum(p, marked))
            assert sum_of(p, p.whole(marked)) == pytest.approx(best_sum(p, marked))


def test_marks_in_the_text_come_back():
    p = small()
    for text in [MARK, f"a{MARK}b", f"{MARK} {MARK}{MARK}a ", f" {MARK}"]:
        assert p.decode(p.encode(text)) == text


def test_search_commits_while_it_reads():
    p = small()
    parts = list(p.search("abcab" * 4000))
    assert len(parts) > 100 and max(map(len, parts)) < 60


def test_bad_ids_raise():
    p = small()
    for ids in ([0], [10**6], [-1]):
        with pytest.raises(ValueError):
            p.decode(np.array(ids))


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")
def test_columns(spark):
    rows = [(1, "Hello  world\n\tnext"), (2, None), (3, ""), (4, " "), (5, "ä𝔘" * 9000), (5, "x" * 70000), (None, MARK)]
    docs = documents(spark, rows).withColumnRenamed("lang", "text_ids")
    coded = pieces.encode(docs)
    back = pieces.decode(coded, out="back").collect()
    assert [(r.back, r.ids is None) for r in back] == [(t, t is None) for _, t in rows]
    assert len(back[2].ids) == 0
    assert pieces.decode(pieces.encode(documents(spark, [])), out="t").collect() == []
