import random
from collections import Counter

import numpy as np
import pytest

from corpus import documents, lines_of, varied, words
from tokenloom.llm import lines


def brute(rows):
    """Removed (doc, line number, text) of all lines, judged on the input."""
    found = []
    for i, text in rows:
        for n, line in enumerate([] if text is None else text.split("\n")):
            found.append(((float("inf") if i is None else i, n), set(line.lower().split()), (i, text)))
    found.sort(key=lambda f: f[0])
    gone = Counter()
    for place, tokens, row in found:
        if tokens and any(
            other[0] < place and other[1] and 180 * len(tokens & other[1]) >= 80 * (len(tokens) + len(other[1]))
            for other in found
        ):
            gone[row, place[1]] += 1
    return gone


def check(spark, rows):
    docs = documents(spark, rows).withColumnRenamed("lang", "doc")
    cleaned = lines.without_repeated_lines(docs, out="left", count_as="gone")
    assert cleaned.columns == [*docs.columns, "left", "gone"]
    got = cleaned.collect()
    gone = brute(rows)
    assert len(got) == len(rows) and {r.doc for r in got} == {"en"}
    for r in got:
        if r.text is None:
            assert r.left is None and r.gone == 0
            continue
        drop = {n for n in range(len(r.text.split("\n"))) if gone[(r.doc_id, r.text), n]}
        kept = [x for n, x in enumerate(r.text.split("\n")) if n not in drop]
        assert (r.left, r.gone) == ("\n".join(kept), len(drop)), r.doc_id
    return got


def test_near_and_equal_lines(spark):
    rng = random.Random(3)
    rows = []
    for i in range(25):
        text = lines_of(words(i, 90, 150), rng.choice([3, 8, 15]))
        rows.append((i * 3, text))
    for i in range(12):
        tokens = words(rng.randrange(25), 90, 150)
        rows.append((100 - i, lines_of(varied(i, tokens, 0.08), 15)))
    rows += [(1, "a\nA\n\n  \na a"), (2, "b c\nc b\nb  c\td"), (None, "a\nfresh words here")]
    rows += [(500, None), (501, ""), (502, "\n\n"), (rows[0][0], rows[0][1])]
    rows.append((rows[6][0], "a text of its own\n" + rows[9][1] + "\nunder an id that is taken"))
    rows.append((-5, "\n".join(rows[3][1].split("\n")[:3])))
    got = check(spark, rows)
    assert sum(r.gone for r in got) > 20


def test_many_variants_of_one_line(spark):
    base = [f"t{i}" for i in range(30)]
    rng = random.Random(5)
    rows = []
    for i in range(60):
        line = list(base)
        for _ in range(rng.randrange(1, 5)):
            line[rng.randrange(30)] = f"v{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(line)))
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 9, 31])
def test_threshold_is_exact(spark, n):
    base = [f"t{i}" for i in range(n)]
    rows = [(0, " ".join(base))]
    for extra in range(1, n // 3 + 2):
        rows.append((extra, " ".join(base + [f"e{extra}_{k}" for k in range(extra)])))
        rows.append((50 + extra, " ".join(base[extra:] or ["z"])))
    check(spark, rows)


def test_stage_keeps_rows_and_columns(spark):
    docs = documents(spark, [(1, "x y\nx y"), (2, "x y"), (3, None)]).withColumnRenamed("lang", "_gone")
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "x y", 2: "", 3: None}
    assert lines.dedup_lines(documents(spark, [])).collect() == []


def test_looked_up_again_only_under_words_with_more():
    """Two rows before the last one pass the filters; a third passes or is far too long."""

    def rows(n_first):
        same = dict.fromkeys(["word", "pos", "line_no"], np.zeros(4, dtype=np.int64))
        sketch = dict.fromkeys(["s1", "s2"], np.zeros(4, dtype=np.uint64))
        n = np.array([n_first, 10, 10, 10])
        return same | sketch | {"doc": np.arange(4), "n": n, "open": np.arange(4) == 3}

    for n_first, more in ((100, []), (11, [3])):
        later, earlier, unsure = lines._near(rows(n_first), (80, 100), 0, 2)
        assert (later.tolist(), earlier.tolist(), unsure.tolist()) == ([3, 3], [2, 1], more)
    later, earlier, unsure = lines._near(rows(11), (80, 100), 2, 32)
    assert (later.tolist(), earlier.tolist(), unsure.tolist()) == ([3], [0], [])


def test_ranks_take_a_byte_a_cell(spark):
    docs = documents(spark, [(0, "a b b c c c c"), (1, "c c c c"), (2, None)]).select("text")
    ranks = lines.cell_ranks(docs)
    assert ranks.nbytes == 1 << lines.CELL_BITS
    assert sorted(ranks[ranks > 0].tolist()) == [8, 12, 25]


@pytest.mark.parametrize("high", [0, 1])
def test_order_by_line_and_id(high):
    # Ids that differ in their last bits alone are ordered as well.
    line = np.array([0, 0, 0, 1, 1])
    ids = np.array([3, 1 - high, 3, 2, 0], dtype=np.uint64) << np.uint64(40 * high)
    order = lines._by_line(line, ids)
    assert line[order].tolist() == line.tolist()
    assert ids[order].tolist() == ids[np.lexsort((ids, line))].tolist()


def test_runs_no_python_on_executors_and_looks_again(spark, monkeypatch):
    """Each line varies one of three originals that come in the middle; no variant is the nearest or first match of many others."""
    base = [f"t{i}" for i in range(30)]
    rng = random.Random(8)
    rows = []
    for i in range(45):
        line = list(base)
        if i not in (7, 20, 21):
            for at in rng.sample(range(30), 3):
                line[at] = f"v{i}_{at}"
        rows.append((i, " ".join(line)))
    plans = []

    def recorded(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, label)

    staged = lines.stage
    monkeypatch.setattr(lines, "stage", recorded)
    check(spark, rows)
    assert [label for label, _ in plans].count("line_pairs") > 1
    for label, plan in plans:
        assert "MapIn" not in plan and "Python" not in plan, label


def test_sets_told_apart_where_they_meet(spark, monkeypatch):
    """Lines that share two rare words next to each other and nothing else never become pairs."""
    rows = [(i, " ".join(["rare", "words", *[f"w{i}_{j}" for j in range(20)]])) for i in range(12)]
    rows.append((99, rows[0][1] + " more"))
    sizes = []

    def recorded(df, label):
        done = staged(df, label)
        if label == "near_pairs":
            sizes.append(done.count())
        return done

    staged = lines.stage
    monkeypatch.setattr(lines, "stage", recorded)
    check(spark, rows)
    assert sum(sizes) == 1


def test_sets_too_many_for_a_broadcast_are_looked_up_each(spark, monkeypatch):
    base = [f"t{i}" for i in range(20)]
    rows = [(i, " ".join(base)) for i in range(3, 6)]
    rows += [(i, " ".join([*base[1:], "z"])) for i in (1, 4, 7)]
    rows += [(8, " ".join(base[2:])), (9, "a b c"), (2, "c b a"), (0, "x\ny")]
    docs = documents(spark, rows)
    kept = {(r.doc, r.line_no) for r in lines.removed_lines(docs).collect()}
    assert kept == {(row[0], n) for row, n in brute(rows)}
    monkeypatch.setattr(lines, "_REPEATED_SHARE", 0)
    assert {(r.doc, r.line_no) for r in lines.removed_lines(docs, limit=0).collect()} == kept
