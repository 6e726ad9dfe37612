import re
from collections import Counter, defaultdict

from corpus import documents, lines_of, words
from tokenloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def boilerplate(rows, min_docs, share):
    docs, total = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        total[host].add(text or "")
        for line in (text or "").split("\n"):
            if key := " ".join(WORD.findall(line)).lower():
                docs[host, key].add(text or "")
    return {
        k for k, v in docs.items() if len(v) > min_docs and 100 * len(v) > share * len(total[k[0]])
    }


def test_figures_and_verdicts(spark):
    footer = "Visit   our SITE today & every day of the whole long year"
    rows = [(i, lines_of(words(i, 60)) + "\n" + footer, "hot") for i in range(12)]
    rows += [(20 + i, lines_of(words(i, 30)) + ("\n" + footer.lower()) * 5, "hot") for i in range(3)]
    rows += [(30, lines_of(words(30, 60)) + "\n" + footer, None)]
    rows += [(40, None, "hot"), (41, "", None), (42, " \n\t ", "hot"), (None, "a b c a b c", "hot")]
    rows += [(50, "the same three words\n" * 40, "hot"), (51, "é#ü *x|<y> z " * 30, "z")]
    rows += [rows[0], (60, lines_of(words(60, 30000, 9000)), "hot")]
    docs = documents(spark, rows)
    got = quality.quality_rules(docs, ["doc_id", "source", "text"], min_docs=5, share_percent=10)
    common = boilerplate(rows, 5, 10)
    assert {k for _, k in common} == {footer.lower().replace("   ", " ")}
    seen = []
    for r in got.collect():
        expected = figures(r.text)
        assert tuple(r[c] for c in quality.FIGURES) == expected, r.doc_id
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        removed = sum(
            len(WORD.findall(x)) for x in (r.text or "").split("\n")
            if (r.source, " ".join(WORD.findall(x)).lower()) in common
        )
        assert r.base_failed == failed and r.removed_words == removed
        assert r.kept == (not failed and not 2 * (expected[0] - removed) < expected[0])
        seen.append((r.doc_id, r.kept))
    assert Counter(i for i, _ in seen) == Counter(r[0] for r in rows)
    assert (20, False) in seen and (0, True) in seen and (30, True) in seen


def test_kept_documents(spark):
    footer = "this line is on every page of the host"
    rows = [(i, lines_of(words(i, 80)) + "\n" + footer, "h") for i in range(8)] + [(9, "short", "h")]
    docs = documents(spark, rows).toDF("doc_id", "text", "lang", "source", "n_words")
    kept = quality.keep_good(docs, min_docs=3)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {
        i: text.removesuffix("\n" + footer) for i, text, _ in rows[:8]
    }


def test_empty(spark):
    docs = documents(spark, [])
    assert quality.quality_rules(docs, ["doc_id"]).collect() == []
    assert quality.keep_good(docs).collect() == []
