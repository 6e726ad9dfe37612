"""The pipeline against each stage's brute-force twin, on a small corpus."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from corpus import documents, lines_of, varied, words
from test_lines import brute as brute_lines
from test_ngrams import brute as brute_groups
from test_quality import figures


def corpus_rows():
    rng = random.Random(11)
    rows = [(i, lines_of(words(i, rng.choice([30, 80, 200]), 3000)), f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, lines_of(varied(i, rows[i][1].split(), 0.01)), "s0") for i in range(10)]
    rows += [(200, "junk " * 90, "s1"), (201, None, "s1"), (202, "", None)]
    return rows


def table(df):
    return Counter((r.doc_id, r.text, r.source, r.n_chars) for r in df.collect())


def test_stages(spark):
    rows = corpus_rows()
    docs = documents(spark, rows)
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality_rules", "line_dedup", "ngram_join", "source_mix", "sentencepiece"]

    def good(text):
        n, _, _, _, repeated = figures(text)
        return n >= 50 and 100 * repeated <= 50 * n

    kept = [r for r in rows if good(r[1])]
    out = steps["quality_rules"](spark, docs, "")
    assert out.columns == docs.columns
    assert table(out) == Counter((i, t, s, len(t)) for i, t, s in kept)

    gone = brute_lines([r[:2] for r in kept])
    cleaned = []
    for i, text, source in kept:
        left = [x for n, x in enumerate(text.split("\n")) if not gone[(i, text), n]]
        cleaned.append((i, "\n".join(left), source))
    out = steps["line_dedup"](spark, documents(spark, kept), "")
    assert table(out) == Counter((i, t, s, len(t)) for i, t, s in cleaned)

    out = steps["ngram_join"](spark, documents(spark, kept), "")
    groups = brute_groups([r[:2] for r in kept])
    single = [r for r in kept if groups[r[0]] == r[0]]
    assert len(single) < len(kept)
    assert table(out) == Counter((i, t, s, len(t)) for i, t, s in single)

    mixed = steps["source_mix"](spark, documents(spark, cleaned), "")
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {i for i, t, _ in cleaned if t}

    coded = steps["sentencepiece"](spark, documents(spark, cleaned), "").collect()
    assert sorted(r.doc_id for r in coded) == sorted(r[0] for r in cleaned)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in coded)


def test_run(spark, tmp_path):
    documents(spark, corpus_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.round_trip for r in rows)
    documents(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).collect() == []
