"""Small corpora for the tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


def lines_of(tokens, width=9):
    return "\n".join(" ".join(tokens[i : i + width]) for i in range(0, len(tokens), width))


def varied(seed, tokens, share):
    rng = random.Random(seed)
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else t for t in tokens]
