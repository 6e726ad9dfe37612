"""Line dedup by an exact set-similarity join, in DataFrame functions.

A line is the set of its distinct lower-cased words, ordered by rarity over the whole corpus.  A line is removed when an
earlier line, by (doc_id, line number), has a Jaccard similarity of 0.8 or more with it; all lines are judged on the input.

Two such sets differ in ``d`` words at most.  Each of these falls between two neighbours of the words they share, in order of
rarity, so among the first ``d + 1`` pairs of neighbours they share one is untouched: two words that follow each other in both
sets.  A line is therefore looked up under the pairs of neighbours among its rarest words, as many as the lengths of its
possible matches ask for (``_n_keys``); below a threshold of 0.8 under single words.  Sets that meet under a key are compared only if
their lengths allow the similarity, and then verified on their full sets.

Keys travel with size and sketch of their line, so sets whose sketches are too far apart are told where they meet and never
become a pair.  Equal sets are collapsed first, those with most lines alone if there are too many for a broadcast.  A line
needs one match only, so it is compared with the nearest lines before it and the first one under each of its keys; where
these fail and a key has more, with more of them under that key, and then with all.  Lines that vary one common original,
however many, thus meet a few of them and not each other.

The rank of a word is the size of its hash cell among ``2 ** CELL_BITS``, counted over all texts, in eighths of a power of
two; the ranks are an array of a fixed size that travels with the plan.  Rank and 55 bits of the hash together are the word's id.

Defined results: null text has no lines and stays null; lines without words are never removed; a null doc_id comes
after all others; rows that share a doc_id and a text are judged alike; text without its removed lines may be
empty, the row stays; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lookup import BROADCAST_LIMIT, lookup_join, measured_bytes
from ..plans.staging import drop_shuffles, new_path, stage, temporary
from .text import SPACES, WORD, let

THRESHOLD = (80, 100)
CELL_BITS = 16
_ID_BITS = 55
#: Nearest lines under a key that a line is compared with at first, and those it is compared with before all others.
_LOOKS = (1, 8)
#: Bits of a key, and of a sketch that travels in two parts: behind the key, and behind the place and size.
_KEY_BITS, _SKETCH_BITS, _LOW_BITS, _SIZE_BITS = 40, 44, 20, 12
#: While the sets with several lines are too many for a broadcast, those with a line in so many are collapsed.
_REPEATED_SHARE = 500_000
_LAST_DOC = (1 << 63) - 1
_PLACED = ["word", "doc", "line_no", "n", "pos", "s1", "s2", "open"]


def _hashes(line: Column) -> Column:
    return F.transform(F.split(line, SPACES), lambda word: F.xxhash64(word))


def _no_word() -> Column:
    return F.xxhash64(F.lit(""))


def _cell(word_hash: Column) -> Column:
    return F.shiftrightunsigned(word_hash, 64 - CELL_BITS).cast("int")


def cell_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each cell, rarest first: ``2 ** CELL_BITS`` bytes, whatever the corpus."""
    hashes = docs.select(F.explode(F.split(F.lower("text"), SPACES)).alias("word")).select(F.xxhash64("word").alias("word"))
    counted = (
        hashes.filter(F.col("word") != _no_word())
        .groupBy(_cell(F.col("word")).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranks = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    for row in counted.collect():  # at most 2 ** CELL_BITS rows
        ranks[row.cell] = min(int(8 * np.log2(row.n + 1)), 255)
    return ranks


def _literal(ranks: np.ndarray) -> Column:
    """The ranks as an array that is folded into the plan."""
    return F.split(F.lit(",".join(map(str, ranks.tolist()))), ",").cast("array<smallint>")


def _tokens(hashes: Column, ranks: Column) -> Column:
    """The ids of distinct words, rarest first."""

    def token(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, _cell(h)).cast("bigint"), F.lit(0).cast("bigint"))
        return F.shiftleft(rank, _ID_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << _ID_BITS) - 1)))

    return F.sort_array(F.transform(hashes, token))


def _distinct_hashes(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_hashes(line)), _no_word())


# `_by_line` and `_near` are no step of the operator any more; their tests still hold them.
def _by_line(line: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by line and id, by one sort of the line with the first bits of the id if that tells all ids apart."""
    if len(line) and line[-1] < 1 << 19:
        keys = (line.astype(np.uint64) << np.uint64(45)) | (ids >> np.uint64(19))
        order = np.argsort(keys)
        keys, sorted_ids = keys[order], ids[order]
        if not np.any((keys[1:] == keys[:-1]) & (sorted_ids[1:] != sorted_ids[:-1])):
            return order
    return np.lexsort((ids, line))


def _key_width(threshold: tuple[int, int]) -> int:
    """Words in a key.  From 0.8 on two similar sets that differ share at least two words more than they differ in."""
    part, whole = threshold
    return 2 if 5 * part >= 4 * whole else 1


def _n_keys(n: Column, threshold: tuple[int, int]) -> Column:
    """Keys a line of ``n`` words is looked up under.

    With a line of ``m`` words at least ``o = (n + m) * part / (whole + part)`` words are shared.  The first shared word follows on at most
    ``n - o`` others, the first shared pair of neighbours on ``n - o`` words of this line alone and one for each of the ``n + m - 2 * o``
    that differ.  Both are most for the shortest line allowed.
    """
    part, whole = threshold
    n = n.cast("bigint")
    least = F.ceil(n * part / whole)
    others = n * 2 + least if _key_width(threshold) == 2 else n
    shares = 3 if _key_width(threshold) == 2 else 1
    return F.floor((others * (whole + part) - (n + least) * shares * part) / (whole + part)).cast("int") + 1


def _sketch(tokens: Column) -> Column:
    """The XOR of one of 64 bits per word."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return F.aggregate(
        tokens,
        zero,
        lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int"))),
    )


def _line_table(docs: DataFrame, ranks: Column, threshold) -> DataFrame:
    """One row per line with words: place, 128-bit key of its set, size, sketch, bits of the rarest words."""
    split = docs.select("doc", "text_key", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    # A filter on the sets would compute them twice.
    split = split.filter(F.col("line").rlike(WORD))
    sets = split.select("doc", "text_key", "line_no", _tokens(_distinct_hashes(F.col("line")), ranks).alias("tokens"))
    n = F.size("tokens")
    return sets.select(
        "doc",
        "text_key",
        "line_no",
        F.xxhash64("tokens").alias("k1"),
        F.xxhash64(F.lit(1), "tokens").alias("k2"),
        n.alias("n"),
        _sketch(F.col("tokens")).alias("sketch"),
        F.transform(
            F.slice("tokens", 1, _n_keys(n, threshold) + _key_width(threshold) - 1), lambda t: t.bitwiseAND(_ones(_KEY_BITS))
        ).alias("prefix"),
    )


def _ones(bits: int) -> Column:
    return F.lit((1 << bits) - 1)


def _keyed(firsts: DataFrame, threshold) -> DataFrame:
    """``(key, doc, at)``: the keys of each line that may match a line with another set, each with the first bits of the sketch
    behind it; ``at`` is line number, size and the other bits."""
    part, whole = threshold
    folded = F.col("sketch").bitwiseAND(_ones(_SKETCH_BITS)).bitwiseXOR(F.shiftrightunsigned("sketch", _SKETCH_BITS))
    size = F.least(F.col("n").cast("bigint"), _ones(_SIZE_BITS))
    place = F.shiftleft(F.col("line_no").cast("bigint"), 32).bitwiseOR(F.shiftleft(size, _LOW_BITS))
    placed = firsts.filter(F.col("n").cast("bigint") * (whole - part) >= part).select(
        "doc",
        place.bitwiseOR(folded.bitwiseAND(_ones(_LOW_BITS))).alias("at"),
        F.shiftright(folded, _LOW_BITS).alias("bits"),
        "prefix",
        F.posexplode("prefix").alias("pos", "token"),
    )
    word = F.col("token")
    if _key_width(threshold) == 2:
        placed = placed.filter(F.col("pos") < F.size("prefix") - 1)
        word = F.xxhash64("token", F.get("prefix", F.col("pos") + 1))
    return placed.select(F.shiftleft(word, 64 - _KEY_BITS).bitwiseOR(F.col("bits")).alias("key"), "doc", "at")


def _word(key: str) -> Column:
    return F.shiftrightunsigned(key, 64 - _KEY_BITS)


def _line_no(at: Column) -> Column:
    return F.shiftright(at, 32).cast("int")


def _may_match(threshold, key: Column, at: Column, other_key: Column, other_at: Column) -> Column:
    """Whether two lines that share a key are two, of sizes and with sketches that similar sets may have."""
    part, whole = threshold
    most = (1 << _SIZE_BITS) - 1
    n, m = (F.shiftright(a, _LOW_BITS).bitwiseAND(F.lit(most)) for a in (at, other_at))
    # The keys differ in bits of the sketch alone.
    apart = F.bit_count(key.bitwiseXOR(other_key)) + F.bit_count(at.bitwiseXOR(other_at).bitwiseAND(_ones(_LOW_BITS)))
    near = (F.least(n, m) * whole >= F.greatest(n, m) * part) & (apart * (whole + part) <= (n + m) * (whole - part))
    # Larger sizes are not told apart here.
    return near | (F.greatest(n, m) == most)


def _with_earlier(rows: DataFrame, by_word, backs, threshold, first: bool = False) -> tuple[DataFrame, list[str]]:
    """``rows`` with the lines so many places before each of them under its word, and the first one if asked for, as far as they may
    match, as ``(doc, at)`` in the columns named."""
    so_far = by_word.rowsBetween(W.unboundedPreceding, W.currentRow)
    # Plain columns: structs would be sorted with the rows.
    seen = {f"_{back}": (lambda c, back=back: F.lag(c, back).over(by_word)) for back in backs}
    if first:
        seen["_0"] = lambda c: F.first(c).over(so_far)
    columns = ["key", "doc", "at"]
    rows = rows.withColumns({f"{o}_{c}": of(c) for o, of in seen.items() for c in columns})

    def fits(o: str) -> Column:
        key, doc, at = (F.col(f"{o}_{c}") for c in columns)
        # Nearer ones are compared as well.
        there = F.col("nth") > (max(backs) + 1 if o == "_0" else int(o[1:]))
        elsewhere = (F.col("doc") != doc) | (_line_no(F.col("at")) != _line_no(at))
        similar = there & elsewhere & _may_match(threshold, F.col("key"), F.col("at"), key, at)
        return F.when(similar, F.struct(doc.alias("doc"), at.alias("at"))).alias(o)

    others = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*others, *[fits(o) for o in seen]), list(seen)


def _pairs(rows: DataFrame, found: list[str]) -> DataFrame:
    """The pairs of lines of :func:`_with_earlier`."""
    some = rows.filter(reduce(or_, [F.col(o).isNotNull() for o in found]))
    some = some.select("doc", "at", F.explode(F.array(*found)).alias("other")).filter("other IS NOT NULL")
    return _places(some.select("doc", "at", F.col("other.doc").alias("other_doc"), F.col("other.at").alias("other_at")))


def _places(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "doc", _line_no(F.col("at")).alias("line_no"), "other_doc", _line_no(F.col("other_at")).alias("other_line")
    )


def _near(rows: dict[str, np.ndarray], threshold, skip: int, look: int):
    """``(later, earlier, unsure)``: places in ``rows``, which are sorted by word and corpus order.

    Of each open row the nearest ``look`` rows before it under its word that the filters let pass,
    without the first ``skip`` of them; ``unsure`` are the rows for which more would pass.
    """
    part, whole = threshold
    word, doc, line, n, pos, s1, s2, is_open = (rows[c] for c in _PLACED)
    taken = np.zeros(len(word), dtype=np.int64)
    later, earlier, unsure = [], [], []
    open_, back = np.flatnonzero(is_open), 1
    while True:
        open_ = open_[open_ >= back]
        open_ = open_[word[open_] == word[open_ - back]]
        if not len(open_):
            break
        a, b = open_, open_ - back
        at_most = np.minimum(n[a] - pos[a], n[b] - pos[b]) + np.minimum(pos[a], pos[b])
        apart = np.bitwise_count(s1[a] ^ s1[b]).astype(np.int64) + np.bitwise_count(s2[a] ^ s2[b])
        both = n[a] + n[b]
        passes = (
            (np.minimum(n[a], n[b]) * whole >= np.maximum(n[a], n[b]) * part)
            & (at_most * (whole + part) >= both * part)
            & (apart * (whole + part) <= both * (whole - part))
            & ((doc[a] != doc[b]) | (line[a] != line[b]))
        )
        more = passes & (taken[a] >= look)
        unsure.append(a[more])
        fresh = passes & (taken[a] >= skip) & ~more
        later.append(a[fresh])
        earlier.append(b[fresh])
        taken[a[passes]] += 1
        open_ = a[~more]
        back += 1
    none = [np.zeros(0, dtype=np.int64)]
    return tuple(np.concatenate(parts or none) for parts in (later, earlier, unsure))


def _close(pairs: DataFrame, sketches: DataFrame, threshold, limit: int) -> DataFrame:
    """The pairs whose whole sketches differ in no more bits than similar sets differ in words."""
    part, whole = threshold
    places = ["doc", "line_no"], ["other_doc", "other_line"]
    wanted = pairs.select(*places[0]).unionByName(pairs.select(*places[1]).toDF(*places[0])).distinct()
    if measured_bytes(wanted) <= limit:
        sketches = sketches.join(F.broadcast(wanted), places[0], "left_semi")
    for name, place in zip("ab", places, strict=True):
        of = sketches.toDF(*place, f"{name}_n", f"{name}_sketch")
        pairs = pairs.join(of, place)
    apart = F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch")))
    both = F.col("a_n").cast("bigint") + F.col("b_n")
    return pairs.filter(apart * (whole + part) <= both * (whole - part)).select(*places[0], *places[1]).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, ranks: Column, threshold) -> DataFrame:
    """``(doc, line_no, k1, k2)`` of the lines whose full sets match that of an earlier line."""
    part, whole = threshold
    here, there = ["doc", "line_no"], ["other_doc", "other_line"]
    wanted = pairs.select(*here).unionByName(
        pairs.select(*[F.col(t).alias(h) for h, t in zip(here, there, strict=True)])
    )
    places = stage(
        wanted.groupBy("doc").agg(F.collect_set("line_no").alias("wanted")), "wanted_lines"
    )
    found = lookup_join(docs.filter(F.col("text").isNotNull()), places, ["doc"], "inner")
    # Rows of one doc_id may have fewer lines.
    asked = let(
        F.split(F.lower("text"), "\n"),
        lambda lines: F.transform(
            F.filter("wanted", lambda w: w < F.size(lines)),
            lambda w: F.struct(w.alias("line_no"), F.get(lines, w).alias("line")),
        ),
    )
    rows = found.select("doc", F.explode(asked).alias("asked")).filter(F.col("asked.line").rlike(WORD))
    tokens = _tokens(_distinct_hashes(F.col("asked.line")), ranks)
    sets = rows.select("doc", "asked.line_no", tokens.alias("tokens")).select(
        *here, F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(1), "tokens").alias("k2"), "tokens"
    )
    # Brought together by place once, for both sides of the pairs.
    sets = sets.repartition(*here).dropDuplicates([*here, "k1", "k2"])
    others = sets.toDF("other_doc", "other_line", "other_k1", "other_k2", "b")
    # Equal sets are no matches here: the first line of a set stands for it.
    both = pairs.join(sets, here).join(others, there).filter((F.col("k1") != F.col("other_k1")) | (F.col("k2") != F.col("other_k2")))
    shared = F.size(F.array_intersect("tokens", "b"))
    similar = shared * (whole + part) >= (F.size("tokens") + F.size("b")) * part
    return both.filter(similar).select("doc", "line_no", "k1", "k2").distinct()


def removed_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: tuple[int, int] = THRESHOLD,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``(doc, text_key, line_no)`` of the lines that an earlier line matches; ``doc`` is the id, or the
    largest number for a null id, and ``text_key`` the hash of the text."""
    docs = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_DOC)).alias("doc"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
    )
    ranks = _literal(cell_ranks(docs))
    lines = stage(_line_table(docs, ranks, threshold), "lines")

    # Sets with several lines, and the first of those by corpus order.
    step = F.lit(1 << 32).cast("decimal(10,0)")
    at = F.col("doc").cast("decimal(20,0)") * step + F.col("line_no").cast("decimal(10,0)")
    first_at = lambda of: (F.floor(of / step).cast("bigint"), F.pmod(of, step).cast("int"))
    repeated = lines.groupBy("k1", "k2").agg(F.min(at).alias("first_at"), F.count(F.lit(1)).alias("lines")).filter("lines > 1")
    first_doc, first_line = first_at(F.col("first_at"))
    repeated = stage(
        repeated.select("k1", "k2", "lines", first_doc.alias("first_doc"), first_line.alias("first_line")), "repeated_sets"
    )
    place, keys = ["doc", "line_no"], ["k1", "k2"]
    earliest = (F.col("doc") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    collapsed = repeated.drop("lines")
    if measured_bytes(collapsed) > limit:
        n_lines = lines.count()
        # Lines of the other sets are looked up each; moving all lines to their sets would cost as much as all keys.
        collapsed = repeated.filter(F.col("lines") * _REPEATED_SHARE >= n_lines).drop("lines")
    # Measured, or fewer than the share tells.
    firsts = lines.select(*place, *keys, "n", "sketch", "prefix").join(F.broadcast(collapsed), keys, "left").filter(
        F.col("first_doc").isNull() | earliest
    )

    # Keys under which two sets or more are looked up.  The rows are dealt by the word inside of the key.
    near, far = _LOOKS
    by_word = W.partitionBy("word").orderBy("doc", "at")
    met = _keyed(firsts, threshold).repartition(_word("key")).withColumn("word", _word("key"))
    met = met.withColumns(
        {
            "nth": F.row_number().over(by_word),
            "rows": F.count(F.lit(1)).over(by_word.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        }
    )
    met, found = _with_earlier(met, by_word, range(1, near + 1), threshold, first=True)
    some = reduce(or_, [F.col(o).isNotNull() for o in found], F.col("rows") > near + 2)
    met = stage(met.filter(some).drop("word"), "shared_keys")
    # The keys of all lines are the largest of all shuffles.
    drop_shuffles(docs.sparkSession)
    sketches = firsts.select(*place, "n", "sketch")
    matched = stage(lines.select(*place, *keys).limit(0), "matched_lines")
    for look in (near, far, None):
        if look == near:
            pairs = _pairs(met, found)
            met = met.filter(F.col("rows") > near + 2).select("key", "doc", "at", "nth")
        else:
            # Lines without a match so far, under the keys with lines they were not compared with.
            known = matched.select(*place).distinct()
            words = met.withColumn("word", _word("key"))
            if look == far:
                rows, found = _with_earlier(words, W.partitionBy("word").orderBy("nth"), range(near + 1, far + 1), threshold)
                pairs = _pairs(rows, found).join(known, place, "left_anti")
            else:
                unsure = words.filter(F.col("nth") > far + 2).withColumn("line_no", _line_no(F.col("at")))
                unsure = unsure.join(known, place, "left_anti").drop("line_no")
                earlier = words.filter("nth > 1").select("word", *[F.col(c).alias(f"other_{c}") for c in met.columns])
                elsewhere = (F.col("doc") != F.col("other_doc")) | (_line_no(F.col("at")) != _line_no(F.col("other_at")))
                sides = [F.col(c) for c in ("key", "at", "other_key", "other_at")]
                beyond = (F.col("nth") - F.col("other_nth") > far) & elsewhere & _may_match(threshold, *sides)
                pairs = _places(unsure.join(earlier, "word").filter(beyond))
        pairs = stage(pairs.distinct(), "near_pairs")
        pairs = stage(_close(pairs, sketches, threshold, limit), "line_pairs")
        if not pairs.isEmpty():
            matched = stage(matched.unionByName(_verified(pairs, docs, ranks, threshold)), "matched_lines")
            drop_shuffles(docs.sparkSession)

    # Later lines of a set go, and its first one if that has an earlier match.
    open_sets = (
        repeated.drop("lines").unionByName(matched.select(*keys, at.alias("matched_at")), allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*[F.max(c).alias(c) for c in ("first_doc", "first_line")], F.min("matched_at").alias("matched_at"))
    )
    matched_doc, matched_line = first_at(F.col("matched_at"))
    of_first = (matched_doc == F.col("first_doc")) & (matched_line == F.col("first_line"))
    open_sets = open_sets.select(
        *keys, "first_doc", "first_line",
        (F.col("matched_at").isNotNull() & (F.col("first_doc").isNull() | of_first)).alias("matched"),
    )
    found = lookup_join(
        lines.select(*keys, "text_key", *place), stage(open_sets, "open_sets"), keys, "inner"
    )
    return found.filter(F.col("matched") | ~earliest).select("doc", "text_key", "line_no")


def without_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "text",
    threshold: tuple[int, int] = THRESHOLD,
    count_as: str | None = None,
) -> DataFrame:
    """``docs`` with ``out``: the text without the removed lines; ``count_as`` adds their number."""
    names = docs.columns
    # Positions stand for names, so that no column of ``docs`` clashes.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    spark = docs.sparkSession
    path = new_path(spark, "removed_lines")
    # Only the removed lines are kept of what is staged on the way.
    with temporary(spark):
        gone = removed_lines(plain, f"c{names.index(id_col)}", f"c{names.index(text_col)}", threshold)
        by_doc = gone.groupBy("doc", "text_key").agg(F.collect_set("line_no").alias("gone"))
        by_doc.write.parquet(path)
    by_doc = spark.read.schema(by_doc.schema).parquet(path)
    doc = F.coalesce(doc_id.cast("bigint"), F.lit(_LAST_DOC))
    keyed = plain.withColumns({"doc": doc, "text_key": F.xxhash64(text)})
    joined = lookup_join(keyed, by_doc, ["doc", "text_key"], "left").withColumn(
        "lines", F.split(text, "\n")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(let(F.col("lines"), lambda v: F.transform(kept, lambda i: F.get(v, i))), "\n")
    left = F.when(F.col("gone").isNull() | text.isNull(), text).otherwise(left)
    number = F.coalesce(F.size("gone"), F.lit(0))
    number = F.when(F.col("gone").isNull(), 0).otherwise(number).cast("bigint")
    made = {out: left} | ({count_as: number} if count_as else {})
    columns = [F.col(f"c{i}") if n not in made else made[n] for i, n in enumerate(names)]
    added = [n for n in made if n not in names]
    return joined.select(
        *[c.alias(f"o{i}") for i, c in enumerate(columns)], *[made[n].alias(f"m{i}") for i, n in enumerate(added)]
    ).toDF(*names, *added)


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all rows and columns stay."""
    return without_repeated_lines(docs, **settings)
