"""Suffix-array dedup: bytes that a 50-byte string of an earlier document covers.

A corpus has far too many suffixes to sort in one place, so strings that may be equal are brought together
first.  Every 50-byte string is led by its anchor, the 16 bytes in it with the least hash (the leftmost
of them); equal strings have equal anchors, and one anchor leads many neighbouring strings.  Only anchors that
occur in more than one document are followed up: the bytes of all strings that an anchor leads, its context, go to
the task that owns the anchor.  There the distinct contexts are indexed, block by block, in a
Burrows-Wheeler transform, and threshold-bounded interval expansion finds the strings of 50 bytes that contexts share.
A string is repeated if the smallest document that has it is not its own.

An anchor whose distinct contexts are more than a task should hold is not indexed.  Its contexts are written out, and each
of their strings looks up the smallest document that has it: an aggregate and a join by the string, spread over all tasks.

Contexts that equal one of a smaller document need no index: they are repeated as a whole.  Exact copies of a
document are recognised before and take no part.

Defined results: null text counts as empty; a null doc_id comes after all others; rows that share a doc_id are not
earlier than each other; texts shorter than the length lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import stage
from .bwt import shared_prefixes
from .shingles import mix

LENGTH = 50
GRAM = 16
_BLOCK_BYTES = 1 << 18
#: Bytes of the contexts of one anchor, with so many for each place, that one task indexes at once.
_GROUP_BYTES = 1 << 20
_OWNER_BYTES = 32
_ROWS = 20_000
_PIECE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_LAST_DOC = (1 << 63) - 1

_table = np.random.Generator(np.random.PCG64(50)).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at every place, by doubling."""
    hashed, width = _table[raw], 1
    while width * 2 <= gram:
        hashed = mix(hashed[:-width] * _STEP + hashed[width:])
        width *= 2
    if width < gram:
        rest = gram - width
        hashed = mix(hashed[:-rest] * _STEP + hashed[rest:])
    return hashed


def leads(raw: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(anchors, hashes)``: the anchor of the string at each place, piece by piece, and the
    hash of the gram there.  Pieces bound the memory; strings do not depend on them."""
    window = length - gram + 1
    for begin in range(0, max(0, len(raw) - length + 1), _PIECE):
        piece = raw[begin : begin + _PIECE + length - 1]
        hashed = _gram_hashes(piece, gram)
        # Hash above, place below: the least is the leftmost of the least.
        least = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)
        width = 1
        while width * 2 <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: -(window - width)], least[window - width :])
        anchors = (least & _PLACE).astype(np.int64)
        yield anchors + begin, hashed[anchors]


def anchor_ranges(raw: np.ndarray, length: int, gram: int):
    """``(anchor, hash, first, last)``: each anchor with the first and last string it leads."""
    parts = list(leads(raw, length, gram))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    anchors = np.concatenate([p[0] for p in parts])
    hashes = np.concatenate([p[1] for p in parts])
    first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    last = np.append(first[1:], len(anchors)) - 1
    return anchors[first], hashes[first], first, last


def _bytes(value) -> np.ndarray:
    """A text without a copy of it."""
    return np.frombuffer(value.as_buffer(), dtype=np.uint8)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, docs, places = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            anchor, hashed, _, _ = anchor_ranges(_bytes(text), length, gram)
            keys.append(hashed.view(np.int64))
            places.append(anchor.astype(np.int32))
            docs.append(np.full(len(anchor), doc, dtype=np.int64))
        if keys:
            columns = [pa.array(np.concatenate(c)) for c in (keys, docs, places)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "place"])


_CONTEXT = "key bigint, context binary, doc bigint, text_key bigint, start bigint, anchor int"


_ARROW_CONTEXT = pa.schema(
    [
        ("key", pa.int64()),
        ("context", pa.binary()),
        ("doc", pa.int64()),
        ("text_key", pa.int64()),
        ("start", pa.int64()),
        ("anchor", pa.int32()),
    ]
)


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The contexts of the anchors that were found to be shared."""
    columns: list[list] = [[] for _ in _ARROW_CONTEXT]

    def flush() -> pa.RecordBatch:
        made = [pa.array(c, f.type) for c, f in zip(columns, _ARROW_CONTEXT, strict=True)]
        for c in columns:
            c.clear()
        return pa.RecordBatch.from_arrays(made, schema=_ARROW_CONTEXT)

    for batch in batches:
        docs, text_keys = (batch.column(i).to_pylist() for i in range(2))
        for doc, text_key, value, places in zip(
            docs, text_keys, batch.column(2), batch.column(3), strict=True
        ):
            raw = _bytes(value)
            anchor, hashed, first, last = anchor_ranges(raw, length, gram)
            shared = places.values.to_numpy(zero_copy_only=False)
            take = np.isin(anchor, shared, kind="sort")
            starts, stops = first[take], last[take] + length
            columns[0] += hashed[take].view(np.int64).tolist()
            columns[1] += [raw[f:t].tobytes() for f, t in zip(starts.tolist(), stops.tolist(), strict=True)]
            columns[2] += [doc] * len(starts)
            columns[3] += [text_key] * len(starts)
            columns[4] += starts.tolist()
            columns[5] += (anchor[take] - starts).tolist()
            if len(columns[0]) > _ROWS:
                yield flush()
    yield flush()


class _Block:
    """Distinct contexts of whole anchors, until there are enough to index."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.half = length, (length + gram) // 2
        self.gram = gram
        self.contexts: list[bytes] = []
        self.docs: list[int] = []
        self.owners: list[list[tuple[int, int, int]]] = []  # (doc, text_key, start)
        self.size = 0

    def add(self, group: list[tuple[bytes, int, int, list]]) -> None:
        """``group``: ``(context, anchor, smallest doc, its occurrences)`` of one anchor."""
        if len(group) < 2:
            return
        # Of the bytes around the anchor, equal strings share half of them on one side.
        side = self.half - self.gram
        halves = [
            [h for h in (c[max(0, a - side) : a + self.gram], c[a : a + self.half]) if len(h) == self.half]
            for c, a, _, _ in group
        ]
        either = Counter(h for own in halves for h in set(own))
        for (context, _, doc, occurrences), own in zip(group, halves, strict=True):
            if any(either[h] > 1 for h in own):
                self.contexts.append(context)
                self.docs.append(doc)
                self.owners.append(occurrences)
                self.size += len(context)

    def ranges(self) -> list[tuple[int, int, int, int]]:
        """Repeated ranges ``(doc, text_key, from, to)`` of the occurrences in the block."""
        out: list[tuple[int, int, int, int]] = []
        group = text = offset = np.zeros(0, dtype=np.int64)
        if len(self.contexts) > 1:
            group, text, offset = shared_prefixes(self.contexts, self.length)
        if len(group):
            docs = np.array(self.docs, dtype=np.int64)[text]
            least = np.full(int(group.max()) + 1, _LAST_DOC, dtype=np.int64)
            np.minimum.at(least, group, docs)
            repeated = least[group] < docs
            text, offset = text[repeated], offset[repeated]
        if len(group) and len(text):
            order = np.lexsort((offset, text))
            text, offset = text[order], offset[order]
            fresh = np.ones(len(text), dtype=bool)
            fresh[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], len(text)) - 1
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                for doc, text_key, start in self.owners[text[b]]:
                    out.append(
                        (doc, text_key, start + int(offset[b]), start + int(offset[e]) + self.length)
                    )
        self.contexts, self.docs, self.owners, self.size = [], [], [], 0
        return out


_RANGE = "doc bigint, text_key bigint, `from` bigint, `to` bigint, context binary"


def _repeated(batches: Iterator[pd.DataFrame], length: int, gram: int) -> Iterator[pd.DataFrame]:
    """Repeated ranges from contexts sorted by (key, context, doc); ranges with their
    context are those of crowded anchors and still to be looked up."""
    block = _Block(length, gram)
    key = context = None
    group: list[tuple[bytes, int, int, list]] = []
    held, crowded = 0, False
    names = ["doc", "text_key", "from", "to", "context"]
    for batch in batches:
        out = []
        for k, c, doc, text_key, start, anchor in zip(*(batch[n] for n in batch.columns), strict=True):
            if k != key:
                block.add(group)
                if block.size >= _BLOCK_BYTES:
                    out += [(*r, None) for r in block.ranges()]
                key, context, group = k, None, []
                held, crowded = 0, False
            if c != context:
                context, smallest = c, doc
                if not crowded:
                    group.append((c, anchor, doc, []))
                    held += len(c)
            if doc != smallest:
                out.append((doc, text_key, start, start + len(c), None))
            elif crowded:
                out.append((doc, text_key, start, start + len(c), c))
            else:
                group[-1][3].append((doc, text_key, start))
                held += _OWNER_BYTES
                if held > _GROUP_BYTES:
                    for one, _, _, places in group:
                        out += [(d, t, s, s + len(one), one) for d, t, s in places]
                    group, crowded = [], True
        yield pd.DataFrame(out, columns=names)
    block.add(group)
    yield pd.DataFrame([(*r, None) for r in block.ranges()], columns=names)


def _looked_up(crowded: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of the contexts of crowded anchors, string by string."""
    placed = crowded.select(
        "doc", "text_key", "from", "context",
        F.explode(F.sequence(F.lit(0), F.octet_length("context") - length)).alias("offset"),
    )
    # Equal strings have equal anchors, so all of a string that counts is here.
    piece = F.substring("context", F.col("offset") + 1, F.lit(length))
    strings = placed.select(
        "doc", "text_key", (F.col("from") + F.col("offset")).alias("from"),
        F.xxhash64(piece).alias("string"), F.xxhash64(F.lit("second"), piece).alias("other_string"),
    )
    keys = ["string", "other_string"]
    several = stage(
        strings.groupBy(*keys)
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        .filter("least < most")
        .select(*keys, "least"),
        "crowded_strings",
    )
    return (
        lookup_join(strings, several, keys, "inner")
        .filter("doc > least")
        .select("doc", "text_key", "from", (F.col("from") + length).alias("to"))
    )


def _merge(packed: np.ndarray) -> list[int]:
    """Ranges, packed as ``from << 32 | to``, without overlaps; touching ones become one."""
    out: list[int] = []
    for value in np.sort(packed).tolist():
        begin, end = value >> 32, value & 0xFFFFFFFF
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row of ``docs`` its ``carry`` columns, ``_text`` (binary) and ``_spans``: the repeated
    byte ranges ``[from, to, from, to, ...]``, maximal and in order."""
    carry = [id_col] if carry is None else carry
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_DOC)).alias("doc"),
        F.xxhash64(text).alias("text_key"),
        F.xxhash64(F.lit("second"), text).alias("other_key"),
        text.cast("binary").alias("text"),
        *[F.col(c).alias(f"_in_{c}") for c in carry],
    )
    keys = ["text_key", "other_key"]
    copied = stage(
        rows.groupBy(*keys)
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        .filter("least < most")
        .select(*keys, "least"),
        "copied_texts",
    )
    marked = lookup_join(rows, copied, keys, "left").withColumn(
        "copy", F.coalesce(F.col("doc") > F.col("least"), F.lit(False))
    )
    firsts = marked.filter(~F.col("copy") & (F.octet_length("text") >= length))

    by_key = W.partitionBy("key")
    anchors = firsts.select("doc", "text").mapInArrow(
        lambda batches: _anchors(batches, length, gram), "key bigint, doc bigint, place int"
    )
    shared = (
        anchors.withColumns({"least": F.min("doc").over(by_key), "most": F.max("doc").over(by_key)})
        .filter("least < most")
        .select("doc", "place")
    )
    places = stage(
        shared.groupBy("doc").agg(F.sort_array(F.collect_set("place")).alias("places")),
        "shared_anchors",
    )
    followed = lookup_join(firsts.select("doc", "text_key", "text"), places, ["doc"], "inner")
    contexts = followed.select("doc", "text_key", "text", "places").mapInArrow(
        lambda batches: _contexts(batches, length, gram), _CONTEXT
    )
    followed_up = stage(
        contexts.repartition("key")
        .sortWithinPartitions("key", "context", "doc")
        .mapInPandas(lambda batches: _repeated(batches, length, gram), _RANGE),
        "ranges",
    )
    ranges = followed_up.filter(F.col("context").isNull()).drop("context")
    crowded = followed_up.filter(F.col("context").isNotNull())
    if not crowded.isEmpty():
        ranges = ranges.unionByName(_looked_up(crowded, length))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["spans"] = [np.array(_merge(r), dtype=np.int32) for r in batch.ranges]
            yield batch[["doc", "text_key", "spans"]]

    packed = F.shiftleft("from", 32).bitwiseOR(F.col("to"))
    spans = stage(
        ranges.groupBy("doc", "text_key")
        .agg(F.collect_list(packed).alias("ranges"))
        .mapInPandas(merged, "doc bigint, text_key bigint, spans array<int>"),
        "spans",
    )
    found = lookup_join(marked, spans, ["doc", "text_key"], "left")
    n = F.octet_length("text")
    none = F.array().cast("array<int>")
    whole = F.when(n >= length, F.array(F.lit(0), n)).otherwise(none)
    return found.select(
        *[F.col(f"_in_{c}").alias(c) for c in carry],
        F.col("text").alias("_text"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none)).alias("_spans"),
    )


def _kept(text: bytes, spans) -> bytes:
    parts, at = [], 0
    for begin, end in zip(spans[::2].tolist(), spans[1::2].tolist(), strict=True):
        parts.append(text[at:begin])
        at = end
    parts.append(text[at:])
    return b"".join(parts)


def span_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``."""
    found = repeated_spans(docs.withColumn("_id", F.col(id_col).cast("bigint")), id_col, text_col, length, gram, ["_id"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column("_text"), batch.column("_spans").to_pylist(), strict=True):
                text, digest, removed, at = memoryview(value.as_buffer()), hashlib.sha256(), 0, 0
                for begin, end in zip(spans[::2], spans[1::2], strict=True):
                    digest.update(text[at:begin])
                    removed, at = removed + end - begin, end
                digest.update(text[at:])
                rows.append((len(text), removed, len(spans) // 2, digest.hexdigest()))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["id", *names])

    return found.mapInArrow(
        report, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    ).withColumnRenamed("id", id_col)


def cut_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept", **settings) -> DataFrame:
    """``docs`` with ``out``: the remaining bytes of the text as binary (cuts may split characters)."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    found = repeated_spans(plain, doc_id, text, carry=plain.columns, **settings)

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_kept(t, s) for t, s in zip(texts, spans, strict=True)])

    return found.select(
        *plain.columns, cut(F.col("_text"), F.col("_spans")).alias("_kept")
    ).toDF(*names, out)
