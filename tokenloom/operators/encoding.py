"""Tokens to ids and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.lexing import let
from ..plans.lookup import BROADCAST_LIMIT, counted_lookup, lookup_join, measured_bytes
from ..plans.staging import stage
from .tokens import lex_documents, typed_key


#: Stands for a missing id while ids travel; no vocabulary is that large.
_NO_ID = (1 << 31) - 1
#: Stands for a token that is not among the frequent ones.
_RARE = -1
#: An entry with at least one token in so many is frequent; there are no more such entries.
_FREQUENT_SHARE = 100_000


def _unknown_id(open_types) -> Column:
    ids = [v for i, t in enumerate(sorted(open_types), start=1) for v in (F.lit(t), F.lit(i))]
    return F.try_element_at(F.create_map(*ids), F.col("t_type"))


def _entries(vocab: DataFrame, open_types) -> DataFrame:
    return vocab.filter(F.col("id") > len(open_types)).select("t_type", "token", "id")


def encode_tokens(
    tokens: DataFrame,
    vocab: DataFrame,
    on_missing: str = "error",
    open_types=L.OPEN_CLASS_TYPES,
    limit: int = BROADCAST_LIMIT,
    fits: bool | None = None,
) -> DataFrame:
    """Add ``id``: the vocabulary id, else the unknown id of the token's type.

    A closed-class token the vocabulary lacks raises, or gives null with
    ``on_missing="null"``.
    """
    if on_missing not in ("error", "null"):
        raise ValueError("on_missing must be 'error' or 'null'")
    if fits is None:
        fits = vocab_fits(vocab, open_types, limit)
    if fits:
        entries = _entries(vocab, open_types)
        joined = lookup_join(tokens, entries, ["t_type", "token"], "left", fits=True)
    else:
        # The vocabulary knows its hot keys, so the tokens are read once.
        counted = vocab.filter(F.col("id") > len(open_types)).select("t_type", "token", "id", "count")
        joined = counted_lookup(tokens, counted, ["t_type", "token"], "count", limit=-1)
    return joined.withColumn("id", _resolved(on_missing, open_types))


def _resolved(on_missing: str, open_types) -> Column:
    """The id found for a token, else the unknown id of its type."""
    found = F.coalesce(F.col("id"), _unknown_id(open_types))
    if on_missing == "error":
        # A null token stands for an empty document.
        found = F.coalesce(
            found,
            F.when(
                F.col("t_type").isNotNull(),
                F.raise_error(F.concat(F.lit("not in the vocabulary: "), typed_key())).cast("int"),
            ),
        )
    return found


def collect_ids(encoded_tokens: DataFrame, id_col: str = "doc_id", add_start: bool = True) -> DataFrame:
    """One id array per document, in token order; a token without an id stays
    as a null element.

    Position and id travel as one number: the array to sort is then made of
    plain longs, half the size of (position, id) pairs.
    """
    # A document without tokens has a null position and so no element.
    packed = F.shiftleft(F.col("pos").cast("bigint"), 32) + F.coalesce("id", F.lit(_NO_ID))
    low = lambda v: v.bitwiseAND(F.lit(_NO_ID)).cast("int")
    ids = F.transform(
        F.sort_array(F.collect_list(packed)), lambda v: F.nullif(low(v), F.lit(_NO_ID))
    )
    if add_start:
        ids = F.concat(F.array(F.lit(L.START_ID)), ids)
    return encoded_tokens.groupBy(id_col).agg(ids.alias("ids"))


def _dealt(entries: DataFrame, hashed: Column) -> tuple[DataFrame, int]:
    """One row with ``slots``: unique ``(key, value)`` entries as an array of small maps, dealt by ``hashed``; and
    the length of that array."""
    n = max(entries.count(), 1)
    pairs = F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs")
    filled = entries.groupBy(F.pmod(hashed, F.lit(n)).cast("bigint").alias("slot")).agg(pairs)
    every = entries.sparkSession.range(n).withColumnRenamed("id", "slot").join(filled, "slot", "left")
    nothing = F.array().cast(filled.schema["pairs"].dataType)
    dealt = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("pairs", nothing).alias("pairs"))))
    return every.agg(F.transform(dealt, lambda s: F.map_from_entries(s["pairs"])).alias("slots")), n


def _slots(vocab: DataFrame, open_types) -> tuple[DataFrame, int]:
    """:func:`_dealt` of the ids by token."""
    entries = _entries(vocab, open_types).filter("t_type IS NOT NULL AND token IS NOT NULL")
    entries = entries.select(F.struct("t_type", "token").alias("key"), F.col("id").alias("value"))
    return _dealt(entries, F.xxhash64("key"))


def _by_sharing(rows: DataFrame, id_col: str) -> tuple[DataFrame | None, DataFrame]:
    """``rows`` whose id no other has, and those that share theirs, found by a count of the ids alone; all as the latter
    if the shared ids are too many for a broadcast."""
    counted = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"))
    shared = stage(counted.filter("_rows > 1").select(F.col(id_col).alias("_shared")), "shared-ids")
    if measured_bytes(shared) > BROADCAST_LIMIT:
        return None, rows
    same = F.col(id_col).eqNullSafe(F.col("_shared"))
    # Measured above.
    return tuple(rows.join(F.broadcast(shared), same, how) for how in ("left_anti", "left_semi"))


def _known(table: Column, n: int, token: Column) -> Column:
    """The id of a token by the ``n`` slots of ``table``."""
    at = F.pmod(F.xxhash64(token), F.lit(n)).cast("int")
    return F.try_element_at(F.get(table, at), token)


def _known_all(tokens: Column, table: Column, n: int, one) -> Column:
    """``one(token, id)`` of each token with the id that the slots give, null if they lack it."""
    blank = F.struct(F.lit(L.TEXT).alias("t_type"), F.lit(L.SPACE).alias("token"))

    def found(token: Column, blank_id: Column) -> Column:
        # Half of the tokens are single blanks, so their id is looked up once for each document.
        is_blank = (token["token"] == L.SPACE) & (token["t_type"] == L.TEXT)
        return F.coalesce(F.when(is_blank, blank_id), _known(table, n, token))

    return let(
        _known(table, n, blank),
        lambda blank_id: F.transform(tokens, lambda token: one(token, found(token, blank_id))),
    )


def _coded(tokens: Column, slots: Column, n: int, on_missing: str, open_types) -> Column:
    """Ids of an array of tokens, as :func:`encode_tokens` gives them; ``slots`` are the ``n`` of :func:`_slots`."""
    unknown = F.create_map(
        *[v for i, t in enumerate(sorted(open_types), start=1) for v in (F.lit(t), F.lit(i))]
    )

    def one(token: Column, found: Column) -> Column:
        found = F.coalesce(found, F.try_element_at(unknown, token["t_type"]))
        if on_missing == "error":
            key = F.concat(F.lit("|"), token["t_type"], F.lit("|_"), token["token"])
            lacking = F.raise_error(F.concat(F.lit("not in the vocabulary: "), key)).cast("int")
            found = F.coalesce(found, F.when(token["t_type"].isNotNull(), lacking))
        return found

    coded = let(slots, lambda table: _known_all(tokens, table, n, one))
    return F.coalesce(coded, F.array().cast("array<int>"))


def _merged(coded: DataFrame, id_col: str) -> DataFrame:
    """One row for each id: documents that share one are merged by position, as :func:`collect_ids` does."""
    packed = F.transform(
        "ids", lambda v, i: F.shiftleft(i.cast("bigint"), 32) + F.coalesce(v, F.lit(_NO_ID))
    )
    low = lambda v: F.nullif(v.bitwiseAND(F.lit(_NO_ID)).cast("int"), F.lit(_NO_ID))
    ids = F.transform(F.sort_array(F.flatten(F.collect_list(packed))), low)
    return coded.groupBy(id_col).agg(ids.alias("ids"))


def _encode_rare(
    lexed: DataFrame, vocab: DataFrame, id_col: str, on_missing: str, open_types, share: int = _FREQUENT_SHARE
) -> DataFrame:
    """``(id, ids)`` by a vocabulary beyond a broadcast.

    The entries with at least one token in ``share``, by the counts of the vocabulary, are looked up inside of the rows.
    Only the other tokens are moved to their entries, and ids, not tokens, are brought together by document.
    """
    counted = vocab.filter(F.col("id") > len(open_types)).select("t_type", "token", "id", "count")
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint")).head()[0]
    often = F.coalesce((F.col("count") > 0) & (F.col("count") * share >= F.lit(total)), F.lit(False))
    table, n = _slots(counted.filter(often), open_types)
    slots = stage(table, "slots").scalar()
    rare = lambda token, found: F.coalesce(found, F.lit(_RARE))
    # As in encode_lexed.
    ids = let(F.col("_slots"), lambda table: _known_all(F.col("tokens"), table, n, rare))
    coded = lexed.select(id_col, "tokens", slots.alias("_slots")).select(id_col, "tokens", ids.alias("ids"))
    placed = F.transform(
        "tokens",
        lambda token, i: F.struct(
            i.alias("pos"), token["t_type"].alias("t_type"), token["token"].alias("token"), F.get("ids", i).alias("id")
        ),
    )
    left = F.transform(F.filter(placed, lambda p: p["id"] == _RARE), lambda p: p.dropFields("id"))
    coded = stage(coded.select(id_col, "ids", left.alias("rare")), "coded")

    rows = coded.select(id_col, F.inline("rare"))
    joined = rows.join(counted.filter(~often).drop("count").hint("merge"), ["t_type", "token"], "left")
    packed = F.shiftleft(F.col("pos").cast("bigint"), 32) + F.coalesce(_resolved(on_missing, open_types), F.lit(_NO_ID))
    nothing = F.array().cast("array<int>")
    parts = coded.select(id_col, F.coalesce("ids", nothing).alias("ids"), F.lit(None).cast("bigint").alias("packed"))
    parts = parts.unionByName(
        joined.select(id_col, F.lit(None).cast("array<int>").alias("ids"), packed.alias("packed"))
    )
    found = lambda ids: F.filter(
        F.transform(ids, lambda v, i: F.when(v != _RARE, F.shiftleft(i.cast("bigint"), 32) + v)), lambda p: p.isNotNull()
    )
    every = F.concat(F.flatten(F.transform(F.collect_list("ids"), found)), F.collect_list("packed"))
    low = lambda v: F.nullif(v.bitwiseAND(F.lit(_NO_ID)).cast("int"), F.lit(_NO_ID))
    return parts.groupBy(id_col).agg(F.transform(F.sort_array(every), low).alias("ids"))


def encode_lexed(
    lexed: DataFrame,
    vocab: DataFrame,
    id_col: str = "doc_id",
    add_start: bool = True,
    on_missing: str = "error",
    limit: int = BROADCAST_LIMIT,
    fits: bool | None = None,
) -> DataFrame:
    """``(id, ids, n_tokens)`` per document, those without tokens included.

    A vocabulary that fits into a broadcast is sent to all tasks as a table of hash slots, and the tokens of a
    document are looked up where it lies: nothing is exploded, sorted or moved.  Only documents that share an id,
    found by a count of the ids alone, are brought together.  With a larger vocabulary only the tokens that are not
    frequent are moved to their entries.
    """
    if on_missing not in ("error", "null"):
        raise ValueError("on_missing must be 'error' or 'null'")
    if fits is None:
        fits = vocab_fits(vocab, limit=limit)
    if not fits:
        encoded = _encode_rare(lexed, vocab, id_col, on_missing, L.OPEN_CLASS_TYPES)
        if add_start:
            encoded = encoded.withColumn("ids", F.concat(F.array(F.lit(L.START_ID)), "ids"))
        return encoded.withColumn("n_tokens", F.size("ids"))
    table, n = _slots(vocab, L.OPEN_CLASS_TYPES)
    slots = stage(table, "slots").scalar()

    def coded(rows: DataFrame) -> DataFrame:
        # The table is a column of its own first, as a subquery is not allowed inside of a function of
        # arrays; the optimizer puts it there, so it is not copied into the rows.
        ids = _coded(F.col("tokens"), F.col("_slots"), n, on_missing, L.OPEN_CLASS_TYPES)
        return rows.select(id_col, "tokens", slots.alias("_slots")).select(id_col, ids.alias("ids"))

    alone, sharing = _by_sharing(lexed, id_col)
    encoded = _merged(coded(sharing), id_col)
    if alone is not None:
        encoded = coded(alone).unionByName(encoded)
    if add_start:
        encoded = encoded.withColumn("ids", F.concat(F.array(F.lit(L.START_ID)), "ids"))
    return encoded.withColumn("n_tokens", F.size("ids"))


def encode_documents(
    documents: DataFrame,
    vocab: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    add_start: bool = True,
    on_missing: str = "error",
    limit: int = BROADCAST_LIMIT,
    fits: bool | None = None,
) -> DataFrame:
    """:func:`encode_lexed` from texts."""
    lexed = lex_documents(documents, id_col, text_col)
    return encode_lexed(lexed, vocab, id_col, add_start, on_missing, limit, fits)


def vocab_fits(
    vocab: DataFrame, open_types=L.OPEN_CLASS_TYPES, limit: int = BROADCAST_LIMIT
) -> bool:
    """Whether the vocabulary can be broadcast; pass it on where one is used often."""
    return measured_bytes(_entries(vocab, open_types)) <= limit


def document_lengths(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, F.size("ids").alias("n_tokens"))


def long_enough(encoded: DataFrame, min_tokens: int = L.MIN_TOKENS) -> DataFrame:
    """Documents with at least ``min_tokens`` ids, the start token counted.

    The ids pass a generator first: the optimizer would move the filter below the step that makes them, and all
    tokens would be looked up once for the filter and once more for the result.
    """
    ids = F.explode(F.array("ids")).alias("ids")
    once = encoded.select(*[ids if c == "ids" else F.col(c) for c in encoded.columns])
    return once.filter(F.size("ids") >= min_tokens)


def too_short(encoded: DataFrame, min_tokens: int = L.MIN_TOKENS) -> DataFrame:
    """The documents :func:`long_enough` drops."""
    return encoded.filter(F.size("ids") < min_tokens)


def decoded_text(t_type: Column, token: Column) -> Column:
    """Text one vocabulary entry stands for."""
    return (
        F.when(t_type.isNull() & (token == L.START_TOKEN), "")
        .when((t_type == L.TEXT) & (token == L.END_OF_LINE), "\n")
        .when((t_type == L.TEXT) & (token == L.SPACE), " ")
        .when((t_type == L.TEXT) & (token == L.TAB), "    ")
        .when(t_type.contains("String"), F.concat(F.lit("'"), token, F.lit("'")))
        .otherwise(token)
    )


def decode_tokens(
    ids: DataFrame, vocab: DataFrame, limit: int = BROADCAST_LIMIT, on_missing: str = "error"
) -> DataFrame:
    """Add ``t_type``, ``token`` and the decoded ``piece`` to rows with an ``id``.

    An id the vocabulary lacks raises, or keeps its row with a null piece with
    ``on_missing="null"``.  A null id always has a null piece.
    """
    if on_missing not in ("error", "null"):
        raise ValueError("on_missing must be 'error' or 'null'")
    entries = vocab.select("id", "t_type", "token")
    piece = decoded_text(F.col("t_type"), F.col("token"))
    if on_missing == "error":
        message = F.concat(F.lit("not in the vocabulary: id "), F.col("id").cast("string"))
        lacking = F.col("token").isNull() & F.col("id").isNotNull()
        piece = F.when(lacking, F.raise_error(message).cast("string")).otherwise(piece)
    return lookup_join(ids, entries, ["id"], "left", limit).withColumn("piece", piece)


def decode_documents(
    encoded: DataFrame,
    vocab: DataFrame,
    id_col: str = "doc_id",
    limit: int = BROADCAST_LIMIT,
    on_missing: str = "error",
) -> DataFrame:
    """``(id, text)`` from id arrays; the text has strings in single quotes and
    no comments, as encoding dropped both.  What cannot be decoded raises, or with
    ``on_missing="null"`` makes the text null; no ids give an empty text.

    While the vocabulary fits into a broadcast it goes to all tasks as a table of slots, and the ids of a document are
    decoded where it lies; only documents that share an id are exploded.
    """
    if on_missing not in ("error", "null"):
        raise ValueError("on_missing must be 'error' or 'null'")
    entries = vocab.filter("id IS NOT NULL AND token IS NOT NULL").select(
        F.col("id").alias("key"), decoded_text(F.col("t_type"), F.col("token")).alias("value")
    )
    if measured_bytes(entries) > limit:
        return _decoded_rows(encoded, vocab, id_col, limit, on_missing)
    table, n = _dealt(entries, F.col("key"))
    slots = stage(table, "slots").scalar()

    def one(table: Column, id: Column) -> Column:
        found = F.try_element_at(F.get(table, F.pmod(id, F.lit(n)).cast("int")), id)
        if on_missing == "error":
            message = F.concat(F.lit("not in the vocabulary: id "), id.cast("string"))
            found = F.coalesce(found, F.when(id.isNotNull(), F.raise_error(message).cast("string")))
        return found

    alone, sharing = _by_sharing(encoded.select(id_col, "ids"), id_col)
    merged = _decoded_rows(sharing, vocab, id_col, limit, on_missing)
    if alone is None:
        return merged
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    # As in encode_lexed.
    pieces = let(F.col("_slots"), lambda table: F.transform(ids, lambda id: one(table, id)))
    text = let(
        pieces, lambda ps: F.when(~F.exists(ps, lambda p: p.isNull()), F.array_join(ps, ""))
    )
    decoded = alone.select(id_col, ids.alias("ids"), slots.alias("_slots")).select(id_col, text.alias("text"))
    return decoded.unionByName(merged)


def _decoded_rows(
    encoded: DataFrame, vocab: DataFrame, id_col: str, limit: int, on_missing: str
) -> DataFrame:
    """:func:`decode_documents` by rows of single ids.

    Documents are spread by id while they are still ids: text pieces are ten
    times as large, and their grouping then needs no shuffle.
    """
    rows = encoded.repartition(id_col).select(
        id_col, F.posexplode_outer("ids").alias("pos", "id")
    )
    pieces = decode_tokens(rows, vocab, limit, on_missing)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    text = F.array_join(F.transform(ordered, lambda p: p["piece"]), "")
    lacking = F.count_if(F.col("pos").isNotNull() & F.col("piece").isNull())
    return pieces.groupBy(id_col).agg(F.when(lacking == 0, text).alias("text"))
