"""From documents to typed token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.lexing import lex, typed_raw
from ..plans.parallel import spread


def lex_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", trim: bool = True
) -> DataFrame:
    """``(id, tokens array<struct<t_type, token>>)``, one row per document; stage
    it when more than one step needs the tokens."""
    narrow = spread(documents.select(id_col, text_col), id_col)
    return narrow.select(id_col, lex(text_col, trim).alias("tokens"))


def tokenize(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", trim: bool = True
) -> DataFrame:
    """``(id, pos, t_type, token)`` with dense positions per document."""
    narrow = spread(documents.select(id_col, text_col), id_col)
    return _token_rows(narrow, id_col, lex(text_col, trim))


def explode_tokens(lexed: DataFrame, id_col: str = "doc_id", outer: bool = False) -> DataFrame:
    """Token rows of :func:`lex_documents`; with ``outer`` a document without
    tokens keeps one row, all null."""
    return _token_rows(lexed, id_col, F.col("tokens"), outer)


def _token_rows(df: DataFrame, id_col: str, tokens: Column, outer: bool = False) -> DataFrame:
    # The generator takes the lexing expression itself: given a computed column,
    # the optimizer would add a filter on it and lex every text again.
    explode = F.posexplode_outer if outer else F.posexplode
    return df.select(id_col, explode(tokens).alias("pos", "_t")).select(
        id_col, "pos", "_t.t_type", "_t.token"
    )


def raw_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, t_type, token)`` before anything is dropped or normalised."""
    narrow = spread(documents.select(id_col, text_col), id_col)
    return _token_rows(narrow, id_col, typed_raw(text_col))


def drop_excluded(tokens: DataFrame, excluded=L.EXCLUDED_TYPES) -> DataFrame:
    """Drop tokens whose type is exactly one of ``excluded``."""
    return tokens.filter(~F.col("t_type").isin(*excluded))


def open_class_table(spark, open_types=L.OPEN_CLASS_TYPES) -> DataFrame:
    """The open-class types with their unknown keys and ids, a constant table."""
    rows = [(t, unknown_key(t), i) for i, t in enumerate(sorted(open_types), start=1)]
    return spark.createDataFrame(rows, "t_type string, key string, id int")


def keep_open_class(tokens: DataFrame, open_types=L.OPEN_CLASS_TYPES) -> DataFrame:
    """Tokens whose type is open-class (semi-join with the constant table)."""
    table = open_class_table(tokens.sparkSession, open_types).select("t_type")
    return tokens.join(F.broadcast(table), "t_type", "left_semi")


def unknown_key(t_type: str) -> str:
    return f"|{t_type}|_{L.UNKNOWN_TOKEN}"


def typed_key(t_type="t_type", token="token"):
    """The vocabulary key ``|type|_token``."""
    return F.concat(F.lit("|"), F.col(t_type), F.lit("|_"), F.col(token))


def split_key(keys: DataFrame) -> DataFrame:
    """Back from ``key`` to type and token, cut at the first underscore.

    The start token is its own key and has no type, as in the vocabulary.
    """
    parts, start = F.split("key", "_", 2), F.col("key") == L.START_TOKEN
    t_type = F.when(~start, F.btrim(F.get(parts, F.lit(0)), F.lit("|")))
    token = F.when(start, F.col("key")).otherwise(F.get(parts, F.lit(1)))
    return keys.withColumn("t_type", t_type).withColumn("token", token)
