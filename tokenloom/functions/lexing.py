"""Lexing source text with built-in column functions.

``lex`` turns a text column into ``array<struct<t_type, token>>``.  Everything
happens inside one row, so lexing is a narrow step: no shuffle, no Python
worker, and it is valid on a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

_BLANK = r"[ \t\x0B\f\r\x1c-\x1f\x85\p{Z}]"
_DIGITS = r"\p{Nd}(?:_?\p{Nd})*+"
_NAME = r"[a-zA-Z_\p{L}\p{Nl}][a-zA-Z0-9_\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*"

#: One alternative per raw token, first match wins; names and blanks lead, as
#: nine of ten tokens are one of them and nothing else starts like them.  The
#: repeated groups are possessive: Java then loops instead of recursing, so a
#: literal with a million escapes does not overflow the stack.
TOKEN_PATTERN = "|".join(
    [
        r"yield from(?![\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}])",
        _NAME,
        _BLANK + "+",
        r"\n",
        r'(?s:""".*?""")',
        r"(?s:'''.*?''')",
        r'"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*+"',
        r"'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*+'",
        r"#[^\n]*",
        rf"(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?",
        rf"{_DIGITS}[eE][+-]?{_DIGITS}j?",
        r"0[oO](?:_?[0-7])++",
        r"0[bB](?:_?[01])++",
        r"0[xX](?:_?[0-9a-fA-F])++",
        _DIGITS,
        r"!=|==|<<|>>|:=",
        rf"@{_NAME}",
        r"\\\n",
        r"(?s:.)",
    ]
)

_TOKENS = "array<struct<t_type:string,token:string>>"

# Words whose type depends on more than being a name.
_SPECIAL_WORDS = (
    *L.KEYWORDS, *L.KEYWORD_CONSTANTS, *L.OPERATOR_WORDS, *L.DEFINING_KEYWORDS,
    *L.IMPORT_KEYWORDS, *L.BUILTINS, *L.PSEUDO_BUILTINS, *L.EXCEPTIONS,
    *L.MAGIC_FUNCTIONS, *L.MAGIC_VARIABLES,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def normalize_source(text: Column) -> Column:
    """Drop a byte order mark, unify line ends, strip blank lines at both ends
    and end with exactly one newline."""
    bare = F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)
    # Plain replacements: a pattern would walk every text character by character.
    unified = F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.concat(F.btrim(unified, F.lit("\n")), F.lit("\n"))


def split_raw(text: Column) -> Column:
    """Lossless split into raw tokens: joined again they give the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def _is_blank(token: Column) -> Column:
    return token.rlike(f"^{_BLANK}")


def _ends_line(token: Column) -> Column:
    return token.isNull() | token.endswith("\n")


def _is_triple(token: Column) -> Column:
    return (F.length(token) >= 6) & (token.startswith('"""') | token.startswith("'''"))


def _starts_line(raw: Column, i: Column) -> Column:
    """Token ``i`` is the first on its line, white space aside."""
    prev, prev2 = F.get(raw, i - 1), F.get(raw, i - 2)
    return _ends_line(prev) | (_is_blank(prev) & _ends_line(prev2))


def _is_docstring(raw: Column, i: Column) -> Column:
    prefixed = F.lower(F.get(raw, i - 1)).isin(*L.DOCSTRING_PREFIXES)
    return _is_triple(F.get(raw, i)) & (
        _starts_line(raw, i) | (F.coalesce(prefixed, F.lit(False)) & _starts_line(raw, i - 1))
    )


def _is_word(token: Column) -> Column:
    """Starts like a name; ranges of first letters spare most tokens the regex."""
    return (
        ((token >= "a") & (token < "{"))
        | ((token >= "A") & (token < "["))
        | ((token >= "_") & token.rlike(r"^[_\p{L}\p{Nl}]"))
    )


def _declared_type(raw: Column, word: Column, i: Column) -> Column:
    """Type of a word that follows ``def``, ``class``, ``from`` or ``import``,
    null when the statement does not reach it."""
    head = F.get(raw, i - 2)
    imports = (head == "from") | ((head == "import") & _starts_line(raw, i - 2))
    return F.when(
        _is_blank(F.get(raw, i - 1)),
        F.when(head == "class", L.NAME_CLASS)
        .when((head == "def") & ~word.isin(*L.MAGIC_FUNCTIONS), L.NAME_FUNCTION)
        .when(imports & (word != "None"), L.NAME_NAMESPACE),
    )


def _special_type(raw: Column, word: Column, i: Column) -> Column:
    following = F.get(raw, i + 1)
    before_blank = following.isNotNull() & ((following == "\n") | _is_blank(following))
    after_dot = F.coalesce(F.get(raw, i - 1) == ".", F.lit(False))
    return (
        F.when(word.isin(*L.KEYWORDS), L.KEYWORD)
        .when(word.isin(*L.KEYWORD_CONSTANTS), L.KEYWORD_CONSTANT)
        .when(word.isin(*L.OPERATOR_WORDS), L.OPERATOR_WORD)
        .when(word.isin(*L.MAGIC_FUNCTIONS), L.NAME_FUNCTION_MAGIC)
        .when(word.isin(*L.MAGIC_VARIABLES), L.NAME_VARIABLE_MAGIC)
        .when(word.isin(*L.DEFINING_KEYWORDS) & before_blank, L.KEYWORD)
        .when(word.isin(*L.IMPORT_KEYWORDS) & before_blank, L.KEYWORD_NAMESPACE)
        .when(after_dot, L.NAME)
        .when(word.isin(*L.BUILTINS), L.NAME_BUILTIN)
        .when(word.isin(*L.PSEUDO_BUILTINS), L.NAME_PSEUDO)
        .when(word.isin(*L.EXCEPTIONS), L.NAME_EXCEPTION)
        .otherwise(L.NAME)
    )


def _word_type(raw: Column, word: Column, i: Column) -> Column:
    following = F.get(raw, i + 1)
    declared = F.get(raw, i - 2).isin(*L.DEFINING_KEYWORDS, *L.IMPORT_KEYWORDS)
    plain = F.when(word.isin(*_SPECIAL_WORDS), _special_type(raw, word, i)).otherwise(L.NAME)
    return (
        F.when(
            (F.octet_length(word) <= 2)
            & (following.startswith('"') | following.startswith("'"))
            & F.lower(word).isin(*L.STRING_PREFIXES),
            L.STRING_AFFIX,
        )
        .when(declared, F.coalesce(_declared_type(raw, word, i), plain))
        .otherwise(plain)
    )


def _number_type(number: Column) -> Column:
    return (
        F.when(number.rlike("^0[xX]"), L.HEX)
        .when(number.rlike("^0[oO]"), L.OCT)
        .when(number.rlike("^0[bB]"), L.BIN)
        .when(number.rlike(r"[.eE]"), L.FLOAT)
        .otherwise(L.INTEGER)
    )


def raw_type(raw: Column, token: Column, i: Column) -> Column:
    """Type of raw token ``i``, from the token and its neighbours on the line."""
    return (
        F.when(token.isin(" ", "\n"), L.TEXT)
        .when(_is_word(token), _word_type(raw, token, i))
        .when(token.isin(*L.OPERATOR_CHARS, *L.OPERATOR_PAIRS), L.OPERATOR)
        .when(token.isin(*L.PUNCTUATION_CHARS), L.PUNCTUATION)
        .when(_is_blank(token) | token.startswith("\\"), L.TEXT)
        .when(token.rlike(r"^\.?\p{Nd}"), _number_type(token))
        .when(
            token.rlike("(?s)^[\"'].") ,
            F.when(_is_docstring(raw, i), L.DOCSTRING)
            .when(token.startswith('"'), L.STRING_DOUBLE)
            .otherwise(L.STRING_SINGLE),
        )
        .when(
            token.startswith("#"),
            F.when((i == 0) & token.startswith("#!"), L.HASHBANG).otherwise(L.COMMENT),
        )
        .when(token.startswith("@"), L.NAME_DECORATOR)
        .otherwise(L.ERROR)
    )


def _typed(t_type, token) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(t_type).alias("t_type"), as_col(token).alias("token"))


def string_body(literal: Column) -> Column:
    """A string literal without its delimiters."""
    width = F.when(_is_triple(literal), 3).otherwise(1)
    return F.substring(literal, width + 1, F.length(literal) - 2 * width)


@cache
def typed_raw(text: str) -> Column:
    """Raw tokens of a text column as ``array<struct<t_type, token>>``, nothing
    dropped.  Cached, like :func:`lex`."""
    return let(
        split_raw(normalize_source(F.col(text))),
        lambda raw: F.transform(raw, lambda t, i: _typed(raw_type(raw, t, i), t)),
    )


def _tabs(blank: Column) -> Column:
    return F.array_repeat(_typed(L.TEXT, L.TAB), (F.length(blank) / 4).cast("int"))


def _normalized(typed: Column, excluded) -> Column:
    """The one vocabulary token a raw token stands for, null if it stands for none or for several tabs."""
    t_type, token = typed["t_type"], typed["token"]
    tabs = F.length(token) % 4 == 0
    return (
        F.when(
            t_type == L.TEXT,
            F.when(token == "\n", _typed(L.TEXT, L.END_OF_LINE))
            .when(token.startswith("\\"), typed)
            .when(~tabs, _typed(L.TEXT, L.SPACE))
            .when(F.length(token) == 4, _typed(L.TEXT, L.TAB)),
        )
        .when(t_type.isin(*excluded), None)
        .when(
            t_type.isin(L.STRING_SINGLE, L.STRING_DOUBLE, L.DOCSTRING),
            _typed(t_type, string_body(token)),
        )
        .otherwise(typed)
    )


def trim_leading_newlines(tokens: Column) -> Column:
    """Drop the end-of-line tokens a file starts with."""
    is_other = lambda t: t["token"] != L.END_OF_LINE
    first_other = F.array_position(F.transform(tokens, is_other), True)
    return F.when(
        F.get(tokens, F.lit(0))["token"] == L.END_OF_LINE,
        F.when(
            first_other > 0,
            F.slice(tokens, first_other.cast("int"), F.size(tokens)),
        ).otherwise(F.slice(tokens, 1, 0)),
    ).otherwise(tokens)


@cache
def lex(text: str, trim: bool = True, excluded: tuple[str, ...] = L.EXCLUDED_TYPES) -> Column:
    """Typed, normalised tokens of a text column in order.

    The word lists make this a large expression; it is built once per column
    name, which saves over a second per query.
    """
    space, newline = (_typed(L.TEXT, t) for t in (L.SPACE, L.END_OF_LINE))

    def one(raw: Column, token: Column, i: Column) -> Column:
        # The commonest tokens first: blanks need no typing, words and punctuation no normalising.
        found = F.when(token == " ", space)
        found = found.when(_is_word(token), _typed(_word_type(raw, token, i), token)).when(token == "\n", newline)
        if L.PUNCTUATION not in excluded:
            found = found.when(token.isin(*L.PUNCTUATION_CHARS), _typed(L.PUNCTUATION, token))
        return found.otherwise(
            let(_typed(raw_type(raw, token, i), token), lambda typed: _normalized(typed, excluded))
        )

    def whole(raw: Column, ones: Column) -> Column:
        # Most raw tokens stand for one token each, so only texts with others need an array for every token.
        several = lambda token: F.when(_is_blank(token), _tabs(token)).otherwise(F.array().cast(_TOKENS))
        each = F.transform(
            ones, lambda t, i: F.when(t.isNotNull(), F.array(t)).otherwise(several(F.get(raw, i)))
        )
        return F.when(F.exists(ones, lambda t: t.isNull()), F.flatten(each)).otherwise(ones)

    tokens = let(
        split_raw(normalize_source(F.col(text))),
        lambda raw: let(
            F.transform(raw, lambda token, i: one(raw, token, i)), lambda ones: whole(raw, ones)
        ),
    )
    return let(tokens, trim_leading_newlines) if trim else tokens
