"""Typed tokens: hand-derived cases, and agreement with the public lexer."""

import bisect
import calendar
import colorsys
import csv
import difflib
import heapq
import itertools
import json.decoder
import re
import shlex
import textwrap

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import lexicon as L
from tokenloom.functions.lexing import lex, normalize_source, split_raw, typed_raw

EOL, SPACE, TAB = (L.TEXT, L.END_OF_LINE), (L.TEXT, L.SPACE), (L.TEXT, L.TAB)


def tokens(spark, text, trim=True):
    df = spark.createDataFrame([(text,)], "text string")
    return [tuple(t) for t in df.select(lex("text", trim)).head()[0]]


def types(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [(t.token, t.t_type) for t in df.select(typed_raw("text")).head()[0]]


@pytest.mark.parametrize(
    "blank, expected",
    [
        (" ", [SPACE]),
        ("  ", [SPACE]),
        ("   ", [SPACE]),
        ("      ", [SPACE]),
        ("    ", [TAB]),
        ("        ", [TAB, TAB]),
        ("\t", [SPACE]),
        ("\t\t\t\t", [TAB]),
        (" ", [SPACE]),
    ],
)
def test_blanks_by_length(spark, blank, expected):
    assert tokens(spark, f"a{blank}b") == [(L.NAME, "a"), *expected, (L.NAME, "b"), EOL]


def test_strings_are_one_token(spark):
    assert tokens(spark, "x = 'a\"b'")[4] == (L.STRING_SINGLE, 'a"b')
    assert tokens(spark, "x = ''")[4] == (L.STRING_SINGLE, "")
    assert tokens(spark, 'x = """m\nl"""')[4] == (L.STRING_DOUBLE, "m\nl")
    assert tokens(spark, r"x = 'a\'b'")[4] == (L.STRING_SINGLE, r"a\'b")
    assert tokens(spark, "x = rb'a'")[4:6] == [(L.STRING_AFFIX, "rb"), (L.STRING_SINGLE, "a")]


def test_unterminated_quote_swallows_nothing(spark):
    assert tokens(spark, "don't\nx") == [
        (L.NAME, "don"), (L.ERROR, "'"), (L.NAME, "t"), EOL, (L.NAME, "x"), EOL,
    ]


def test_comments_and_docstrings_are_dropped(spark):
    assert tokens(spark, '    """doc"""\nx # c') == [TAB, EOL, (L.NAME, "x"), SPACE, EOL]
    assert tokens(spark, 'r"""doc"""\nx')[0] == (L.STRING_AFFIX, "r")
    assert tokens(spark, "#!/bin/sh\nx") == [(L.NAME, "x"), EOL]


def test_leading_newlines(spark):
    assert tokens(spark, "# c\nx") == [(L.NAME, "x"), EOL]
    assert tokens(spark, "# c\nx", trim=False) == [EOL, (L.NAME, "x"), EOL]
    assert tokens(spark, "# c\n# d") == []
    assert tokens(spark, "") == []


def test_source_is_normalised(spark):
    df = spark.createDataFrame([("﻿\r\n\na\r\nb\rc\n\n",)], "text string")
    assert df.select(normalize_source(F.col("text"))).head()[0] == "a\nb\nc\n"


def test_context_types(spark):
    typed = dict(types(spark, "def f(self):\nclass C(Exception):\nfrom a import b\nimport c\n@d\n"))
    assert typed["f"] == L.NAME_FUNCTION
    assert typed["C"] == L.NAME_CLASS
    assert typed["a"] == typed["c"] == L.NAME_NAMESPACE
    assert typed["b"] == L.NAME
    assert typed["@d"] == L.NAME_DECORATOR
    assert typed["Exception"] == L.NAME_EXCEPTION
    assert typed["self"] == L.NAME_PSEUDO
    assert typed["import"] == L.KEYWORD_NAMESPACE
    assert dict(types(spark, "def __init__(x)"))["__init__"] == L.NAME_FUNCTION_MAGIC
    assert dict(types(spark, "x.print"))["print"] == L.NAME
    assert dict(types(spark, "yield from x"))["yield from"] == L.KEYWORD
    assert dict(types(spark, "classes = definition"))["classes"] == L.NAME


@pytest.mark.parametrize(
    "number, t_type",
    [
        ("1", L.INTEGER), ("1_000", L.INTEGER), ("1.", L.FLOAT), (".5", L.FLOAT),
        ("1.5e-3", L.FLOAT), ("1e5", L.FLOAT), ("0xFF", L.HEX), ("0xe5", L.HEX), ("0o17", L.OCT),
        ("0b101", L.BIN),
    ],
)
def test_numbers(spark, number, t_type):
    assert tokens(spark, number)[0] == (t_type, number)


def test_operators(spark):
    got = [t for t, _ in types(spark, "a!=b==c<<d>>e:=f->g**h")]
    assert got == list("a") + ["!="] + list("b") + ["=="] + list("c") + ["<<"] + list("d") + [
        ">>", "e", ":=", "f", "-", ">", "g", "*", "*", "h", "\n"]


def test_split_is_lossless_and_survives_long_literals(spark):
    text = "x = '" + r"\x00" * 200_000 + "'\ny = '''" + "z\n" * 100_000
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(
        F.array_join(split_raw(normalize_source(F.col("text"))), "").alias("joined"),
        F.get(split_raw(normalize_source(F.col("text"))), F.lit(4)).alias("literal"),
    ).head()
    assert row.joined == text.rstrip("\n") + "\n"
    assert len(row.literal) == 800_002


def test_agrees_with_the_public_lexer_on_real_code(spark):
    """Raw typed tokens, outside and inside of literals; how literals are joined
    and blanks counted is tested on cases derived by hand above."""
    lexers = pytest.importorskip("pygments.lexers")
    modules = [bisect, calendar, colorsys, csv, heapq, json.decoder, shlex, textwrap, difflib]
    texts = [open(m.__file__, encoding="utf-8").read() for m in modules]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = df.select("n", typed_raw("text").alias("tokens")).collect()
    total = different = 0
    for row in rows:
        public = [(str(kind), value) for kind, value in lexers.Python3Lexer().get_tokens(texts[row.n])]
        own = [(t.t_type, t.token) for t in row.tokens]
        code = [[t for t in side if "String" not in t[0] and t[1].strip()] for side in (public, own)]
        quoted = ["".join(v for kind, v in side if "String" in kind) for side in (public, own)]
        match = difflib.SequenceMatcher(None, *code, autojunk=False)
        same = sum(b.size for b in match.get_matching_blocks())
        total += max(map(len, code))
        different += max(map(len, code)) - same
        assert abs(len(quoted[0]) - len(quoted[1])) <= 0.02 * len(quoted[0])
    # What remains are dotted import names and words newer lexers add.
    assert total > 15_000
    assert different / total < 0.004


def _public_tokens(lexer, source):
    """What is expected of a text, from the offsets of the public lexer's tokens: literals are
    the text between two equal quotes, blanks are found by an expression in what is left."""
    source = source.strip("\n") + "\n"
    named = [
        (at, str(kind).replace("Token.Text.Whitespace", L.TEXT), value)
        for at, kind, value in lexer.get_tokens_unprocessed(source)
    ]
    quotes = [
        mark for mark in named
        if mark[2] in {"'", '"', 3 * "'", 3 * '"'} and "String" in mark[1] and mark[1] not in L.EXCLUDED_TYPES
    ]
    placed, taken, end = [], [], 0
    for i, (start, _, quote) in enumerate(quotes):
        if start < end:
            continue
        last, name, _ = next(mark for mark in quotes[i + 1 :] if mark[2] == quote)
        end = last + len(quote)
        placed.append((start, (name, source[start + len(quote) : last])))
        taken.append((start, end))
    inside = bytearray(len(source))
    for start, end in taken:
        inside[start:end] = b"\1" * (end - start)
    rest = list(source)
    for at, name, value in named:
        skipped = name in L.EXCLUDED_TYPES
        if inside[at] or skipped or value.strip():
            rest[at : at + len(value)] = "\0" * len(value)
            if not inside[at] and not skipped:
                placed.append((at, (name, value)))
    for blank in re.finditer(r"\n|[^\S\n]+", "".join(rest)):
        tabs, odd = divmod(len(blank[0]), 4)
        kinds = [EOL] if blank[0] == "\n" else [SPACE] if odd else [TAB] * tabs
        placed += [(blank.start(), kind) for kind in kinds]
    ordered = [token for _, token in sorted(placed, key=lambda x: x[0])]
    return list(itertools.dropwhile(lambda token: token == EOL, ordered))


def test_whole_tokens_agree_with_the_public_lexer(spark):
    lexers = pytest.importorskip("pygments.lexers")
    modules = [bisect, calendar, colorsys, csv, heapq, json.decoder, shlex, textwrap, difflib]
    texts = [open(m.__file__, encoding="utf-8").read() for m in modules]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = df.select("n", lex("text").alias("tokens")).collect()
    ours = {r.n: [tuple(t) for t in r.tokens] for r in rows}
    total = different = 0
    for n, text in enumerate(texts):
        theirs = _public_tokens(lexers.Python3Lexer(), text)
        match = difflib.SequenceMatcher(None, theirs, ours[n], autojunk=False)
        same = sum(b.size for b in match.get_matching_blocks())
        total += max(len(theirs), len(ours[n]))
        different += max(len(theirs), len(ours[n])) - same
    # What remains are dotted import names and words newer lexers add.
    assert total > 30_000
    assert different / total < 0.002
