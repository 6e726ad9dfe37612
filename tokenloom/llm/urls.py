"""URL filters: allow and block rules, and boosted trees for what no rule decides.

A rule fits its host and the subdomains, on paths that start with its path; the longest fitting rule decides.
The URLs that rules decide are the labelled ones.  Gradient-boosted trees learn from a
bounded sample of the distinct ones (``train_rows``, spread by hash over those of either verdict, each
weighted by the rows it stands for) what blocked URLs look like: lengths, depth,
digit ratio, entropy, parameters, and how often the suffixes of the host are blocked, which is
counted over all labelled URLs.  The trees then judge the rest.

Defined results: null and URLs without ``://`` have empty host and path and are judged by the
trees like all others; without labels of both kinds the one kind, or ``allow``, holds for the rest; rows may
repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import lookup_join
from ..plans.staging import stage

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
TRAIN_ROWS = 20_000
TREES = 12
DEPTH = 4
SEED = 11
_PLACES = 1 << 62
#: Added to the counts of a suffix, so that a rare one says little.
SMOOTHING = 5.0

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy",
    "f_params", "f_dashes", "f_last_share", "f_last_rows", "f_two_share", "f_two_rows",
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = text.partition("/")
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        fits = on_host & path.startswith(slash + rule_path)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")

    def plus(total, c):
        share = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return total - share * F.log2(share)

    chars = F.array_distinct(F.array_remove(F.split(text, ""), ""))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), plus)).otherwise(0.0)


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    many = lambda pattern, of=text: F.regexp_count(of, F.lit(pattern)).cast("double")
    n = F.length(text).cast("double")
    return {
        "f_length": n,
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": many(r"/[^/]", path),
        "f_labels": many(r"[^.]+", host),
        "f_digits": F.when(n > 0, many("[0-9]") / n).otherwise(0.0),
        "f_entropy": F.round(entropy(text), 6),
        "f_params": many(r"[?&][^&#=]+="),
        "f_dashes": many("-", host),
        "_last": F.element_at(F.split(host, r"\."), -1),
        "_two": F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0),
    }


def _with_suffixes(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    blocked = F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0))
    for suffix, name in (("_last", "last"), ("_two", "two")):
        seen = labelled.groupBy(suffix).agg(F.count(F.lit(1)).alias("_n"), blocked.alias("_b"))
        rows = lookup_join(rows, stage(seen, "suffixes"), [suffix], "left")
        count = F.coalesce("_n", F.lit(0)).cast("double")
        share = (F.coalesce("_b", F.lit(0)) + SMOOTHING / 2) / (count + SMOOTHING)
        rows = rows.withColumns(
            {f"f_{name}_rows": F.log1p(count), f"f_{name}_share": share}
        ).drop("_n", "_b")
    return rows


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """A model from rows with the features and a verdict, or the only verdict there is."""
    # Which URLs are taken depends on the URL alone.
    place = F.pmod(F.xxhash64("url"), F.lit(_PLACES))
    kinds = (
        labelled.select("verdict", place.alias("place")).distinct()
        .groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    ).collect()
    if len(kinds) < 2:
        return kinds[0].verdict if kinds else "allow"
    rare, common = sorted(kinds, key=lambda k: k.n)
    of_rare = min(rare.n, train_rows // 2)
    chosen, weight = F.lit(False), F.lit(0.0)
    for kind, rows in ((rare, of_rare), (common, train_rows - of_rare)):
        share = min(1.0, max(1, rows) / kind.n)
        taken = (place < int(share * _PLACES)) | (place == kind.least)
        chosen = chosen | ((F.col("verdict") == kind.verdict) & taken)
        weight = F.when(F.col("verdict") == kind.verdict, 1.0 / share).otherwise(weight)
    sample = stage(
        labelled.filter(chosen)
        .groupBy("url", "verdict", *FEATURES)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "url", *FEATURES, (F.col("verdict") == "block").cast("double").alias("label"),
            (F.col("rows") * weight).alias("weight"),
        ),
        "url_sample",
    )
    ordered = sample.repartitionByRange(4, "url").sortWithinPartitions("url", *FEATURES)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ordered)
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, cacheNodeIds=False, weightCol="weight"
    )
    return trees.fit(ready.select("features", "label", "weight"))


def judge(rows: DataFrame, model) -> DataFrame:
    """Add ``judged``: what the model says of each row."""
    if isinstance(model, str):
        return rows.withColumn("judged", F.lit(model))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    said = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return model.transform(vectors).withColumn("judged", said)


def featured(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``(id, url, host, path, rule, verdict)`` with the features; verdict is null without a rule."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), url.alias("url"), *[
        c.alias(n) for n, c in zip(("host", "path"), host_and_path(url), strict=True)
    ])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    lexical = _lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = stage(
        parts.select(
            "*", rule.alias("rule"), verdict.alias("verdict"), *[c.alias(n) for n, c in lexical.items()]
        ),
        "urls",
    )
    return _with_suffixes(rows, rows.filter(F.col("verdict").isNotNull()))


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``(id, host, path, rule, verdict, judged)``: the rule's verdict, else the model's."""
    rows = stage(featured(pages, id_col, url_col, rules), "url_features")
    model = train(rows.filter(F.col("verdict").isNotNull()), train_rows)
    judged = judge(rows, model)
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", "judged").alias("verdict"),
        "judged",
    )
