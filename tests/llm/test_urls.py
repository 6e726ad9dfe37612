import math
from collections import Counter

from pyspark.sql import functions as F

from tokenloom.llm import urls


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, f_length string")


def expected_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def expected_rule(host, path):
    best = None
    for kind, rule in urls.RULES:
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            if best is None or len(rule) > len(best[1]):
                best = (kind, rule)
    return best or (None, None)


def many():
    rows = []
    for i in range(600):
        lang = ("en", "fr", "es", "de")[i % 4]
        tail = ("com", "net", "org")[i % 3]
        spam = "buy-now-" * (2 + i % 2) if tail == "net" and lang in ("fr", "es") else ""
        rows.append((i, f"https://{spam}h{i % 37}.example.{tail}/{lang}/{i}" + "?a=1&b=2" * (i % 2), None))
    return rows


def test_rules_and_verdicts(spark):
    odd = [
        None, "", "no scheme", "http://", "http://COM/", "http://com", "http://com/x", "http://acom/",
        "x://WWW.Example.com/en/1?q#f", "http://example.com/en", "http://a.example.com/en/",
        "http://É.net/es/", "http://a.net/es", "http://a.net?x=/es/", "ftp://a://b.com/", "http://u@x.net/fr/a b",
        "http://x.com/" + "a/" * 40000, "http://www.example.com.\n/en/",
    ]
    rows = many() + [(1000 + i, u, "z") for i, u in enumerate(odd)] + [(None, odd[4], None), many()[0]]
    got = urls.filter_urls(pages(spark, rows)).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = expected_parts(by_id[r.page_id])
        kind, rule = expected_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and r.verdict == (kind or r.judged)


def test_held_out_accuracy(spark):
    rows = urls.featured(pages(spark, many())).filter("verdict IS NOT NULL").cache()
    fold = F.pmod(F.xxhash64("url"), F.lit(3))
    model = urls.train(rows.filter(fold > 0))
    right = urls.judge(rows.filter(fold == 0), model).select(
        (F.col("judged") == F.col("verdict")).alias("ok")
    ).collect()
    # Half of the labels are of either kind; the language in the path is no feature.
    assert len(right) > 60 and sum(r.ok for r in right) > 0.8 * len(right)


def test_the_sample_is_bounded_and_has_both_verdicts(spark, monkeypatch):
    staged, stage = {}, urls.stage

    def kept(df, label):
        staged[label] = stage(df, label)
        return staged[label]

    monkeypatch.setattr(urls, "stage", kept)
    hot = "https://h.example.net/es/everywhere"
    rows = [(i, hot, None) for i in range(1500)]
    rows += [(2000 + i, f"https://h{i % 7}.other.net/fr/{i}", None) for i in range(1500)]
    rows += [(5000 + i, f"https://rare.com/{i}", None) for i in range(2)]
    labelled = urls.featured(pages(spark, rows)).filter("verdict IS NOT NULL")
    assert not isinstance(urls.train(labelled, 300), str)
    sample = staged["url_sample"].collect()
    assert len(sample) <= 400 and len({r.url for r in sample}) == len(sample)
    assert sorted(r.url for r in sample if r.label == 0.0) == ["https://rare.com/0", "https://rare.com/1"]
    assert all(r.weight == 1.0 for r in sample if r.label == 0.0)
    urls.train(labelled, 10_000)
    weights = {r.url: r.weight for r in staged["url_sample"].collect()}
    assert weights[hot] == 1500.0 and len(weights) == 1503


def test_entropy(spark):
    for text in ("", "aaaa", "abab", "http://é.x/%%"):
        counts = Counter(text).values()
        bits = -sum(c / len(text) * math.log2(c / len(text)) for c in counts)
        got = spark.range(1).select(urls.entropy(F.lit(text))).head()[0]
        assert abs(got - bits) < 1e-9


def test_without_labels(spark):
    nothing = pages(spark, [(1, "http://a.org/", None), (2, None, None)])
    assert [r.verdict for r in urls.filter_urls(nothing).collect()] == ["allow", "allow"]
    blocked = pages(spark, [(1, "http://a.net/es/", None), (2, "http://a.org/", None)])
    assert {r.verdict for r in urls.filter_urls(blocked).collect()} == {"block"}
    assert urls.filter_urls(pages(spark, [])).collect() == []
