import base64
import gzip
import hashlib
import random

import pytest

from tokenloom.llm import warc
from tokenloom.plans.staging import new_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 5}</p>") for i in range(40)]
    rows += [(90, None, None), (91, "http://a b\r\nX: y/é", ""), (92, "u", "é\r\n\r\n" * 90000)]
    rows += [(None, "n", "<p>1</p>"), (3, "http://h/3", "<p>3</p>"), (-4, "u", "<p>4</p>")]
    archives = warc.write_archives(pages(spark, rows), archive_bytes=4000)
    assert archives.count() > 3
    got = warc.read_archives(archives, new_path(spark, "x")).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        one = first[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = ("response", None) if i == one else ("revisit", one)
        expected.append((i, len(data), digest, *kind, None))
    plain = [
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem)
        for r in got
    ]
    assert sorted(map(repr, plain)) == sorted(map(repr, expected))
    urls = {r.page_id: r.url for r in got}
    assert urls[90] == "urn:page:90" and urls[91] == "http://a%20b%0D%0AX:%20y/é"


def test_other_tools_can_read_members():
    data = warc.record(7, "http://x/", b"hello", None)
    text = gzip.decompress(data)
    head, _, rest = text.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert rest.endswith(b"hello\r\n\r\n")


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_any_chunking(size):
    rng = random.Random(size)
    many = [rng.randbytes(rng.randrange(3000)) for _ in range(5)]
    data = b"".join(warc.record(i, "u", p, None) for i, p in enumerate(many))
    chunks = (data[i : i + size] for i in range(0, len(data), size))
    got = list(warc.records(chunks))
    assert [(r[0], r[2], r[-1]) for r in got] == [(i, len(p), None) for i, p in enumerate(many)]


def test_damage_is_told():
    good = warc.record(1, "u", b"x" * 500, None)
    cut = list(warc.records(iter([good + good[:-9]])))
    assert cut[0][0] == 1 and "record 1" in cut[1][-1]
    broken = gzip.compress(gzip.decompress(good).replace(b"x" * 9, b"y" * 9))
    assert "digest" in next(warc.records(iter([broken])))[-1]
    assert list(warc.records(iter([b"no gzip"])))[0][-1]
    assert list(warc.records(iter([gzip.compress(b"WARC/1.1\r\n\r\n")])))[0][-1]


def test_empty(spark):
    archives = warc.write_archives(pages(spark, []))
    assert warc.read_archives(archives, new_path(spark, "x")).collect() == []
