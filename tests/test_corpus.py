"""File rules, sources, archives, stores, streaming."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import paths as P
from tokenloom.operators import corpus, encoding, vocabulary
from tokenloom.operators import tokens as tok
from tokenloom.plans.staging import stage
from tokenloom.queries.packing import pack_archives
from tokenloom.sources import archives, files, store
from tokenloom.streaming import ingest


def paths(spark, *names):
    return spark.createDataFrame([("u", "r", n) for n in names], "user string, repo string, path string")


def kept(df):
    return sorted(r.path for r in df.collect())


def test_repo_lines(spark):
    lines = ["a/b", "  a/b  ", "# a/b", " # a/b", "", "   ", "a", "a/b/c", "a/", "\tc/d"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got = [tuple(r) for r in corpus.parse_repo_lines(df).collect()]
    assert got == [("a", "b"), ("a", "b"), ("# a", "b"), ("a", ""), ("c", "d")]


def test_basenames(spark):
    keep = ["a.py", "tests.py", "conftest.py", "a_test.py", "mytest_a.py", "test_.py"]
    drop = ["__init__.py", "test_a.py", "__init__.py.py", "a.PY", "a.txt"]
    df = paths(spark, *[f"root/{n}" for n in keep + drop])
    got = kept(corpus.filter_basename(corpus.filter_extension(df)))
    assert got == sorted(f"root/{n}" for n in keep)


def test_test_folders(spark):
    keep = ["testify-1.0/a.py", "root/unittests/a.py", "root/Tests/a.py", "root/testing.py"]
    drop = ["root/tests/a.py", "root/src/testing/a.py", "root/testdata/x/a.py"]
    assert kept(corpus.prune_test_dirs(paths(spark, *keep, *drop))) == sorted(keep)
    inner = paths(spark, "tests/a.py", "src/a.py")
    assert kept(corpus.prune_test_dirs(inner, rooted=False)) == ["src/a.py"]


def test_deeper_file_wins(spark):
    df = paths(spark, "r/u.py", "r/x/u.py", "r/a/v.py", "r/b/v.py")
    assert kept(corpus.dedup_basename(df)) == ["r/b/v.py", "r/x/u.py"]


def test_skip_ingested(spark):
    df = paths(spark, "r/u.py").unionByName(
        spark.createDataFrame([("u", "new", "n/a.py")], "user string, repo string, path string")
    )
    manifest = spark.createDataFrame([("u", "r"), ("u", "r")], "user string, repo string")
    for limit in (0, 10**9):
        assert kept(corpus.skip_ingested(df, manifest, limit=limit)) == ["n/a.py"]


def test_path_parts_and_stats(spark):
    df = paths(spark, "root/a/b.py", "root/c.txt")
    row = df.select(
        P.root_of(F.col("path")), P.below_root(F.col("path")), P.basename(F.col("path")),
        P.depth(F.col("path")), P.destination(F.col("user"), F.col("repo"), F.col("path")),
    ).head()
    assert tuple(row) == ("root", "a/b.py", "b.py", 2, "repositories/u/r/b.py")
    assert tuple(corpus.corpus_stats(df).head()) == (2, 1)
    numbered = corpus.number_documents(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.path) for r in numbered] == [(0, "root/a/b.py"), (1, "root/c.txt")]


def test_scan_decodes_bad_bytes(spark, tmp_path):
    folder = tmp_path / "repositories" / "u" / "r"
    folder.mkdir(parents=True)
    (folder / "a.py").write_bytes(b'ok \xff\xfe x\xe2\x82')
    (folder / "b.txt").write_text("no")
    (tmp_path / "list.txt").write_text("# c\na/b\n\nx\n")
    rows = files.scan_source_files(spark, str(tmp_path / "repositories")).collect()
    assert [(r.user, r.repo, r.basename, r.text) for r in rows] == [
        ("u", "r", "a.py", "ok �� x�")
    ]
    listed = files.list_source_files(spark, str(tmp_path / "repositories")).collect()
    assert [(r.basename, r.length) for r in listed] == [("a.py", 9)]
    repos = files.read_repo_list(spark, str(tmp_path / "list.txt")).collect()
    assert [tuple(r) for r in repos] == [("a", "b")]


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, data in members:
            archive.writestr(name, data)
    return buffer.getvalue()


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archives(spark, tmp_path):
    good = zipped(
        [("root-1/a.py", "1"), ("root-1/b.txt", "2"), ("root-1/x/a.py", "3"), ("root-1/a.py", "4"),
         ("zother/c.py", "5"), ("top.py", "6"), ("root-1/../e.py", "7")]
    )
    for name, data in [("u_r_x", good), ("u_bad", b"nonsense"), ("u_flat", zipped([("a.py", "1")]))]:
        (tmp_path / f"{name}.zip").write_bytes(data)
    members = archives.unpack_archives(archives.scan_archives(spark, str(tmp_path)))
    ok = sorted(tuple(r) for r in archives.accepted(members).collect())
    assert [(u, r, p, bytes(c)) for u, r, p, c in ok] == [
        ("u", "r_x", "root-1/a.py", b"4"), ("u", "r_x", "root-1/x/a.py", b"3"),
    ]
    assert sorted(r.repo for r in archives.rejected(members).collect()) == ["bad", "flat"]


def test_damaged_archives_give_no_members(spark, tmp_path):
    good = zipped([("proj-1/a.py", "x" * 400), ("proj-1/b.py", "y" * 400), ("__MACOSX/proj-1/a.py", "fork"),
                   (".git/c.py", "hidden")])
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("p/a.py", "first")
        archive.writestr("p/b.py", "".join(map(str, range(500))))
    deflated = bytearray(stored.getvalue())
    at = deflated.find(b"p/b.py") + 40
    deflated[at : at + 60] = b"\xff" * 60
    checksum = good.replace(b"y" * 400, b"z" * 400, 1)
    cases = {"u_good": good, "u_deflate": bytes(deflated), "u_checksum": checksum, "u_cut": good[:300]}
    for name, data in cases.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    (tmp_path / "u_large.zip").write_bytes(b"0" * 5000)
    scanned = archives.scan_archives(spark, str(tmp_path), max_bytes=4000)
    members = archives.unpack_archives(scanned).cache()
    got = [(r.repo, r.member_path) for r in archives.accepted(members).collect()]
    assert sorted(got) == [("good", "proj-1/a.py"), ("good", "proj-1/b.py")]
    assert sorted(r.repo for r in archives.rejected(members).collect()) == ["checksum", "cut", "deflate"]
    large = archives.oversized_archives(spark, str(tmp_path), max_bytes=4000).collect()
    assert [(r.repo, r.error) for r in large] == [("large", "too large: 5000 bytes")]


def test_only_the_root_is_cut(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo" / "x" / "repo"
    (root / "ann" / "proj" / "repo").mkdir(parents=True)
    (root / "ann" / "proj" / "repo" / "a.py").write_text("x")
    for directory in (str(root), str(root) + "/", f"file://{root}"):
        row = files.scan_source_files(spark, directory).head()
        assert (row.user, row.repo) == ("ann", "proj")


def test_pack_closes_archives_by_size(spark):
    df = spark.createDataFrame(
        [("u", f"r{i % 2}", f"root/{i}.py", "x" * 100) for i in range(20)],
        "user string, repo string, path string, text string",
    ).coalesce(1)
    packed = pack_archives(df, max_bytes=500)
    assert packed.count() == 8
    members = archives.accepted(archives.unpack_archives(packed))
    assert sorted(r.member_path for r in members.collect()) == sorted(f"root/{i}.py" for i in range(20))


def test_encoded_store(spark, tmp_path):
    path = str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        store.read_encoded(spark, path)
    first = spark.createDataFrame([(1, [0, 1])], "doc_id bigint, ids array<int>")
    store.write_encoded(first, path)
    store.write_encoded(first.limit(0), path)
    assert store.read_encoded(spark, path).count() == 1
    store.write_encoded(first.limit(0), path, redo=True)
    assert store.read_encoded(spark, path).count() == 0
    half = tmp_path / "half"
    half.mkdir()
    with pytest.raises(FileNotFoundError):
        store.read_encoded(spark, str(half))
    store.write_encoded(first, str(half))
    assert store.read_encoded(spark, str(half)).count() == 1
    other = str(tmp_path / "other")
    first.select("doc_id").write.parquet(other)
    with pytest.raises(ValueError, match="no column ids"):
        store.read_encoded(spark, other)


def _vocab(documents, threshold=0):
    frequency = vocabulary.token_frequency(tok.tokenize(documents), "doc_id")
    return vocabulary.build_vocab(frequency, threshold)


def test_vocabulary_store_is_keyed_by_threshold(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a a a b b\n")], "doc_id bigint, text string")
    calls = []

    def build(threshold):
        calls.append(threshold)
        return _vocab(docs, threshold)

    base = str(tmp_path / "vocab")
    sizes = [store.get_vocab(spark, base, build, t).count() for t in (1, 2, 1)]
    assert sizes == [19, 18, 19]
    assert calls == [1, 2]


def test_stream_takes_each_file_once(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, f"v{i} = {i}\nw = v{i}\n" * 2) for i in range(6)], "doc_id bigint, text string"
    )
    vocab = stage(_vocab(docs), "vocab")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs.filter("doc_id < 4").write.parquet(source)

    def run():
        stream = ingest.document_stream(spark, source)
        ingest.stream_encode(stream, vocab, out, state).awaitTermination()
        rows = spark.read.parquet(f"{out}/batch=*").collect()
        return sorted((r.doc_id, r.ids) for r in rows)

    assert [d for d, _ in run()] == [0, 1, 2, 3]
    assert [d for d, _ in run()] == [0, 1, 2, 3]
    docs.filter("doc_id >= 4").write.mode("append").parquet(source)
    expected = encoding.encode_documents(docs, vocab).collect()
    assert run() == sorted((r.doc_id, r.ids) for r in expected)
