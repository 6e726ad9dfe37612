"""Corpora that grow: counts by run, and repositories that arrive on a stream."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tokenloom import commands
from tokenloom.operators import vocabulary
from tokenloom.operators.tokens import tokenize
from tokenloom.sources import store
from tokenloom.streaming import ingest

FILES = "user string, repo string, path string, text string"
OLD = [("u", "a", "u/a/m.py", "def area(w):\n    return w\n"), ("u", "c", "u/c/z.py", "w = 'x'\n"), ("u", "e", "u/e/e.py", "")]
NEW = [("u", "b", "u/b/k.py", "import os\narea = w\n"), ("u", "d", "u/d/y.py", None)]


def file_run(spark, base, run, rows):
    found = spark.createDataFrame(rows, FILES)
    store.write_table(found, f"{base}/files/{run}")
    store.write_table(found.select("user", "repo").distinct(), f"{base}/manifest/{run}")


def full_vocab(spark, rows, threshold):
    docs = spark.createDataFrame(
        [(i, r[3] or "") for i, r in enumerate(sorted(rows, key=lambda r: r[2]))], "doc_id bigint, text string"
    )
    frequency = vocabulary.token_frequency(tokenize(docs), "doc_id")
    return sorted(map(tuple, vocabulary.build_vocab(frequency, threshold).collect()), key=str)


@pytest.mark.parametrize("threshold", [0, 1])
def test_merged_counts_are_those_of_one_count(spark, tmp_path, threshold):
    base = str(tmp_path / "repositories")
    file_run(spark, base, "run=1", OLD)
    commands.count_runs(spark, base)
    # Files that would be opened again could not be read.
    for part in (tmp_path / "repositories/files/run=1").glob("*.parquet"):
        part.write_bytes(b"nothing to read")
    file_run(spark, base, "run=2", NEW)
    merged = commands.count_runs(spark, base)
    got = sorted(map(tuple, vocabulary.build_vocab(merged, threshold).collect()), key=str)
    assert got == full_vocab(spark, OLD + NEW, threshold) and len(store.count_parts(spark, base)) == 2
    # Nothing new: nothing is counted.
    assert commands.count_runs(spark, base).count() == merged.count()
    assert len(store.count_parts(spark, base)) == 2
    assert commands.encode(
        spark, base, 1, str(tmp_path / "dataset"), threshold, model_dir=str(tmp_path / "models")
    )
    assert store.read_encoded(spark, str(tmp_path / "dataset")).count() == 5


def test_counts_of_nothing_and_of_one_run_twice(spark, tmp_path):
    base = str(tmp_path / "repositories")
    assert commands.count_runs(spark, base).count() == 0
    file_run(spark, base, "run=1", OLD)
    commands.count_runs(spark, base)
    # A part that died before its list of runs counts for nothing.
    spark.createDataFrame([("t", "x", 1, ("p", 0))], vocabulary.LOCATED_SCHEMA).write.parquet(
        f"{base}/counts/frequency/part=dead"
    )
    assert commands.count_runs(spark, base).filter("token = 'x' AND t_type = 't'").isEmpty()
    again = spark.createDataFrame([("twice", "run=1")], "part string, run string")
    store.write_table(again, f"{base}/counts/covers/part=twice")
    with pytest.raises(ValueError, match="twice"):
        commands.count_runs(spark, base)


def announce(spark, root, number, rows):
    folder = f"{root}/{number}"
    spark.createDataFrame(rows, FILES).write.parquet(folder)
    announced = spark.createDataFrame([(number, folder)], ingest.DELIVERY_SCHEMA)
    announced.coalesce(1).write.mode("append").parquet(f"{root}/announced")


def deliver(spark, root, per_trigger=1):
    arrivals = ingest.document_stream(spark, f"{root}/announced", ingest.DELIVERY_SCHEMA, per_trigger)
    ingest.stream_ingest(
        arrivals, f"{root}/base", f"{root}/state", ingest.read_deliveries()
    ).awaitTermination()
    filed = store.read_ingested(spark, f"{root}/base")
    return sorted((r.path.removeprefix(f"{root}/base/"), r.text) for r in filed.collect())


@pytest.mark.parametrize("per_trigger", [1, 10])
def test_deliveries(spark, tmp_path, per_trigger):
    root = str(tmp_path)
    announce(spark, root, 1, [("u", "a", "a/x.py", "1"), ("u", "a", "a/src/x.py", "2"), ("u", "a", "a/n.txt", "no")])
    announce(spark, root, 2, [("u", "a", "a/y.py", "late"), ("u", "b", "b/z.py", "3"), ("u", "c", "c/n.txt", "no")])
    expected = [("u/a/x.py", "2"), ("u/b/z.py", "3")]
    assert deliver(spark, root, per_trigger) == expected
    runs = store.finished_runs(spark, f"{root}/base")
    assert len(runs) == (2 if per_trigger == 1 else 1)
    # A repository without a source file is taken as well.
    assert {r.repo for r in store.read_manifest(spark, f"{root}/base").collect()} == {"a", "b", "c"}
    # Spark forgets that the last batch was done, and gives it again.
    last = max(int(c.name) for c in (tmp_path / "state/commits").iterdir() if c.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "state/commits" / name).unlink()
    assert deliver(spark, root, per_trigger) == expected
    assert store.finished_runs(spark, f"{root}/base") == runs
    announce(spark, root, 3, [("v", "a", "a/x.py", "4")])
    assert deliver(spark, root, per_trigger) == [*expected, ("v/a/x.py", "4")]
    # What arrived is counted like any other run.
    counted = commands.count_runs(spark, f"{root}/base").filter("t_type LIKE '%Integer'")
    assert {(r.token, r["count"]) for r in counted.collect()} == {("2", 1), ("3", 1), ("4", 1)}


def test_a_batch_that_died_is_replaced(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    announce(spark, root, 1, [("u", "a", "a/x.py", "1")])
    batch, read = spark.read.parquet(f"{root}/announced"), ingest.read_deliveries()
    write = store.write_table

    def dies(table, path):
        if "/manifest/" in path:
            raise RuntimeError("lost")
        return write(table, path)

    with monkeypatch.context() as patch:
        patch.setattr(store, "write_table", dies)
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(batch, f"{root}/base", "run=s-0", read)
    assert store.read_ingested(spark, f"{root}/base").isEmpty()
    assert ingest.ingest_batch(batch, f"{root}/base", "run=s-0", read)
    assert not ingest.ingest_batch(batch, f"{root}/base", "run=s-0", read)
    assert store.read_ingested(spark, f"{root}/base").count() == 1
    assert ingest.ingest_batch(batch.limit(0), f"{root}/base", "run=s-1", read)
    assert store.read_ingested(spark, f"{root}/base").count() == 1


def test_archives_as_they_arrive(spark, tmp_path):
    packed, base = tmp_path / "archives", str(tmp_path / "base")
    packed.mkdir()

    def pack(name, members):
        with zipfile.ZipFile(packed / name, "w") as archive:
            for member, text in members:
                archive.writestr(member, text)

    def take():
        ingest.stream_ingest(
            ingest.archive_stream(spark, str(packed)), base, str(tmp_path / "state"), ingest.read_archives()
        ).awaitTermination()
        return sorted(r.text for r in store.read_ingested(spark, base).collect())

    pack("ann_a.zip", [("a-1/m.py", "1"), ("a-1/tests/t.py", "no")])
    (packed / "bob_bad.zip").write_bytes(b"nonsense")
    assert take() == ["1"]
    pack("cleo_b.zip", [("b-1/m.py", "2")])
    pack("dan_none.zip", [("none-1/readme.txt", "no")])
    (packed / "again").mkdir()
    pack("again/ann_a.zip", [("a-2/n.py", "changed")])
    pack("again/bob_bad.zip", [("bad-1/m.py", "3")])
    assert take() == ["1", "2", "3"]
    known = {(r.user, r.repo) for r in store.read_manifest(spark, base).collect()}
    assert known == {("ann", "a"), ("bob", "bad"), ("cleo", "b"), ("dan", "none")}
