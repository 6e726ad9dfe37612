"""Files in, dataset and completed line out."""

import zipfile

import pytest

from tokenloom import commands
from tokenloom.sources import store

SOURCE = "import os\n\n\ndef area(w, h):\n    return w * h\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    for user in ("ann", "bob"):
        folder = root / "repositories" / user / "shapes"
        folder.mkdir(parents=True)
        (folder / "area.py").write_text(SOURCE)
        (folder / "tiny.py").write_text("x = 1\n")
        (folder / "notes.txt").write_text("not code")
    return root


def run(spark, tree, **options):
    return commands.encode(
        spark,
        str(tree / "repositories"),
        output_file=str(tree / "dataset"),
        model_dir=str(tree / "models"),
        frequency_threshold=1,
        **options,
    )


def test_end_to_end(spark, tree):
    assert run(spark, tree) is True
    assert run(spark, tree) is False
    dataset = store.read_encoded(spark, str(tree / "dataset"))
    rows = dataset.collect()
    assert len(rows) == 2 and rows[0].ids == rows[1].ids and rows[0].ids[0] == 0
    ignored = spark.read.parquet(str(tree / "dataset.ignored")).collect()
    assert sorted(r.path.split("/")[-3:] for r in ignored) == [
        ["ann", "shapes", "tiny.py"], ["bob", "shapes", "tiny.py"],
    ]
    report = [r.value for r in spark.read.text(str(tree / "dataset.report/counts")).collect()]
    assert "|Token.Name|_w: 4" in report
    batches = commands.batches(spark, str(tree / "dataset"), n_ctx=8).collect()
    assert {r.batch_id for r in batches} == {0}
    held_out = spark.createDataFrame([(0, SOURCE), (9, "pass\n")], "doc_id bigint, text string")
    counts = commands.fit(spark, str(tree / "dataset"), held_out=held_out)
    judged = {r.batch: r for r in spark.read.parquet(str(tree / "dataset.metrics")).collect()}
    assert judged[0].accuracy > 0.5 and judged[0].loss < 4 and judged[1].n_unknown == 1
    settings = store.read_run(spark, str(tree / "dataset"))
    vocab = commands.dataset_vocab(spark, str(tree / "dataset"))
    assert settings.n_vocab == vocab.count() and settings.threshold == 1
    stored = commands.complete(spark, src="def area(w, h):", dataset=str(tree / "dataset")).head()
    assert stored.completion == "    return w * h\n"
    (tree / "prompt.py").write_text("def area(w, h):")
    for prompt in ({"src": "def area(w, h):"}, {"file": str(tree / "prompt.py")}):
        line = commands.complete(spark, counts, vocab, **prompt).head()
        assert (line.completion, line.status) == ("    return w * h\n", "endofline")
    assert run(spark, tree, redo=True) is True


def test_runs_again_after_changes(spark, tmp_path):
    folder = tmp_path / "repositories/u/r"
    folder.mkdir(parents=True)
    (folder / "a.py").write_text(SOURCE)
    assert run(spark, tmp_path)
    assert commands.encode(
        spark, str(tmp_path / "repositories"), output_file=str(tmp_path / "dataset"),
        model_dir=str(tmp_path / "models"), frequency_threshold=2, redo=True,
    )
    # A grown corpus has a vocabulary of its own.
    (folder / "b.py").write_text("class Shape:\n    pass\n" * 9)
    assert run(spark, tmp_path, redo=True)
    (tmp_path / "half").mkdir()
    assert commands.encode(
        spark, str(tmp_path / "repositories"), output_file=str(tmp_path / "half"),
        model_dir=str(tmp_path / "models"), frequency_threshold=1,
    )
    assert store.read_encoded(spark, str(tmp_path / "half")).count() == 2


def _pack(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members:
            archive.writestr(name, text)


def test_ingest_takes_new_repositories_only(spark, tmp_path):
    packed, base = tmp_path / "archives", str(tmp_path / "repositories")
    packed.mkdir()
    _pack(packed / "ann_shapes.zip", [
        ("shapes-1/area.py", "old"), ("shapes-1/src/area.py", SOURCE), ("shapes-1/tests/x.py", "no"),
        ("shapes-1/__init__.py", ""), ("shapes-1/notes.txt", ""),
    ])
    (packed / "bob_bad.zip").write_bytes(b"nonsense")
    assert commands.ingest(spark, str(packed), base) == 1
    filed = store.read_ingested(spark, base).collect()
    assert [(r.path, r.text) for r in filed] == [(f"{base}/ann/shapes/area.py", SOURCE)]
    # A run that died before its manifest counts for nothing.
    spark.createDataFrame([("x", "y", "p", "t")], "user string, repo string, path string, text string"
                          ).write.parquet(f"{base}/files/run=0dead")
    _pack(packed / "ann_shapes.zip", [("shapes-2/other.py", "changed")])
    _pack(packed / "cleo_new.zip", [("new-1/m.py", SOURCE)])
    assert commands.ingest(spark, str(packed), base) == 1
    assert sorted(r.user for r in store.read_ingested(spark, base).collect()) == ["ann", "cleo"]
    tree = tmp_path / "tree/dan/raw/src"
    tree.mkdir(parents=True)
    (tree / "area.py").write_text(SOURCE)
    assert commands.ingest(spark, str(tmp_path / "tree"), base, packed=False) == 1
    assert commands.ingest(spark, str(tmp_path / "tree"), base, packed=False) == 0
    assert commands.encode(
        spark, base, output_file=str(tmp_path / "dataset"), model_dir=str(tmp_path / "models"),
        frequency_threshold=1,
    )
    assert store.read_encoded(spark, str(tmp_path / "dataset")).count() == 3


def test_arguments(spark, tree):
    with pytest.raises(FileNotFoundError):
        commands.encode(spark, str(tree / "nowhere"), output_file=str(tree / "none"))
    for wrong in ({}, {"src": "x", "file": "y"}):
        with pytest.raises(ValueError):
            commands.complete(spark, None, None, **wrong)


def test_a_run_that_dies_leaves_the_old_one_whole(spark, tmp_path, monkeypatch):
    folder = tmp_path / "repositories/u/r"
    folder.mkdir(parents=True)
    (folder / "a.py").write_text(SOURCE)
    dataset = str(tmp_path / "dataset")
    assert run(spark, tmp_path)

    def state():
        vocab = sorted(map(tuple, commands.dataset_vocab(spark, dataset).collect()))
        return store.read_run(spark, dataset), vocab, [r.ids for r in store.read_encoded(spark, dataset).collect()]

    before = state()
    with monkeypatch.context() as patch:
        patch.setattr(store, "write_encoded", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            commands.encode(
                spark, str(tmp_path / "repositories"), output_file=dataset, model_dir=str(tmp_path / "models"),
                frequency_threshold=5, redo=True,
            )
    assert state() == before and before[0].threshold == 1
    assert not run(spark, tmp_path)
    # An edit of equal length is another corpus.
    (folder / "a.py").write_text(SOURCE.replace("w", "v"))
    assert run(spark, tmp_path, redo=True)
    after = state()
    assert after[0].corpus != before[0].corpus and any(r[2] == "v" for r in after[1])
    # Superseded runs go, but for the last one.
    assert run(spark, tmp_path, redo=True)
    assert len(list((tmp_path / "dataset.runs").iterdir())) == 2


def test_counts_belong_to_their_run(spark, tmp_path):
    folder = tmp_path / "repositories/u/r"
    folder.mkdir(parents=True)
    (folder / "a.py").write_text(SOURCE)
    (folder / "b.py").write_text("x = 1\ny = 2\nz = 3\n")
    dataset = str(tmp_path / "dataset")
    assert run(spark, tmp_path)
    first = commands.fit(spark, dataset, k=1).count()
    assert run(spark, tmp_path, redo=True, token_count_threshold=25)
    assert commands.fit(spark, dataset, k=1).count() < first


def test_archives_without_sources_are_taken_once(spark, tmp_path):
    packed, base = tmp_path / "archives", str(tmp_path / "repositories")
    packed.mkdir()
    _pack(packed / "u_nopy.zip", [("nopy-1/readme.txt", "text")])
    (packed / "u_bad.zip").write_bytes(b"nonsense")
    assert commands.ingest(spark, str(packed), base) == 0
    assert [(r.user, r.repo) for r in store.read_manifest(spark, base).collect()] == [("u", "nopy")]


def test_epochs_share_one_numbering(spark, tree, monkeypatch):
    run(spark, tree)
    dataset = str(tree / "dataset")
    rows = lambda epoch: sorted(
        (r.batch_id, r.row_in_batch, r.doc_id, r.chunk_no)
        for r in commands.batches(spark, dataset, batch_size=2, n_ctx=4, epoch=epoch).collect()
    )
    first = rows(0)
    # Later epochs number nothing again.
    monkeypatch.setattr(commands.sequences, "sequence_index", None)
    assert rows(0) == first
    later = rows(1)
    assert {r[2:] for r in later} == {r[2:] for r in first} and [r[:2] for r in later] == [r[:2] for r in first]
    assert later != first
