"""The entry module with and without the optional part."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("tokenloom/llm/__pycache__/x.pyc",)])
def test_imports_without_the_optional_part(tmp_path, left):
    shutil.copytree(ROOT / "tokenloom", tmp_path / "tokenloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in left:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
        else:
            (tmp_path / name).touch()
    run = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    queries, sql = (line.split() for line in run.stdout.splitlines()[-2:])
    assert "encode_documents" in queries and set(sql) <= set(queries)
    assert not any(re.match(r"op\d+_|pipeline", q) for q in queries)


@pytest.mark.skipif(not (ROOT / "tokenloom/llm").is_dir(), reason="without the optional part")
def test_adds_the_optional_part():
    run = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=ROOT, capture_output=True, text=True)
    assert "pipeline" in run.stdout and "op10_ngram_join" in run.stdout
