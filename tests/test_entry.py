import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("attesta/llm", "tests/llm", "corpus_pipeline.py"), ("attesta/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_training_data_part(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for g in gone:
        path = copy / g
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'coverage_refresh' in q and e.entry and set(e.oracle_sql()) <= set(q); print(*q)"
    names = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.split()
    assert "pipeline" not in names
    assert len(names) > 60
    if "attesta/llm" in gone:
        assert not any(n.startswith("op") and n[2].isdigit() for n in names)
        tests = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, capture_output=True, text=True)
        assert tests.returncode == 0, tests.stdout[-2000:]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from attesta.functions.session import shared_folder

    class Unset:
        def get(self, *_):
            return None

    context = SimpleNamespace(master="local-cluster[2,1,1024]", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(getOrElse=lambda _: None))))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=Unset(), sparkContext=context))
