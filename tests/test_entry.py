"""The entry without the corpus operators: everything else must stay registered."""
import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _keys(at):
    code = ("import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); "
            "print(len(q), len(o), sum(k.startswith('op') or k == 'pipeline' for k in q))")
    out = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": str(at)})
    return [int(x) for x in out.stdout.split()]


def test_entry_without_corpus_folders(tmp_path):
    from feedlens.plans import catalog
    catalog.load_all()
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", tmp_path)
    shutil.copytree(f"{REPO}/feedlens", tmp_path / "feedlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert _keys(tmp_path) == [len(catalog.QUERIES), len(catalog.ORACLE), 0]
