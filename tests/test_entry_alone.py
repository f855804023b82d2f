"""The entry module without the `llm` subpackage and the pipeline: it imports and lists the other queries."""

import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_llm_folders():
    copy = Path(tempfile.mkdtemp(prefix="entry-alone-")) / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert not (copy / "traincover" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    probe = (
        "import __spark_entry__ as e; q = e.queries(); "
        "assert 'coverage_sweep' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); "
        "assert set(e.oracle_sql()) <= set(q); print(len(q))"
    )
    done = subprocess.run([sys.executable, "-c", probe], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) >= 40


def test_entry_without_the_pipeline_file_still_has_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "corpus_pipeline.py"))
    probe = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op9_exact_dedup' in q"
    done = subprocess.run([sys.executable, "-c", probe], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
