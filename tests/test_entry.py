import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).parent.parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts_valid_traces(spark):
    r = entry.entry(spark).first()
    assert r.n == r.n_valid + r.n_invalid > 0


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'validate_summary' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_nothing_else_imports_them():
    for p in [*(REPO / "tracelake").rglob("*.py"), REPO / "bench.py"]:
        if "llm" not in p.relative_to(REPO).parts:
            assert not re.search(r"(?m)^\s*(from|import)\b.*\b(llm|corpus_pipeline)\b", p.read_text()), p
