import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'stats_languages' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_llm_subpackage():
    others = [p for p in (REPO / "changeloom").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if "changeloom.llm" in p.read_text()]
