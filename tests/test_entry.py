"""The entry without the training-data subpackage, and with a broken one."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q))"


def copied(to: Path) -> Path:
    shutil.copytree(ROOT / "strataledger", to / "strataledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def listed(where: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", LIST], cwd=where, capture_output=True, text=True, env={"PYTHONPATH": str(where), "PATH": "/usr/bin:/bin"}, check=False)


def test_the_entry_lists_the_rest_without_the_subpackage(tmp_path):
    from strataledger import queries

    done = listed(copied(tmp_path))
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(queries.queries())), "False"]


def test_an_import_that_fails_inside_the_subpackage_is_an_error(tmp_path):
    broken = copied(tmp_path) / "strataledger" / "llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("")
    (broken / "queries.py").write_text("import no_such_module\n")
    done = listed(tmp_path)
    assert done.returncode != 0 and "no_such_module" in done.stderr
