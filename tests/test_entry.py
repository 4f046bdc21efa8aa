import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_contract():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and all(isinstance(s, str) and s.strip() for s in oracle.values())
    assert len(queries) >= 90


def test_the_subpackage_is_optional(tmp_path):
    """Without the corpus operators the rest imports, and nothing else in the library needs them."""
    here = Path(entry.__file__).parent
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "colloquy", tmp_path / "colloquy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, capture_output=True, text=True).stdout.split()
    assert len(names) >= 90 and "pipeline" not in names and not any(re.match(r"op\d+_", n) for n in names)


def test_other_import_errors_surface(tmp_path):
    """A part of the subpackage that can't be imported doesn't drop its queries without a word."""
    here = Path(entry.__file__).parent
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "colloquy", tmp_path / "colloquy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, timeout=120, capture_output=True, text=True)
    assert run.returncode and "a_module_that_is_not_there" in run.stderr
