"""The entry point works with and without the subpackage llm."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def names(at):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=at, check=True, capture_output=True, text=True).stdout.split()


def test_entry_without_llm(tmp_path):
    shutil.copytree(REPO / "skribo", tmp_path / "skribo", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    left = names(tmp_path)
    assert len(left) > 100 and set(left) == {n for n in names(REPO) if n != "pipeline" and not n.startswith("op")}


def test_entry_with_a_module_of_llm_that_cannot_be_imported(tmp_path):
    shutil.copytree(REPO / "skribo", tmp_path / "skribo", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / f).exists():
            shutil.copy(REPO / f, tmp_path)
    if not (tmp_path / "skribo" / "llm").exists():
        return
    (tmp_path / "skribo" / "llm" / "common.py").write_text("import nowhere_to_be_found\n")
    assert len(names(tmp_path)) > 100 and "pipeline" not in names(tmp_path)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
