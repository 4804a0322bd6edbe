"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAID = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), *sorted(q))"


def _names(folder):
    done = subprocess.run([sys.executable, "-c", SAID], cwd=folder, capture_output=True, text=True, check=True,
                          env={**os.environ, "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"})
    queries, checks, *names = done.stdout.split()
    return int(queries), int(checks), names


@pytest.mark.parametrize("left_out", [["songloom/llm"], ["corpus_pipeline.py"], ["songloom/llm", "corpus_pipeline.py"]])
def test_without_the_optional_modules(tmp_path, left_out):
    for name in ("songloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.isdir(f"{ROOT}/{name}"):
            shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns(
                "__pycache__", *["llm"] * ("songloom/llm" in left_out)))
        elif name not in left_out and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    queries, checks, names = _names(tmp_path)
    assert queries == len(names) > 80 and checks > 80 and "pipeline" not in names
    if "songloom/llm" in left_out:
        assert queries == checks and not [n for n in names if n.startswith("op")]
