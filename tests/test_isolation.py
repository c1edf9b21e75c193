"""The engine without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), [n for n in q if n == 'pipeline' or n[:2] == 'op'])"


def names(folder):
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split(" ", 1)


def test_entry_without_the_subpackage(tmp_path):
    for with_pipeline in (True, False):
        folder = tmp_path / str(with_pipeline)
        folder.mkdir()
        shutil.copy(f"{ROOT}/__spark_entry__.py", folder)
        shutil.copytree(f"{ROOT}/litforge", folder / "litforge", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
        if with_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", folder)
        n, optional = names(folder)
        assert int(n) > 80 and optional.strip() == "[]"
