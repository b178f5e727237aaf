"""The rest of the library without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 100 and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(e.oracle_sql()) <= names
"""


def test_queries_without_the_training_folders(tmp_path):
    """In a copy without the subpackage, its tests and the pipeline, all other queries are still registered."""
    for name in ("tablemill", "workload", "tests"):
        shutil.copytree(f"{HERE}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "check_queries.py"):
        shutil.copy(f"{HERE}/{name}", tmp_path)
    subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, check=True, timeout=120)
    shutil.copy(f"{HERE}/corpus_pipeline.py", tmp_path)  # the folders gone, the pipeline left behind
    subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, check=True, timeout=120)
