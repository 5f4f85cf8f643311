"""The registry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), 'flow_topk' in e.queries(), 'flow_topk' in e.oracle_sql())"


def listed(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_queries_without_the_corpus_operators(tmp_path):
    shutil.copytree(HERE, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert listed(tmp_path / "copy") == ["0", "False", "True", "True"]
    os.remove(tmp_path / "copy/corpus_pipeline.py")
    assert listed(tmp_path / "copy") == ["0", "False", "True", "True"]
