import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 18
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "datagrove"):
        path = os.path.join(REPO, name)
        (shutil.copytree if os.path.isdir(path) else shutil.copy)(path, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(path) else {}))
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, some = said.stdout.split()
    assert int(n) > 100 and some == "False"
