import ast
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]

#: Each task gets a new Python worker, as on executors just started, where nothing was imported by earlier tasks.
SCRIPT = """
from pyspark.sql import SparkSession
from sparkrag.llm import jaccard
from tests.llm.conftest import invented

spark = (SparkSession.builder.master("local[2]").config("spark.python.worker.reuse", "false").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
first = [invented(i, 80) for i in range(4)]
near = [" ".join("changed" if j == 40 else w for j, w in enumerate(t.split())) for t in first]
docs = spark.createDataFrame(list(enumerate(first + near)), "doc_id long, text string").repartition(2)
print("GOT", sorted(r["doc_id"] for r in jaccard.deduplicate(docs).collect()))
"""


def test_new_workers_import_what_near_duplicates_need():
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=600)
    assert "GOT [0, 1, 2, 3]" in run.stdout, run.stderr[-3000:]


def test_parts_of_pyarrow_that_it_does_not_load_itself_are_imported_where_used():
    """pa.compute is there only if something else in the worker has imported it."""
    loaded = subprocess.run([sys.executable, "-c", "import pyarrow; print(*dir(pyarrow))"], capture_output=True, text=True, check=True).stdout.split()
    missing = []
    for path in sorted((ROOT / "sparkrag").rglob("*.py")):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "pa" and node.attr not in loaded:
                missing.append((path.name, node.lineno, node.attr))
    assert not missing
