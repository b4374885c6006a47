import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]


def test_registry_without_the_training_data_subpackage(tmp_path):
    """The other queries are registered in a copy without ``llm``, whether the pipeline's file is there or not."""
    copy = tmp_path / "copy"
    shutil.copytree(REPO / "wirelens", copy / "wirelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, copy / name)
    told = "import __spark_entry__ as e; q = e.queries(); print(len(q), all(k[0] == 'd' for k in q), set(e.oracle_sql()) <= set(q))"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", told], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    first = run()
    assert int(first[0]) >= 23 and first[1:] == ["True", "True"]
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run() == first
