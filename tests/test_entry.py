import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest stands alone: with or without the pipeline's file."""
    shutil.copytree(ROOT / "propflow", tmp_path / "propflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    check = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql(); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, check=True)
