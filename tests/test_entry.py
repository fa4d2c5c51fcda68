"""The entry point without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_survives_removal_of_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "hireloom", tmp_path / "hireloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "hireloom" / "llm" / "__pycache__").mkdir(parents=True)  # what a removal may leave
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'dedup_url' in q and set(s) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
