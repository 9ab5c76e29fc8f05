import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_points_without_the_training_data_operators(tmp_path):
    for name in ("rainframe", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "rainframe/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "rainframe")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"\bllm\b|corpus_pipeline", open(os.path.join(folder, n)).read()), n
