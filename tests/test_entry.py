"""The entry points with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"


def test_without_llm(tmp_path):
    at = tmp_path / "copy"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for pipeline in (True, False):  # with corpus_pipeline.py left behind, and without
        if not pipeline:
            (at / "corpus_pipeline.py").unlink()
        ran = subprocess.run([sys.executable, "-c", LIST], cwd=at, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})
        assert ran.returncode == 0, ran.stderr
        names = ran.stdout.split()
        assert "decode_hamming" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
