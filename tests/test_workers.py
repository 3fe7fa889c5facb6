"""Python workers must find the package wherever the driver was started."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from subscope.plans import registry
from subscope.session import session
spark = session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2")
for name in ("ab_conversion_test", "rec_similar", "silhouette", "dbscan_summary"):
    assert registry.queries()[name](spark, {folder!r}).count() > 0, name
print("all found")
"""


def test_queries_run_from_another_folder(tmp_path, small):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=root, folder=small)],
        cwd=tmp_path, capture_output=True, text=True, timeout=600,
    )
    assert "all found" in done.stdout, done.stderr[-2000:]
