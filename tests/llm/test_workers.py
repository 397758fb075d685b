"""Jobs run where the package isn't installed on the workers: a driver elsewhere, with the package on its own path only."""

import os
import subprocess
import sys

import weftline

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from weftline.llm.plans import QUERIES
from weftline.session import build_session
spark = build_session("local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": {folder!r}}})
for name in ("p6_found", "p7_validity", "p8_found", "p8_templates"):
    print("ROWS", name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_without_package_on_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(weftline.__file__))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK", "SPARK"))}
    env |= {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not os.path.isdir(os.path.join(p, "weftline")))}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, folder=str(tmp_path / "ck"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert run.stdout.count("ROWS") == 4, run.stderr[-2000:]
