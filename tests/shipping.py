"""Runs calls in fresh sessions, in a process that has the package on its own path only, outside its folder."""

import subprocess
import sys
from pathlib import Path

HEAD = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def fresh():
    return SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.host", "127.0.0.1").getOrCreate()
"""


def run(calls: list[str], imports: str, folder: Path) -> None:
    """Each call is an expression of a frame with ``spark`` at hand; all must be able to run as the first of a session."""
    lines = [HEAD.format(root=str(Path(__file__).parents[1])), imports]
    for call in calls:
        lines += ["spark = fresh()", f"({call}).collect()", "spark.stop()", f"print('ran', {call!r})"]
    done = subprocess.run([sys.executable, "-c", "\n".join(lines)], cwd=folder, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-500:] + done.stderr[-3000:]
    assert done.stdout.count("ran ") == len(calls)
