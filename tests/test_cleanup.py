"""Tables that retrieval wrote are gone after the session has been stopped and the driver has ended."""

import os
import subprocess
import sys
import time

CODE = """
from pyspark.sql import SparkSession
import pathlib
import sys
spark = SparkSession.builder.master("local[2]").config(map={"spark.checkpoint.dir": sys.argv[1], "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}).getOrCreate()
from irspan.operators import physical
made = physical.written(spark.range(10), "numbers")
assert made.count() == 10
assert list(pathlib.Path(sys.argv[1]).glob("irspan-*/numbers-*"))
spark.stop()
"""


def test_nothing_is_left_after_stop(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    subprocess.run([sys.executable, "-c", CODE, str(shared)], check=True, timeout=600, env=os.environ)
    until = time.time() + 30  # the JVM ends a little later
    while list(shared.glob("irspan-*")) and time.time() < until:
        time.sleep(0.5)
    assert list(shared.glob("irspan-*")) == []  # Spark's own checkpoint folder, which is empty, is Spark's
