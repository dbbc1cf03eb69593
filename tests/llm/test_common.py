import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

#: A cluster of one executor, whose heap grows by 200 MB of strings and their copies; its Python worker reads how much memory the process above its daemon has.
RUN = """
import json, re, sys
from pathlib import Path
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from quire.llm.common import discard, ready, written

spark = SparkSession.builder.config(map=json.loads(sys.argv[1])).getOrCreate()
ready(spark)

def held(batches):
    import os
    for _ in batches:
        daemon = Path(f"/proc/{os.getppid()}/stat").read_text().rpartition(")")[2].split()[1]
        mb = int(re.search(r"RssAnon:\\s+(\\d+)", Path(f"/proc/{daemon}/status").read_text())[1]) // 1024
        yield pa.RecordBatch.from_arrays([pa.array([mb])], ["mb"])

read = lambda: spark.range(0, 1, 1, 1).mapInArrow(held, "mb long").first()[0]
many = written(spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 100_000 + F.col("id").cast("int")).alias("s")).agg(F.size(F.collect_list("s")).alias("n")), "many")
before = read()
discard(many)
print("MB", before, read())
"""


def test_executors_give_memory_back(tmp_path):
    home, top = tmp_path / "home", Path(pyspark.__file__).parent
    (home / "work").mkdir(parents=True)
    for p in top.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    conf = {"spark.master": "local-cluster[1,1,2000]", "spark.executor.memory": "2000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp_path}/shared", "spark.sql.warehouse.dir": f"{tmp_path}/warehouse"}
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_LOCAL_IP": "127.0.0.1"}
    said = subprocess.run([sys.executable, "-c", RUN, json.dumps(conf)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "MB" in said.stdout, said.stderr[-2000:]
    before, after = map(int, said.stdout.rpartition("MB")[2].split())
    assert before > 600 and after < before - 200, (before, after)
