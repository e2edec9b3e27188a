"""Operators with Python workers on two executors that share one folder with the driver, started from elsewhere."""

import os
import subprocess
import sys
import textwrap

from cases import awkward

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import json, sys
texts = json.load(open("texts.json"))
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
sys.path.insert(0, sys.argv[1])  # the driver alone finds the package; workers have to be sent it
from edgeloom.llm import queries as Q
spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in texts], "doc_id long, text string, source string").repartition(4).write.parquet("data/documents.parquet")
found = {}
for name in ("op1_substring_dedup", "op4_token_files", "op5_packing", "op9_simhash"):
    df = Q.queries()[name](spark, "data")
    own = "component_id" if "component_id" in df.columns else "n_tokens" if "n_tokens" in df.columns else "length" if "length" in df.columns else "n_removed"
    found[name] = [df.count(), df.agg({own: "sum"}).first()[0]]
print("FOUND " + json.dumps(found))
spark.stop()
"""


def test_two_executors(spark, tmp_path):
    import json

    from cases import frame

    from edgeloom.llm import queries as Q

    texts = [(i, t) for i, t in awkward()]
    (tmp_path / "texts.json").write_text(json.dumps(texts))
    (tmp_path / "run.py").write_text(textwrap.dedent(SCRIPT))
    import pyspark

    # executors write their logs below Spark's home: one of links, so that the installation stays as it is
    home = tmp_path / "home"
    home.mkdir()
    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(f"{os.path.dirname(pyspark.__file__)}/{name}")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(home), "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != REPO)}
    ran = subprocess.run([sys.executable, "run.py", REPO, f"file://{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    line = next((x for x in ran.stdout.splitlines() if x.startswith("FOUND ")), None)
    assert line, ran.stderr[-3000:]
    found = json.loads(line[6:])
    frame(spark, texts).selectExpr("doc_id", "text", "'s' || cast(pmod(doc_id, 2) as string) as source").write.parquet(f"{tmp_path}/here/documents.parquet")
    for name, (rows, total) in found.items():
        df = Q.queries()[name](spark, f"{tmp_path}/here")
        own = next(c for c in ("component_id", "n_tokens", "length", "n_removed") if c in df.columns)
        assert (df.agg({own: "sum"}).first()[0]) == total and (name == "op5_packing" or df.count() == rows), name
    # nothing of it is left where executors don't share
    assert os.path.isdir(tmp_path / "shared")
