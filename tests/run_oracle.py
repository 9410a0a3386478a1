"""python tests/run_oracle.py SF [NAME...]: compare the registered queries with their SQL twins."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]
from compare import differences
from pyspark.sql import SparkSession

import __spark_entry__ as entry

spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sf = f"/root/testdata/{sys.argv[1]}"
queries, oracles = entry.queries(), entry.oracle_sql()
bad = 0
for name in sys.argv[2:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
    began = time.time()
    try:
        if name in oracles:
            said = differences(spark, name, queries[name], oracles[name], sf)
        else:
            said = "" if queries[name](spark, sf).count() >= 0 else "no rows"
    except Exception:
        said = f"{name}: " + traceback.format_exc(limit=-2)[-700:]
    bad += bool(said)
    print(said or f"{name} ok {time.time() - began:.1f}", flush=True)
print("failures:", bad)
