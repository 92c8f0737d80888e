from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from yieldgate.sources import lots as src


def test_frames_in_memory_are_relations(spark):
    frame = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=4), "fail": [0, 1, 0, 1], "f000": [1.0, None, 3.0, float("nan")]})
    src.relation(spark, frame, "mem_lots")
    got = spark.sql("SELECT count(*) n, count(f000) k, sum(fail) f, avg(f000) m FROM mem_lots").first()
    assert tuple(got) == (4, 2, 2, 2.0)
    src.relation(spark, spark.table("mem_lots").where("fail = 1"), "mem_lots")  # another frame takes the name
    assert spark.sql("SELECT count(*) FROM mem_lots").first()[0] == 2


def test_environment_and_lock(spark, tmp_path):
    path = str(tmp_path / "made")
    src.write_environment(spark, path)
    assert src.read_json(spark, f"{path}/environment").first()["pyspark"] == spark.version
    pins = [r[0] for r in spark.read.text(f"{path}/lock").collect()]
    assert any(p.startswith("pyspark==") for p in pins) and len(pins) == len(src.lock())
    assert src.lock_changes(spark, path).count() == 0
    old = [p if not p.startswith("pyspark==") else "pyspark==3.0.0" for p in pins if not p.lower().startswith("numpy==")] + ["gone==1.0"]
    spark.createDataFrame([(p,) for p in old], "value string").write.mode("overwrite").text(f"{path}/lock")
    found = {r["package"]: (r["locked"], r["now"]) for r in src.lock_changes(spark, path).orderBy(F.col("package")).collect()}
    assert found["pyspark"] == ("3.0.0", spark.version) and found["gone"] == ("1.0", None) and found["numpy"][0] is None and len(found) == 3
