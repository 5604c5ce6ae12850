"""The streaming profile against the batch one."""

import pytest

from skein.operators import profile as P
from skein.streaming import profile as Z


def test_profile_follows_arrivals(spark, tmp_path):
    rows = spark.range(30).selectExpr("id", "id % 3 AS k", "CASE WHEN id % 2 = 0 THEN 'x' END AS v")
    rows.where("id < 10").write.mode("append").parquet(str(tmp_path / "in"))
    stream = Z.arriving(spark, str(tmp_path / "in"), rows.schema)
    query = Z.keep_profile(stream, "t", str(tmp_path / "out"), str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        rows.where("id >= 10").write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    found = {r.column_name: r.entropy for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.column_name: r.entropy for r in P.column_entropy(rows, "t").collect()}
    assert found == pytest.approx(want)
