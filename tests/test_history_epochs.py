"""Epochs of many tenures: both plans against a search in the sorted starts."""

from bisect import bisect_right

from pyspark.sql import functions as F

from tuplewright.operators import history


def test_epochs_alike_with_few_and_many_tenures(spark, monkeypatch):
    starts = [7 * k + 3 for k in range(200)]
    tenures = spark.createDataFrame([(k + 1, at) for k, at in enumerate(starts)], "epoch int, first_lsn long")
    rows = spark.range(1500).select(F.col("id").alias("lsn"))
    want = {n: bisect_right(starts, n) or None for n in range(1500)}
    for most in (history.MOST_TENURES, 1000):
        monkeypatch.setattr(history, "MOST_TENURES", most)
        got = history.with_epoch(rows, tenures)
        assert got.columns == ["lsn", "epoch"] and {r["lsn"]: r["epoch"] for r in got.collect()} == want
