"""The skew-safe helpers equal the plain per-key windows they replace, on a
table where one key holds a third of all rows (and ties in the order key)."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from carelake.operators.ordinals import last_non_null_in_key, ordinal_among, previous_in_key
from carelake.streaming.rate_limit import rate_limit_batch


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(50)}"
        ts = t0 + dt.timedelta(seconds=rnd.randrange(0, 5 * 86400))
        val = rnd.choice([None, float(rnd.randrange(100))])
        rows.append((i, key, ts, val))
    return spark.createDataFrame(rows, "id long, k string, ts timestamp, v double")


def test_ordinal_among_equals_row_number(spark):
    df = _skewed(spark).withColumn("sec", F.unix_seconds("ts"))
    got = ordinal_among(df, "sec", F.col("v").isNotNull(), "o", partition_cols=["k"], block=3600, tiebreak=["id"])
    w = Window.partitionBy("k").orderBy("sec", "id")
    ref = df.filter(F.col("v").isNotNull()).withColumn("o", F.row_number().over(w))
    a = {r.id: r.o for r in got.filter(F.col("o").isNotNull()).collect()}
    b = {r.id: r.o for r in ref.collect()}
    assert a == b and got.filter(F.col("v").isNull() & F.col("o").isNotNull()).count() == 0


def test_previous_in_key_equals_lag(spark):
    df = _skewed(spark)
    got = previous_in_key(df, "k", "ts", "id", ["id", "v"], block_seconds=3600)
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = df.withColumn("prev_id", F.lag("id").over(w))
    assert {r.id: r.prev_id for r in got.collect()} == {r.id: r.prev_id for r in ref.collect()}


def test_last_non_null_equals_window(spark):
    df = _skewed(spark)
    got = last_non_null_in_key(df, "k", "ts", "id", {"lv": F.col("v")}, block_seconds=3600)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("lv", F.last("v", ignorenulls=True).over(w))
    assert {r.id: r.lv for r in got.collect()} == {r.id: r.lv for r in ref.collect()}


def test_rate_limit_blocks_equal_range_window(spark):
    df = _skewed(spark).select("id", F.col("k").alias("scope"), F.lit("ip").alias("ip"), "ts")
    got = rate_limit_batch(df.withColumnRenamed("id", "event_id"), window_seconds=600, limit=3)
    w = Window.partitionBy("scope", "ip").orderBy(F.unix_micros("ts")).rangeBetween(-600 * 1_000_000, 0)
    ref = df.withColumn("hits", F.count(F.lit(1)).over(w))
    assert {r.event_id: r.hits for r in got.collect()} == {r.id: r.hits for r in ref.collect()}
