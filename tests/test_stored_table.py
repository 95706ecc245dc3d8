"""Bucketed tables that change in place, and the latest-details stream on top of one."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from carelake.operators.stored_table import BucketedTable
from carelake.streaming import records as SR

SCHEMA = "id bigint, v string"


def _files(path):
    return {os.path.basename(f): f for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def _rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_change_touches_its_buckets_only(spark, tmp_dir):
    table = BucketedTable(spark, f"{tmp_dir}/t", "id", SCHEMA, buckets=8)
    assert _rows(table) == []
    table.create(spark.createDataFrame([(i, "a") for i in range(100)], SCHEMA))
    before = _files(table.path)
    ids = spark.createDataFrame([(3, "b"), (200, "new")], SCHEMA)
    change = lambda now, new: now.join(new, "id", "left_anti").unionByName(new)
    for _ in range(2):  # applying it again changes nothing
        table.apply(ids, change)
        assert _rows(table) == sorted([(i, "b" if i == 3 else "a") for i in range(100)] + [(200, "new")])
    hit = {r[0] for r in ids.select(table.bucket()).collect()}
    after = _files(table.path)
    for name, path in before.items():
        bucket = int(os.path.basename(os.path.dirname(path)).split("=")[1])
        assert (name in after) == (bucket not in hit)
    table.apply(ids.limit(0), change)
    assert _files(table.path) == after


def test_delete_empties_buckets(spark, tmp_dir):
    table = BucketedTable(spark, f"{tmp_dir}/t", "id", SCHEMA, buckets=4).create(
        spark.createDataFrame([(i, "a") for i in range(20)], SCHEMA))
    table.delete(spark.range(5, 500).select(F.col("id")))
    assert _rows(table) == [(i, "a") for i in range(5)]
    table.delete(spark.range(500).select(F.col("id")))
    assert _rows(table) == [] and not _files(table.path)


def test_latest_details_and_late_sink(spark, tmp_dir):
    schema = "email string, id bigint, submitted_at timestamp, payload_json string"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("A@x.y", 1, at(5), "one"), ("b@x.y", 2, at(5), "two"), (" ", 3, at(9), "none"), (None, 9, at(9), "none")],
               [("a@x.y", 4, at(3), "late"), ("b@x.y", 5, at(7), "newer"), ("b@x.y", 6, at(7), "tie"), ("b@x.y", 7, at(6), "over")]]
    table = BucketedTable(spark, f"{tmp_dir}/t", "email", SR.LATEST_SCHEMA, 4)
    late = f"{tmp_dir}/late"
    for epoch in (0, 1, 1):  # a retried epoch
        SR.merge_latest(table, late, spark.createDataFrame(batches[epoch], schema), epoch)
    got = {r.email: (r.id, r.payload_json, r.epoch) for r in table.read().collect()}
    assert got == {"a@x.y": (1, "one", 0), "b@x.y": (6, "tie", 1)}
    lost = [(r.id, r.payload_json) for r in spark.read.parquet(f"{late}/epoch=0", f"{late}/epoch=1").collect()]
    assert lost == [(4, "late")]
