"""Streaming behaviour beyond the batch twins: state across micro-batches and
the late-data policy (hits behind the delay go to the late sink in T1)."""

import datetime as dt

from pyspark.sql import functions as F

from carelake.streaming.rate_limit import final_counts, late_hits_stream, rate_limit_batch, rate_limit_stream
from carelake.streaming.records import latest_details_stream

SCHEMA = "event_id long, scope string, ip string, ts timestamp"


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def _run(spark, src, out, ckpt):
    log = spark.readStream.schema(SCHEMA).parquet(src)
    q = (rate_limit_stream(log, window_seconds=300, limit=2).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ckpt).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def test_rate_limit_state_and_late_hits(spark, tmp_dir):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    src, out, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    _write(spark, [(1, "login", "1.1.1.1", t0), (2, "login", "1.1.1.1", t0 + dt.timedelta(seconds=60))], src)
    _run(spark, src, out, ckpt)
    # next batch: one hit inside the window (counts the two earlier hits from state),
    # then, after time moved on, a hit 1 hour late (behind the 10-minute watermark)
    _write(spark, [(3, "login", "1.1.1.1", t0 + dt.timedelta(seconds=120)),
                   (4, "login", "1.1.1.1", t0 + dt.timedelta(hours=2))], src)
    _run(spark, src, out, ckpt)
    _write(spark, [(5, "login", "1.1.1.1", t0 + dt.timedelta(seconds=150))], src)
    _run(spark, src, out, ckpt)
    got = {r.event_id: (r.hits, r.breach) for r in final_counts(spark.read.parquet(out)).collect()}
    assert got[1] == (1, False) and got[2] == (2, False)
    assert got[3] == (3, True)  # the state carried hits 1 and 2 across micro-batches
    assert got[4] == (1, False)
    assert 5 not in got  # more than the delay behind: in the late sink only
    log = spark.readStream.schema(SCHEMA).parquet(src)
    late = (late_hits_stream(log, 300, 2).writeStream.format("memory").queryName("late_hits").outputMode("append")
            .trigger(availableNow=True).start())
    late.awaitTermination()
    assert spark.table("late_hits").columns == ["event_id", "scope", "ip", "ts"]


def test_rate_limit_out_of_order_and_ties_equal_the_batch(spark, tmp_dir):
    import random

    rng, t0 = random.Random(1), dt.datetime(2024, 1, 1, 12)
    rows, n = [], 0
    for batch in range(5):  # each up to 400 s behind the one before, with many ties
        part = []
        for _ in range(60):
            at = t0 + dt.timedelta(seconds=batch * 200 - rng.choice([0, 10, 100, 400]) + rng.randrange(0, 60, 10))
            part.append((n, "login", rng.choice(["1.1.1.1", "2.2.2.2"]), at))
            n += 1
        rows.append(part)
        _write(spark, part, f"{tmp_dir}/src")
        _run(spark, f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    whole = spark.createDataFrame([r for part in rows for r in part], SCHEMA)
    want = {r.event_id: (r.hits, r.breach) for r in rate_limit_batch(whole, 300, 2).collect()}
    got = {r.event_id: (r.hits, r.breach) for r in final_counts(spark.read.parquet(f"{tmp_dir}/out")).collect()}
    assert got == want


def test_latest_details_stream_update(spark, tmp_dir):
    src = f"{tmp_dir}/subs"
    rows = [(1, "a@x.com", dt.datetime(2024, 1, 1), '{"age": 1}'), (2, "a@x.com", dt.datetime(2024, 1, 2), '{"age": 2}'),
            (3, "b@x.com", dt.datetime(2024, 1, 1), '{"age": 3}')]
    schema = "id long, email string, submitted_at timestamp, payload_json string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    s = latest_details_stream(spark.readStream.schema(schema).parquet(src))
    q = s.writeStream.format("memory").queryName("latest_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.email: r.id for r in spark.table("latest_test").collect()}
    assert got == {"a@x.com": 2, "b@x.com": 3}


def test_audit_stream_routes_late_submissions(spark, tmp_dir):
    from carelake.streaming.records import audit_events_stream, late_submissions_stream

    schema = "id long, email string, submitted_at timestamp, payload_json string"
    src = f"{tmp_dir}/feed"

    def write(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)

    def run(builder, out, ckpt):
        q = (builder(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()

    d1, d2, d3 = (dt.datetime(2024, 1, d) for d in (1, 5, 3))
    write([(1, "a@x.com", d1, '{"age": 30}'), (2, "a@x.com", d2, '{"age": 31}')])
    for b, name in ((audit_events_stream, "ev"), (late_submissions_stream, "late")):
        run(b, f"{tmp_dir}/{name}", f"{tmp_dir}/{name}_ck")
    write([(3, "a@x.com", d3, '{"age": 32}')])  # older than the stored version (day 5)
    for b, name in ((audit_events_stream, "ev"), (late_submissions_stream, "late")):
        run(b, f"{tmp_dir}/{name}", f"{tmp_dir}/{name}_ck")
    ev = {r.event_id: r.prev_id for r in spark.read.parquet(f"{tmp_dir}/ev").collect()}
    late = [r.id for r in spark.read.parquet(f"{tmp_dir}/late").collect()]
    assert ev == {1: None, 2: 1} and late == [3]
