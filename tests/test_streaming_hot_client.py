"""One client with more hits in a micro-batch than an Arrow batch holds, in no order of time."""

import datetime as dt
import random

from carelake.streaming.rate_limit import final_counts, late_hits_stream, rate_limit_batch, rate_limit_stream

SCHEMA = "event_id long, scope string, ip string, ts timestamp"


def _run(stream, out, ckpt):
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def test_shuffled_hits_of_one_micro_batch_are_never_late(spark, tmp_dir):
    rng, t0 = random.Random(8), dt.datetime(2024, 1, 1, 12)
    parts = [[(k * 1500 + n, "login", "1.1.1.1", t0 + dt.timedelta(seconds=k * 7200 + rng.randrange(7200)))
              for n in range(1500)] for k in range(2)]
    late_one = (9999, "login", "1.1.1.1", t0 + dt.timedelta(seconds=30))  # far behind the first micro-batch
    src = f"{tmp_dir}/src"
    for k, part in enumerate([parts[0], [*parts[1], late_one]]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        log = spark.readStream.schema(SCHEMA).parquet(src)
        _run(rate_limit_stream(log, 300, 2), f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
        _run(late_hits_stream(log, 300, 2), f"{tmp_dir}/late", f"{tmp_dir}/late-ckpt")
    whole = spark.createDataFrame(parts[0] + parts[1], SCHEMA)
    want = {r.event_id: (r.hits, r.breach) for r in rate_limit_batch(whole, 300, 2).collect()}
    want.pop(9999, None)
    got = {r.event_id: (r.hits, r.breach) for r in final_counts(spark.read.parquet(f"{tmp_dir}/out")).collect()}
    assert got == want and len(got) == 3000
    assert [r.event_id for r in spark.read.parquet(f"{tmp_dir}/late").collect()] == [9999]
