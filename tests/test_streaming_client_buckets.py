"""T1 by buckets of clients: one call of the stateful step serves many clients, as each alone would be served."""

import datetime as dt
import random

import pandas as pd

from carelake.streaming import rate_limit as RL


class State:
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def _wanted(batches, window, delay, limit):
    """The rule itself, hit by hit."""
    seen, late = {}, set()
    for batch in batches:
        marks = {c: max(t for t, _ in hits) - delay for c, hits in seen.items()}
        for i, scope, ip, t in batch:
            if t < marks.get((scope, ip), t):
                late.add(i)
            else:
                seen.setdefault((scope, ip), []).append((t, i))
    counts = {i: sum(t - window <= x <= t for x, _ in hits) for hits in seen.values() for t, i in hits}
    return {i: (n, n > limit) for i, n in counts.items()}, late


def test_one_call_counts_every_client_of_its_bucket():
    rng, batches, at = random.Random(3), [], 0
    for k in range(4):
        batch = []
        for _ in range(400):
            client = (rng.choice(["login", "view", None]), rng.choice(["1.1.1.1", "2.2.2.2", "3.3.3.3", None]))
            batch.append((at, *client, k * 900 + rng.randrange(-700, 900, 7) + 1_000_000))
            at += 1
        batches.append(batch)
    state, counts, late = State(), {}, set()
    fn = RL._rate_limit_fn(300, 5, 600)
    for batch in batches:
        pdf = pd.DataFrame(batch, columns=["event_id", "scope", "ip", "ts"])
        pdf["ts"] = pd.to_datetime(pdf["ts"], unit="s")
        for out in fn((7,), iter([pdf.iloc[:150], pdf.iloc[150:]]), state):
            for r in out.itertuples():
                if r.late:
                    late.add(r.event_id)
                else:
                    counts[r.event_id] = max(counts.get(r.event_id, (0, False)), (r.hits, bool(r.breach)))
                    source = batches[r.event_id // 400][r.event_id % 400]
                    assert (r.scope, r.ip) == source[1:3]
    assert (counts, late) == _wanted(batches, 300, 600, 5) and late
    assert len(state.get[0]) == 12


def test_calls_do_not_grow_with_clients(spark, tmp_dir):
    rows = [(n, "login", f"10.0.{n % 300}.1", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)) for n in range(900)]
    spark.createDataFrame(rows, "event_id long, scope string, ip string, ts timestamp").write.parquet(f"{tmp_dir}/src")
    log = spark.readStream.schema("event_id long, scope string, ip string, ts timestamp").parquet(f"{tmp_dir}/src")
    before, RL.CLIENT_BUCKETS = RL.CLIENT_BUCKETS, 2
    try:
        q = RL.rate_limit_stream(log, 300, 2).writeStream.format("memory").queryName("bucketed").trigger(
            availableNow=True).start()
        q.awaitTermination()
    finally:
        RL.CLIENT_BUCKETS = before
    assert spark.table("bucketed").count() == 900
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
