"""T3 by buckets of patients: one call of the stateful step pairs many patients, as each alone would be paired."""

import datetime as dt
import random

import pandas as pd

from carelake.streaming import records as SR


class State:
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def _wanted(batches):
    """The rule itself, patient by patient: (id, prev_id, prev_json) of the pairs, ids of the late ones."""
    last, pairs, late = {}, set(), set()
    for batch in batches:
        stored = dict(last)
        for at, i, email, text in sorted((r[2], r[0], r[1], r[3]) for r in batch):
            if email in stored and at < stored[email][0]:
                late.add(i)
                continue
            _, prev, doc = last.get(email, (None, None, None))
            pairs.add((i, prev, doc))
            last[email] = (at, i, text)
    return pairs, late


def test_one_call_pairs_every_patient_of_its_bucket():
    rng, t0, batches, n = random.Random(5), dt.datetime(2024, 1, 1), [], 2 ** 60
    for k in range(4):
        batch = []
        for _ in range(300):
            n += 1
            at = t0 + dt.timedelta(seconds=100 * k - rng.choice([0, 0, 50, 150]) + rng.randrange(0, 60, 10))
            batch.append((n, f"c{rng.randrange(40 + 10 * k)}@x.com", at, rng.choice([None, f"text {n}"])))
        batches.append(batch)
    state, pairs, late = State(), set(), set()
    for batch in batches:
        rng.shuffle(batch)
        frame = pd.DataFrame(batch, columns=["id", "email", "submitted_at", "payload_json"])
        for out in SR._pair_fn((7,), iter([frame.iloc[:120], frame.iloc[120:120], frame.iloc[120:]]), state):
            for r in out.itertuples():
                text = None if pd.isna(r.prev_json) else r.prev_json
                if r.late:
                    late.add(r.id)
                else:
                    pairs.add((r.id, None if pd.isna(r.prev_id) else r.prev_id, text))
    assert (pairs, late) == _wanted(batches) and late


def test_state_rows_do_not_grow_with_patients(spark, tmp_dir):
    schema, t0 = "id long, email string, submitted_at timestamp, payload_json string", dt.datetime(2024, 1, 1)
    rows = [(i, f"c{i % 600}@x.com", t0 + dt.timedelta(hours=i), '{"age": %d}' % i) for i in range(1200)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/feed")
    pairs = SR.consecutive_pairs_stream(spark.readStream.schema(schema).parquet(f"{tmp_dir}/feed"))
    q = (pairs.writeStream.format("parquet").option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= SR.PATIENT_BUCKETS
    got = {(r.id, r.prev_id, r.prev_json) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {(i, i - 600 if i >= 600 else None, '{"age": %d}' % (i - 600) if i >= 600 else None) for i in range(1200)}
