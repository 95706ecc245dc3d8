"""Rate-limit breaches (hits per scope:client in a trailing window).

Batch twin: exact trailing-window counts without one window partition per
client.  Events are cut into time blocks of the window width per key; each
block also receives, as context rows, the previous block's events (those are
the only ones that can fall inside a trailing window of an event in this
block).  A RANGE-frame count inside (key, block) is then exact for the
block's own rows, and a hot client is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limit_batch(log: DataFrame, window_seconds: int = 300, limit: int = 20,
                     key_cols: tuple[str, ...] = ("scope", "ip"), ts_col: str = "ts") -> DataFrame:
    """Per hit: hits in [ts - window, ts] for the same key (inclusive, refused hits count);
    ``breach`` when above ``limit``.  Ties at the same instant count each other."""
    keys = list(key_cols)
    t = log.withColumn("__sec", F.unix_micros(F.col(ts_col)))
    w_us = window_seconds * 1_000_000
    t = t.withColumn("__blk", F.floor(F.col("__sec") / w_us))
    own = t.withColumn("__own", F.lit(True))
    ctx = t.withColumn("__blk", F.col("__blk") + 1).withColumn("__own", F.lit(False))
    both = own.unionByName(ctx)
    w = (Window.partitionBy(*keys, "__blk").orderBy("__sec").rangeBetween(-w_us, 0))
    counted = both.withColumn("hits", F.count(F.lit(1)).over(w)).filter("__own")
    return counted.withColumn("breach", F.col("hits") > limit).drop("__sec", "__blk", "__own")


# ---------------------------------------------------------------- streaming

RATE_OUTPUT_SCHEMA = "event_id BIGINT, scope STRING, ip STRING, ts TIMESTAMP, hits BIGINT, breach BOOLEAN, late BOOLEAN"
RATE_STATE_SCHEMA = ("scopes ARRAY<STRING>, ips ARRAY<STRING>, clients ARRAY<BIGINT>, stamps ARRAY<BIGINT>, "
                     "ids ARRAY<BIGINT>")
OUT_ROWS = 8192  # rows of one output frame
CLIENT_BUCKETS = 1024  # groups of clients; as long as a checkpoint is used it stays as it is


def _rate_limit_fn(window_seconds: int, limit: int, delay_seconds: int):
    """The stateful step of one bucket of clients.  A call costs milliseconds however few hits it gets, so
    clients share calls; inside, all of them are counted by one sort."""
    import numpy as np
    import pandas as pd

    window, delay = window_seconds * 1_000_000, delay_seconds * 1_000_000
    lowest = np.iinfo("int64").min

    def texts(column):
        return column.astype(object).where(column.notna(), None)

    def newest(n, of, stamps):
        top = np.full(n, lowest)
        np.maximum.at(top, of, stamps)
        return top

    def fn(key, pdfs, state):
        scopes, ips, *kept = state.get if state.exists else ((),) * 5
        clients = {c: i for i, c in enumerate(zip(scopes, ips))}
        known = len(clients)
        of, stamps = (np.array(x, dtype="int64") for x in kept[:2])
        # one mark per client for the whole micro-batch; the last place stands for clients without hits before
        marks = np.append(newest(known, of, stamps) - delay, lowest)
        old, parts = len(of), [(of, stamps, pd.Series(kept[2], dtype="Int64"))]
        for pdf in pdfs:  # only clients' numbers, stamps and ids are kept of each Arrow batch
            if pdf.empty:
                continue
            us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            pairs = zip(texts(pdf["scope"]), texts(pdf["ip"]))
            who = np.fromiter((clients.setdefault(c, len(clients)) for c in pairs), "int64", len(us))
            late = us < marks[np.minimum(who, known)]
            if late.any():
                yield pdf[late].assign(hits=pd.array([None] * int(late.sum()), dtype="Int64"), breach=None, late=True)[
                    ["event_id", "scope", "ip", "ts", "hits", "breach", "late"]]
            parts.append((who[~late], us[~late], pdf["event_id"][~late].astype("Int64")))
        of, stamps = (np.concatenate([p[i] for p in parts]) for i in range(2))
        if len(of) == old:
            return  # the state stays as it was
        ids = pd.concat([p[2] for p in parts], ignore_index=True)
        # per client in order of time: where each hit's window begins, the hits, where each window ends
        n = len(of)
        kind = np.repeat([0, 1, 2], n)
        order = np.lexsort((kind, np.concatenate([stamps - window, stamps, stamps]), np.tile(of, 3)))

        def in_window(counted):
            at = np.empty(3 * n, dtype="int64")
            at[order] = np.cumsum((kind == 1)[order] & np.tile(counted, 3)[order])
            return at[2 * n:] - at[:n]

        hits = in_window(np.ones(n, dtype=bool))
        # counts that a new hit changes: hits from its own time to a window later
        changed = np.flatnonzero(in_window(np.arange(n) >= old) > 0)
        names = np.empty((len(clients), 2), dtype=object)
        names[:] = list(clients)
        for at in range(0, len(changed), OUT_ROWS):
            c = changed[at:at + OUT_ROWS]
            yield pd.DataFrame({"event_id": ids.iloc[c].array, "scope": names[of[c], 0], "ip": names[of[c], 1],
                                "ts": pd.to_datetime(stamps[c], unit="us"), "hits": hits[c],
                                "breach": hits[c] > limit, "late": False})
        keep = stamps >= newest(len(clients), of, stamps)[of] - window - delay
        own, of = np.unique(of[keep], return_inverse=True)
        state.update((names[own, 0].tolist(), names[own, 1].tolist(), of.tolist(), stamps[keep].tolist(),
                      [None if x is pd.NA else x for x in ids[keep].tolist()]))

    return fn


def _counted_hits(log: DataFrame, window_seconds: int, limit: int, delay_seconds: int) -> DataFrame:
    fn = _rate_limit_fn(window_seconds, limit, delay_seconds)
    bucket = F.pmod(F.xxhash64("scope", "ip"), F.lit(CLIENT_BUCKETS))
    return log.withColumn("__bucket", bucket).groupBy("__bucket").applyInPandasWithState(
        fn, RATE_OUTPUT_SCHEMA, RATE_STATE_SCHEMA, "append", "NoTimeout")


def rate_limit_stream(log: DataFrame, window_seconds: int = 300, limit: int = 20,
                      delay_seconds: int = 600) -> DataFrame:
    """T1 streaming: hits in [ts - window, ts] of the same client, ties included.

    Per (scope, ip) the state holds the hits of the last window plus delay; clients are kept in
    ``CLIENT_BUCKETS`` buckets, so calls and state rows do not grow with their number.  It is
    kept while the query runs: an event-time timeout would need a watermark, and
    Spark drops rows behind one before any late sink sees them.  A hit up to ``delay_seconds`` behind its
    client's newest one of the micro-batches before counts in full, and the later hits whose windows hold it
    are given again with their larger counts, so the last (largest) count of each
    event equals the batch twin's.  Older hits are in ``late_hits_stream``.
    """
    return _counted_hits(log, window_seconds, limit, delay_seconds).filter("NOT late").drop("late")


def late_hits_stream(log: DataFrame, window_seconds: int = 300, limit: int = 20, delay_seconds: int = 600) -> DataFrame:
    """T1 late sink: hits more than the delay behind their client's newest hit of the micro-batches before."""
    return _counted_hits(log, window_seconds, limit, delay_seconds).filter("late").select("event_id", "scope", "ip", "ts")


def final_counts(rows: DataFrame) -> DataFrame:
    """The last count of every event of ``rate_limit_stream`` (counts only grow)."""
    return rows.groupBy("event_id", "scope", "ip", "ts").agg(F.max("hits").alias("hits"),
                                                             F.max("breach").alias("breach"))
