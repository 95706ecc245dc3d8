"""The submission feed as Structured Streaming jobs.

T2 latest details: micro-batches merged into a bucketed table with one row per
patient, submissions older than the stored one in a late sink.  T3 audit events: a stateful step that pairs each
submission with the previous document of the same patient (state = last
document), followed by the same diff expression as the batch twin.  T4
continuous scoring: stateless rules plus stream-static joins to the reference
frequency tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as RC
from ..operators import scoring as SC
from ..operators.stored_table import BucketedTable
from .sources import scratch_path

PAIR_SCHEMA = ("email STRING, id BIGINT, submitted_at TIMESTAMP, payload_json STRING, prev_id BIGINT, "
               "prev_json STRING, late BOOLEAN")
LAST_DOCS_SCHEMA = "docs BINARY"  # an Arrow table, a row per patient
PATIENT_BUCKETS = 256  # groups of patients; as long as a checkpoint is used it stays as it is
OUT_ROWS = 8192  # rows of one output frame


def latest_details_stream(subs: DataFrame) -> DataFrame:
    """T2 as a plain streaming aggregation: latest submission per email (update mode)."""
    s = subs.withColumn("email", RC.email_key("email")).filter(F.col("email") != "")
    return s.groupBy("email").agg(F.max_by(F.struct("id", "submitted_at", "payload_json"),
                                           F.struct("submitted_at", "id")).alias("b")).select(
        "email", F.col("b.id").alias("id"), F.col("b.submitted_at").alias("submitted_at"),
        F.col("b.payload_json").alias("payload_json"))


LATEST_SCHEMA = "email string, id bigint, submitted_at timestamp, payload_json string, epoch bigint"
LATEST_BUCKETS = 32


def _newest(rows: DataFrame) -> DataFrame:
    """One row per email: the latest submission, ties by the larger id."""
    cols = ("id", "submitted_at", "payload_json", "epoch")
    return rows.groupBy("email").agg(F.max_by(F.struct(*cols), F.struct("submitted_at", "id")).alias("b")).select(
        "email", *[F.col(f"b.{c}").alias(c) for c in cols])


def merge_latest(table: BucketedTable, late_path: str, batch: DataFrame, epoch: int) -> None:
    """One micro-batch of T2: submissions older than the stored one go to the late sink under their
    epoch, the others replace it where they are newer.  A row keeps the epoch that wrote it.  Late rows
    are written before the table changes, so a retried epoch that finds rows of its own has written them all; it
    finds its submissions stored and changes nothing."""
    rows = batch.withColumn("email", RC.email_key("email")).filter(F.col("email") != "").select(
        "email", "id", "submitted_at", "payload_json").withColumn("epoch", F.lit(epoch).cast("bigint")).checkpoint(eager=True)
    stored = table.read()
    if stored.filter(F.col("epoch") == epoch).isEmpty():
        known = stored.select(F.col("email").alias("__e"), F.struct("submitted_at", "id").alias("__at"))
        older = rows.join(known, F.col("email") == F.col("__e")).filter(F.struct("submitted_at", "id") < F.col("__at"))
        older.select("email", "id", "submitted_at", "payload_json").write.mode("overwrite").parquet(
            f"{late_path}/epoch={epoch}")
    # rows already stored are taken from the table, so that a retry does not claim them
    table.apply(_newest(rows), lambda now, new: _newest(now.unionByName(new.join(
        now.select("email", "id", "submitted_at"), ["email", "id", "submitted_at"], "left_anti"))))


def run_latest_details(subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T2 over all available input: the current table (one row per email) and the late submissions."""
    spark = subs.sparkSession
    table = BucketedTable(spark, scratch_path(spark, "stream-latest"), "email", LATEST_SCHEMA, LATEST_BUCKETS)
    late = scratch_path(spark, "stream-late")
    query = (subs.writeStream.foreachBatch(lambda batch, epoch: merge_latest(table, late, batch, epoch))
             .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).trigger(availableNow=True).start())
    query.awaitTermination()
    if query.lastProgress is None:  # an empty feed has no micro-batch
        return table.read(), table.read().drop("epoch")
    return table.read(), spark.read.schema("email string, id bigint, submitted_at timestamp, payload_json string").parquet(
        f"{late}/epoch=*")


def _stored_docs(docs):
    """The last documents of a bucket's patients, as written by ``_as_state``."""
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(bytes(docs))).read_pandas()


def _as_state(last) -> tuple:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    schema = pa.schema([("email", pa.string()), ("id", pa.int64()), ("submitted_at", pa.timestamp("us")),
                        ("payload_json", pa.string())])
    table = pa.Table.from_pandas(last, schema=schema, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _pair_fn(key, pdfs, state):
    """The stateful step of one bucket of patients.  A call costs milliseconds however few submissions it
    gets, so patients share calls; inside, all of them are paired by one sort."""
    import numpy as np
    import pandas as pd

    cols = ["email", "id", "submitted_at", "payload_json"]
    batch = pd.concat([pdf[cols] for pdf in pdfs], ignore_index=True)
    if batch.empty:
        return
    batch["id"] = batch["id"].astype("Int64")
    batch["submitted_at"] = batch["submitted_at"].astype("datetime64[us]")
    batch = batch.sort_values(["email", "submitted_at", "id"], kind="stable").reset_index(drop=True)
    last = _stored_docs(state.get[0]) if state.exists else batch.iloc[:0]
    last = last.astype({"id": "Int64", "submitted_at": "datetime64[us]"})
    known = pd.Index(last["email"])
    # a submission older than the patient's stored latest version arrived too late to be
    # diffed in order: it goes to the late output and leaves the state alone
    stamps = np.append(last["submitted_at"].to_numpy(), np.datetime64("NaT"))
    late = batch["submitted_at"].to_numpy() < stamps[known.get_indexer(batch["email"])]
    parts = [batch[late].assign(prev_id=pd.array([None] * int(late.sum()), dtype="Int64"), prev_json=None, late=True)]
    on_time = batch[~late].reset_index(drop=True)
    if not on_time.empty:
        before = on_time[["id", "payload_json"]].shift(1)
        first = np.flatnonzero(on_time["email"].ne(on_time["email"].shift(1)))
        place = known.get_indexer(on_time["email"].iloc[first])
        stored = last[["id", "payload_json"]].reset_index(drop=True).reindex(place)  # no row is numbered -1
        before.iloc[first, 0] = stored["id"].array
        before.iloc[first, 1] = stored["payload_json"].astype(object).where(stored["payload_json"].notna(), None).array
        parts.append(on_time.assign(prev_id=before["id"], prev_json=before["payload_json"], late=False))
        newest = on_time[on_time["email"].ne(on_time["email"].shift(-1)).to_numpy()]
        state.update(_as_state(pd.concat([last[~known.isin(newest["email"])], newest], ignore_index=True)))
    for out in parts:
        for at in range(0, len(out), OUT_ROWS):
            yield out.iloc[at:at + OUT_ROWS][[*cols, "prev_id", "prev_json", "late"]]


def consecutive_pairs_stream(subs: DataFrame) -> DataFrame:
    """Pair each submission with the patient's previous document (state: last doc of each patient, kept in
    ``PATIENT_BUCKETS`` buckets, so calls and state rows do not grow with the number of patients)."""
    s = subs.withColumn("email", RC.email_key("email")).filter(F.col("email") != "")
    bucket = F.pmod(F.xxhash64("email"), F.lit(PATIENT_BUCKETS))
    return s.withColumn("__bucket", bucket).groupBy("__bucket").applyInPandasWithState(
        _pair_fn, PAIR_SCHEMA, LAST_DOCS_SCHEMA, "append", "NoTimeout")


def late_submissions_stream(subs: DataFrame) -> DataFrame:
    """T3 late sink: submissions older than the patient's already-processed latest version."""
    return consecutive_pairs_stream(subs).filter("late").select("email", "id", "submitted_at", "payload_json")


def audit_events_stream(subs: DataFrame) -> DataFrame:
    """Audit event per changed submission (same diff as ``records.record_changes``);
    late submissions are left out here and appear in ``late_submissions_stream``."""
    p = consecutive_pairs_stream(subs).filter(~F.col("late"))
    p = SC.parse_details(p, "payload_json", "d")
    p = SC.parse_details(p, "prev_json", "prev")
    changes = F.when(F.col("prev_json").isNull(), RC.field_changes(None, "d")).otherwise(RC.field_changes("prev", "d"))
    return p.withColumn("changes", changes).filter(F.size("changes") > 0).select(
        F.col("email").alias("patient_email"), F.col("id").alias("event_id"), "prev_id",
        F.col("submitted_at").alias("changed_at"), "changes")


def scoring_stream(subs: DataFrame, ref: DataFrame) -> DataFrame:
    """T4: every submission scored as it arrives (stateless + stream-static joins)."""
    d = SC.parse_details(subs.withColumn("email", RC.email_key("email")).filter(F.col("email") != ""))
    r = SC.patient_risk(d, ref)
    return r.select("email", "id", "submitted_at", "risk_level", "risk_source", "risk_booking_priority")
