"""Registered streaming queries: run to completion (availableNow) into a table
in the shared checkpoint folder and read back; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as SC
from ..sources import views as VW
from ..streaming import rate_limit as RL
from ..streaming import records as SR
from ..streaming.sources import run_to_table, table_feed
from .queries import _j, reference_table
from .queries_records import RATE_LIMIT, RATE_WINDOW_SECONDS


def q_stream_rate_limit(spark, sf):
    log = VW.access_log_from(table_feed(spark, sf, "events", "ts"))
    out = run_to_table(spark, RL.rate_limit_stream(log, RATE_WINDOW_SECONDS, RATE_LIMIT))
    return RL.final_counts(out)


def q_stream_latest_details(spark, sf):
    subs = VW.submissions_from(table_feed(spark, sf, "events", "ts"))
    return SR.run_latest_details(subs)[0].drop("epoch")


def q_stream_audit_events(spark, sf):
    subs = VW.submissions_from(table_feed(spark, sf, "events", "ts"))
    out = run_to_table(spark, SR.audit_events_stream(subs))
    return out.select("patient_email", "event_id", "prev_id", "changed_at",
                      _j(F.col("changes.field"), ", ").alias("changed_fields"),
                      F.size("changes").alias("n_changes"))


def q_stream_scoring(spark, sf):
    subs = VW.submissions_from(table_feed(spark, sf, "events", "ts"))
    ref = reference_table(spark, sf)  # read in every micro-batch, never rebuilt
    return run_to_table(spark, SR.scoring_stream(subs, ref))


def registry_stream():
    return {
        "stream_rate_limit": q_stream_rate_limit,
        "stream_latest_details": q_stream_latest_details,
        "stream_audit_events": q_stream_audit_events,
        "stream_scoring": q_stream_scoring,
    }
