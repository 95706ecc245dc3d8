"""A-series dashboard analytics and J22/J26-J28 worklists, table-wide.

The reference computes these in the browser for one user at a time; here one
grouped pass computes them for every doctor / patient at once.  Per-key top-n
uses ``row_number() <= n`` (planned as WindowGroupLimit, which limits each map
task's rows per key before the shuffle, so a hot key ships at most n rows per
task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import normalize_risk_label
from .ordinals import ordinal_among

# Worklist rank of triage levels (unknown -> 9).
TRIAGE_RANK = {"Critical": 0, "High": 1, "Moderate": 2, "Low": 3, "Needs vitals": 4}


def _ts(x) -> Column:
    return F.lit(x).cast("timestamp") if isinstance(x, str) else x


def upcoming_flag(scheduled: Column, status: Column, as_of, allow_blank: bool = False) -> Column:
    """At or after ``as_of`` and Pending/Confirmed (blank allowed for patients)."""
    ok = status.isin("Pending", "Confirmed")
    if allow_blank:
        ok = ok | status.isNull() | (status == "")
    return F.coalesce((scheduled >= _ts(as_of)) & ok, F.lit(False))


def triage_rank(level: Column) -> Column:
    expr = None
    for k, v in TRIAGE_RANK.items():
        expr = F.when(level == k, v) if expr is None else expr.when(level == k, v)
    return expr.otherwise(9)


def in_forward_window(ts: Column, key: str, as_of) -> Column:
    """A4: [today, today + n days) relative to the as_of date; NULL time only in 'all'."""
    if key == "all":
        return F.lit(True)
    start = F.to_timestamp(F.to_date(_ts(as_of)))
    days = {"today": 1, "7d": 7, "30d": 30}[key]
    end = start + F.make_dt_interval(days=F.lit(days))
    return F.coalesce((ts >= start) & (ts < end), F.lit(False))


def in_past_window(ts: Column, key: str, as_of) -> Column:
    """A5: [tomorrow - n days, tomorrow): includes today."""
    if key == "all":
        return F.lit(True)
    end = F.to_timestamp(F.date_add(F.to_date(_ts(as_of)), 1))
    days = {"today": 1, "7d": 7, "30d": 30}[key]
    start = end - F.make_dt_interval(days=F.lit(days))
    return F.coalesce((ts >= start) & (ts < end), F.lit(False))


def doctor_kpis(appts: DataFrame, as_of, past: bool = False) -> DataFrame:
    """A1: per doctor distinct patients, appointments, high/medium/low, today."""
    r = normalize_risk_label("predicted_risk_level")
    today = in_past_window(F.col("scheduled_for"), "today", as_of) if past else in_forward_window(
        F.col("scheduled_for"), "today", as_of)
    d = appts.filter(F.col("doctor_email").isNotNull() & (F.col("doctor_email") != ""))
    return d.groupBy(F.lower("doctor_email").alias("doctor_email")).agg(
        F.count_distinct(F.when(F.col("patient_email") != "", F.lower("patient_email"))).alias("patients"),
        F.count(F.lit(1)).alias("appointments"),
        F.count_if(r == "high").alias("high"), F.count_if(r == "medium").alias("medium"),
        F.count_if(r == "low").alias("low"), F.count_if(today).alias("today"))


def risk_share(kpis: DataFrame) -> DataFrame:
    """A2: whole percents (half up) and donut degrees; 0 when there are no rows."""
    tot = F.col("appointments")

    def pct(c):
        return F.when(tot > 0, F.floor(F.col(c) / tot * 100 + 0.5)).otherwise(0).cast("int")

    hi = F.when(tot > 0, F.col("high") / tot * 360).otherwise(0.0)
    me = F.when(tot > 0, F.col("medium") / tot * 360).otherwise(0.0)
    return kpis.select(
        "doctor_email", F.col("appointments").alias("total"), pct("high").alias("high_pct"),
        pct("medium").alias("medium_pct"), pct("low").alias("low_pct"),
        F.round(hi, 4).alias("high_deg"), F.round(me, 4).alias("medium_deg"),
        F.round(F.when(tot > 0, F.greatest(F.lit(0.0), 360 - hi - me)).otherwise(0.0), 4).alias("low_deg"))


def doctor_insights(appts: DataFrame, as_of, past: bool = False) -> DataFrame:
    """A3: first 5 high-risk, first 5 today (list order), 6 most recent, per doctor.

    Each list is ``row_number() <= k`` directly over its rows, which Spark plans
    as a WindowGroupLimit (each map task forwards at most k rows per doctor),
    so a doctor with a large share of appointments is not ranked in one task.
    The shared input should be materialised by the caller when it is costly.
    """
    d = appts.filter(F.col("doctor_email").isNotNull() & (F.col("doctor_email") != "")).withColumn(
        "doctor_email", F.lower("doctor_email"))
    is_high = normalize_risk_label("predicted_risk_level") == "high"
    is_today = in_past_window(F.col("scheduled_for"), "today", as_of) if past else in_forward_window(
        F.col("scheduled_for"), "today", as_of)
    order = [F.desc("scheduled_for"), F.desc("id")] if past else [F.asc("scheduled_for"), F.asc("id")]
    recent_key = F.col("scheduled_for") if past else F.coalesce(F.col("created_at"), F.col("scheduled_for"))
    w = Window.partitionBy("doctor_email")
    cols = ["doctor_email", "list", "rn", "id", "patient_email", "scheduled_for"]

    def top(frame, name, k, ordering):
        r = frame.withColumn("rn", F.row_number().over(w.orderBy(*ordering))).filter(F.col("rn") <= k)
        return r.withColumn("list", F.lit(name)).select(*cols)

    return (top(d.filter(is_high), "high", 5, order).unionByName(top(d.filter(is_today), "today", 5, order))
            .unionByName(top(d, "recent", 6, [recent_key.desc(), F.desc("id")])))


def window_counts(appts: DataFrame, as_of) -> DataFrame:
    """A4 + A5 counted per doctor for every window key."""
    ts = F.col("scheduled_for")
    d = appts.filter(F.col("doctor_email").isNotNull() & (F.col("doctor_email") != ""))
    aggs = [F.count(F.lit(1)).alias("all_count")]
    for k in ("today", "7d", "30d"):
        aggs.append(F.count_if(in_forward_window(ts, k, as_of)).alias(f"next_{k}"))
        aggs.append(F.count_if(in_past_window(ts, k, as_of)).alias(f"past_{k}"))
    return d.groupBy(F.lower("doctor_email").alias("doctor_email")).agg(*aggs)


EMERGENCY_ONLY_START = "22:00"
EMERGENCY_ONLY_END = "06:00"


def emergency_only_time(ts: Column) -> Column:
    """HH:mm within the overnight emergency-only window (wraps midnight)."""
    t = F.date_format(ts, "HH:mm")
    if EMERGENCY_ONLY_START <= EMERGENCY_ONLY_END:
        return (t >= EMERGENCY_ONLY_START) & (t < EMERGENCY_ONLY_END)
    return (t >= EMERGENCY_ONLY_START) | (t < EMERGENCY_ONLY_END)


def patient_worklist(appts: DataFrame, as_of, n: int = 10) -> DataFrame:
    """Per patient, upcoming ascending (first n) and past descending (first n)."""
    up = upcoming_flag(F.col("scheduled_for"), F.col("status"), as_of, allow_blank=True)
    d = appts.withColumn("bucket", F.when(up, "upcoming").otherwise("past"))
    w_up = Window.partitionBy("patient_email").orderBy(F.asc("scheduled_for"), F.asc("id"))
    w_past = Window.partitionBy("patient_email").orderBy(F.desc("scheduled_for"), F.desc("id"))
    a = d.filter(F.col("bucket") == "upcoming").withColumn("rn", F.row_number().over(w_up))
    b = d.filter(F.col("bucket") == "past").withColumn("rn", F.row_number().over(w_past))
    return a.unionByName(b).filter(F.col("rn") <= n).select("patient_email", "bucket", "rn", "id", "scheduled_for",
                                                            "status")


def rank_newest_first(appts: DataFrame, key: str, out: str = "rank_in_key") -> DataFrame:
    """Position of each row in its key's newest-first list, skew-safe.

    Ordinals are computed per (key, time block) with a per-block offset table
    (``ordinal_among``), so a key holding a large share of rows is spread over
    many tasks instead of one window partition.
    """
    d = appts.withColumn("__neg_ts", -F.unix_seconds("scheduled_for")).withColumn("__neg_id", -F.col("id"))
    return ordinal_among(d, "__neg_ts", F.lit(True), out, partition_cols=[key], tiebreak=["__neg_id"]).drop(
        "__neg_ts", "__neg_id")


def filtered_for_doctor(appts: DataFrame, as_of, risk: str = "all", window: str = "all",
                        past: bool = False) -> DataFrame:
    """A doctor's own rows (unassigned never shown), risk filter, date window,
    ascending time (upcoming view) or descending (past view)."""
    d = appts.filter(F.col("doctor_email").isNotNull() & (F.col("doctor_email") != "")).withColumn(
        "doctor_email", F.lower("doctor_email"))
    if risk != "all":
        d = d.filter(normalize_risk_label("predicted_risk_level") == risk)
    cond = in_past_window(F.col("scheduled_for"), window, as_of) if past else in_forward_window(
        F.col("scheduled_for"), window, as_of)
    d = d.filter(cond)
    order = [F.desc("scheduled_for"), F.desc("id")] if past else [F.asc("scheduled_for"), F.asc("id")]
    return d.orderBy("doctor_email", *order)
