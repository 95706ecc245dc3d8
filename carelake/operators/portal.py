"""Smaller portal operators: display mappings (R17, R19-R21), lookups (J2, J39),
leave requests and listings (J8, J24, J25), appends (J13, J14), the protected
fold (J21 usage), search and choice lists (J29, A8-A10, A12), time parsing (J40).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import LEAVE_MESSAGES
from .accounts import safe_role
from .ordinals import ordinal_among
from .records import EmergencyRoster, leave_for, phone_error

# A calendar date, optionally with a time and an offset.
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"

# Display order of probability bars.
BAR_ORDER = ["Low", "Moderate", "High", "Critical"]


def normalize_final_group(c: Column) -> Column:
    """Medium -> Moderate, known groups title-cased, blank -> '', else unchanged."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(raw)
    return (F.when(raw == "", "").when(low == "medium", "Moderate").when(low == "critical", "Critical")
            .when(low == "high", "High").when(low == "moderate", "Moderate").when(low == "low", "Low").otherwise(raw))


def final_probability_map(c: Column) -> Column:
    """One-hot probability object over the four display groups."""
    g = normalize_final_group(c)
    return F.map_from_arrays(F.array(*[F.lit(x) for x in BAR_ORDER]),
                             F.array(*[F.when(g == x, 1.0).otherwise(0.0) for x in BAR_ORDER]))


def probability_bars(df: DataFrame, key: str, probs: str) -> DataFrame:
    """One row per map entry, fixed group order, clamped whole percent (half up)."""
    # A plain explode adds a filter on the map, which is pushed below all that makes the map and repeats it
    # there many times over; the outer form adds none.  Labels are null for missing and empty maps only.
    e = df.select(key, F.explode_outer(probs).alias("label", "p")).filter(F.col("label").isNotNull())
    order = F.array_position(F.array(*[F.lit(x) for x in BAR_ORDER]), F.col("label")) - 1
    pct = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("p") * 100 + 0.5))).cast("int")
    return e.select(key, "label", order.cast("int").alias("pos"), pct.alias("pct"))


def appointment_kind(booking_priority: Column, group: Column) -> Column:
    """Booking kind from the risk group (none without a booking priority)."""
    g = F.lower(F.coalesce(group, F.lit("")))
    return (F.when(F.coalesce(booking_priority, F.lit("")) == "", "-")
            .when(g.isin("critical", "high"), "Urgent appointment")
            .when(g.isin("moderate", "medium"), "Priority appointment").otherwise("Normal appointment"))


def lookup_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """J2 / J39 in bulk: first user (lowest id) by normalised email, else by a valid
    normalised phone; stored phones that are not valid are skipped."""
    u = users.select("id", F.lower(F.trim("email")).alias("__e"), F.trim(F.coalesce("phone", F.lit(""))).alias("__p"),
                     F.col("email").alias("user_email"))
    by_e = u.groupBy("__e").agg(F.min_by("user_email", "id").alias("e_match"))
    by_p = u.filter(phone_error(F.col("__p")).isNull()).groupBy("__p").agg(F.min_by("user_email", "id").alias("p_match"))
    r = requests.select("request_id", F.lower(F.trim("email")).alias("__e"), F.trim("phone").alias("__p"),
                        phone_error(F.col("phone")).isNull().alias("__pok"))
    r = r.join(by_e, "__e", "left").join(by_p, "__p", "left")
    p_match = F.when(F.col("__pok"), F.col("p_match"))
    return r.select("request_id", F.coalesce("e_match", p_match).alias("matched_email"),
                    F.when(F.col("e_match").isNotNull(), "email").when(p_match.isNotNull(), "phone")
                    .alias("matched_by"))


def leave_check(checks: DataFrame, ref: DataFrame, leaves: DataFrame, key: str, doctor_col: str,
                when_col: str) -> DataFrame:
    """Leave flag, leave row, message and all emergency doctors on duty (file order) per check."""
    r = leave_for(checks, leaves, key, doctor_col, when_col)
    roster = EmergencyRoster(ref, leaves)
    segments = roster.segments(checks, when_col).checkpoint(eager=True)
    # Checks learn their segment first and meet the lists on it, where the lists are made: a list never
    # shuffles, and there is one per segment, not one per instant.
    r = r.join(segments.withColumnRenamed(when_col, "__when"), F.col(when_col) == F.col("__when"), "left")
    r = r.join(roster.lists(segments.select("__segment").distinct()), "__segment", "left")
    msg = F.when(F.col("on_leave"), LEAVE_MESSAGES["on_leave"]).otherwise(LEAVE_MESSAGES["available"])
    return r.select(key, "on_leave", "leave_id", "leave_start", "leave_end",
                    F.coalesce("on_duty", F.lit("")).alias("emergency_doctors"),
                    F.coalesce("n_on_duty", F.lit(0).cast("bigint")).alias("emergency_available"), msg.alias("message"))


def leaves_newest_first(leaves: DataFrame) -> DataFrame:
    """Each doctor's leaves by start desc (ties: id desc), skew-safe rank."""
    d = leaves.withColumn("__neg", -F.unix_seconds("start_at")).withColumn("__negid", -F.col("id"))
    return ordinal_among(d, "__neg", F.lit(True), "rank_in_doctor", partition_cols=["doctor_email"],
                         tiebreak=["__negid"]).drop("__neg", "__negid")


def leave_admission(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """J25 (+ J32 ids): own calendar, end >= start; accepted rows get max(id)+n."""
    own = F.lower(F.trim("requester_email")) == F.lower(F.trim("doctor_email"))
    reason = (F.when(~own, LEAVE_MESSAGES["own_calendar"])
              .when(F.col("end_at") < F.col("start_at"), LEAVE_MESSAGES["end_before_start"]))
    r = requests.withColumn("reject_reason", reason)
    r = ordinal_among(r, "request_id", F.col("reject_reason").isNull(), "__n",
                      tiebreak=["doctor_email", "start_at", "end_at"])
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()  # next id base (J32)
    return r.select(
        "request_id", F.col("reject_reason").isNull().alias("accepted"), "reject_reason",
        F.when(F.col("reject_reason").isNull(), top + F.col("__n")).alias("new_leave_id"),
        F.lower(F.trim("doctor_email")).alias("doctor_email"), "start_at", "end_at")


def append_submissions(feed: DataFrame, path: str) -> None:
    """Every submission appended; rows with a blank email are dropped."""
    feed.filter(F.trim(F.coalesce("email", F.lit(""))) != "").write.mode("append").parquet(path)


def history_rows(events: DataFrame) -> DataFrame:
    """Audit events as stored rows (JSON text columns)."""
    return events.select("patient_email", "event_id", "changed_at", "changed_by_email", "changed_by_role", "source",
                         F.to_json("changes").alias("changes_json"), F.to_json("before").alias("before_json"),
                         F.to_json("after").alias("after_json"))


def append_history(events: DataFrame, path: str) -> None:
    history_rows(events).write.mode("append").parquet(path)


def patient_directory(users: DataFrame, query: str | None = None) -> DataFrame:
    """J29 + A9: patients sorted by lower(trim(name)), optional name/email search."""
    p = users.filter(safe_role(F.col("role")) == "patient")
    if query:
        q = query.strip().lower()
        p = p.filter(F.lower(F.coalesce("full_name", F.lit(""))).contains(q)
                     | F.lower(F.coalesce("email", F.lit(""))).contains(q))
    return p.select("id", "full_name", "email").orderBy(F.lower(F.trim("full_name")), "id")


def parse_iso_utc(text: Column) -> Column:
    """ISO text with Z, offset or none (= UTC) -> UTC timestamp; anything else -> NULL
    (Spark's cast alone would also take a bare time, as of today, a year or a month)."""
    seconds = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})($|Z|[+-])", "$1:00$2")
    return F.when(F.trim(text).rlike(ISO_TEXT), seconds.try_cast("timestamp"))


def search_top(df: DataFrame, query: str, n: int, order: list[Column]) -> DataFrame:
    """name/email substring filter, then the first n in ``order`` (top-k is the feature)."""
    q = query.strip().lower()
    f = df.filter(F.lower(F.coalesce("patient_name", F.lit(""))).contains(q)
                  | F.lower(F.coalesce("patient_email", F.lit(""))).contains(q))
    return f.orderBy(*order).limit(n)


def doctor_choices(directory: DataFrame, emergency_only: bool = False) -> DataFrame:
    """A10: doctor choice list, emergency first then name; on-leave entries flagged."""
    d = directory.filter("emergency_doctor") if emergency_only else directory
    return d.select("email", "full_name", "emergency_doctor", "on_leave", "specialization").orderBy(
        F.desc("emergency_doctor"), F.col("full_name"), "email")


def recent_per_patient(appts: DataFrame, n: int = 10) -> DataFrame:
    """The n most recent appointments of each patient (WindowGroupLimit)."""
    w = Window.partitionBy("patient_email").orderBy(F.desc("scheduled_for"), F.desc("id"))
    return appts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
