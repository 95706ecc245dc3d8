"""J-series: relational work over the clinic tables (joins, top-1, diffs, merges).

Top-1-per-key uses ``max_by`` over a struct ordering key (a partial
aggregate: each map task keeps one row per key before the shuffle), not
``row_number`` over a window, so a patient or doctor holding a large share of
the rows does not land whole in one task.  Top-n (n > 1) uses ``row_number``
with ``<= n``, which Spark plans as a WindowGroupLimit (per-task limit before
the shuffle-side window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import ACCOUNT_ERRORS as AE
from ..functions.messages import BOOKING_ERRORS as BE
from ..functions.text import non_null
from .ordinals import last_non_null_in_key, ordinal_among, previous_in_key
from .scoring import parse_details


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str], cols: list[str] | None = None) -> DataFrame:
    """Row with the greatest ``order`` tuple per key (ties need a unique last column)."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = cols or [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in cols])


def email_key(c: str) -> Column:
    """Addresses are compared trimmed and in lower case."""
    return F.lower(F.trim(F.col(c)))


def latest_details(submissions: DataFrame) -> DataFrame:
    """J12 / T2 batch twin: latest submission per email by (submitted_at, id)."""
    subs = submissions.withColumn("email", email_key("email")).filter(F.col("email") != "")
    return latest_per_key(subs, "email", ["submitted_at", "id"], ["id", "submitted_at", "payload_json"])


def health_details(submissions: DataFrame) -> DataFrame:
    """Latest parsed document per email (``d`` struct), as stored in health_details."""
    return parse_details(latest_details(submissions))


# ------------------------------------------------------------ users

def users_with_details(users: DataFrame, details: DataFrame) -> DataFrame:
    """Users left-joined to their stored details, ordered by role, lower(name)."""
    hd = details.select(F.col("email").alias("hd_email"), F.col("submitted_at").alias("details_submitted_at"),
                        F.col("payload_json").alias("details_json"))
    out = users.join(hd, users["email"] == hd["hd_email"], "left").drop("hd_email")
    return out.select(
        "id", "full_name", "email", F.coalesce("phone", F.lit("")).alias("phone"), "role",
        F.col("details_json").isNotNull().alias("health_details_completed"), "details_submitted_at",
        "details_json").orderBy("role", F.lower("full_name"))


# ----------------------------------------------------- leaves

DAY_SECONDS = 86400
LEAVE_LEVELS = 4  # cells of 1, 64, 64^2 and 64^3 days


def _cell(when: Column, level: Column | int) -> Column:
    width = DAY_SECONDS * (64 ** level if isinstance(level, int) else F.pow(F.lit(64), level).cast("bigint"))
    return F.floor(F.unix_seconds(when) / width).cast("bigint")


def _leveled(leaves: DataFrame) -> DataFrame:
    """The valid leaves with the level of their cells."""
    ok = leaves.filter(F.col("start_at").isNotNull() & F.col("end_at").isNotNull()
                       & (F.col("end_at") >= F.col("start_at")))
    days = (F.unix_seconds("end_at") - F.unix_seconds("start_at")) / DAY_SECONDS
    level = F.lit(LEAVE_LEVELS - 1)
    for k in reversed(range(LEAVE_LEVELS - 1)):
        level = F.when(days <= 64 ** (k + 1), k).otherwise(level)
    return ok.withColumn("lv_level", level)


def leave_cells(leaves: DataFrame, *more: str) -> DataFrame:
    """Valid leaves (closed interval) with the time cells they cover, and the columns ``more``.

    A leave enters cells as wide as its own length asks for (64 times wider from
    level to level), so it has at most 66 of them however long it is.  The range
    join becomes an equi-join on (doctor, level, cell) plus a residual
    ``between``.  Rows whose bounds do not parse (NULL or end < start) are skipped.
    """
    return _leveled(leaves).select(
        F.lower(F.trim("doctor_email")).alias("lv_doctor"), F.col("id").alias("leave_id"),
        F.col("start_at").alias("leave_start"), F.col("end_at").alias("leave_end"), "lv_level", *more,
        F.explode(F.sequence(_cell(F.col("start_at"), F.col("lv_level")), _cell(F.col("end_at"), F.col("lv_level"))))
        .alias("lv_cell"))


def _at_levels(df: DataFrame, when: str, leaves: DataFrame) -> DataFrame:
    """One row per level that some leave has, with the cell of ``when`` on it; an instant shuffles once
    per level of the leaves there are."""
    levels = _leveled(leaves).agg(F.collect_set("lv_level")).scalar()  # at most LEAVE_LEVELS numbers
    cells = non_null(*[F.when(F.array_contains(levels, F.lit(k)), F.struct(
        F.lit(k).alias("level"), _cell(F.col(when), k).alias("cell"))) for k in range(LEAVE_LEVELS)])
    return df.select("*", F.explode(cells).alias("__c")).select("*", F.col("__c.level").alias("__level"),
                                                               F.col("__c.cell").alias("__cell")).drop("__c")


def leave_for(events: DataFrame, leaves: DataFrame, key: str, doctor_col: str, when_col: str) -> DataFrame:
    """For each event (unique ``key``) the matching leave with the latest start
    (ties: highest id), or NULLs.  Output: key + leave_id, leave_start, leave_end, on_leave.
    """
    ev = events.select(F.col(key).alias("__k"), F.lower(F.trim(F.col(doctor_col))).alias("__doc"),
                       F.col(when_col).alias("__when")).filter(F.col("__doc").isNotNull() & F.col("__when").isNotNull())
    ev, lv = _at_levels(ev, "__when", leaves), leave_cells(leaves)
    hits = ev.join(lv, (ev["__doc"] == lv["lv_doctor"]) & (ev["__level"] == lv["lv_level"])
                   & (ev["__cell"] == lv["lv_cell"])
                   & ev["__when"].between(lv["leave_start"], lv["leave_end"]), "inner")
    best = hits.groupBy("__k").agg(F.max_by(F.struct("leave_id", "leave_start", "leave_end"),
                                            F.struct("leave_start", "leave_id")).alias("__b"))
    best = best.select(F.col("__k").alias(key), F.col("__b.leave_id").alias("leave_id"),
                       F.col("__b.leave_start").alias("leave_start"), F.col("__b.leave_end").alias("leave_end"))
    out = events.join(best, key, "left")
    return out.withColumn("on_leave", F.col("leave_id").isNotNull())


def on_leave_at(doctors: DataFrame, leaves: DataFrame, doctor_col: str, when) -> DataFrame:
    """J5 at one instant: doctors with a leave covering ``when`` (semi-join form)."""
    w = F.lit(when).cast("timestamp") if isinstance(when, str) else when
    lv = leaves.filter(F.col("start_at").isNotNull() & F.col("end_at").isNotNull()
                       & (F.col("end_at") >= F.col("start_at")) & w.between(F.col("start_at"), F.col("end_at")))
    lv = lv.select(F.lower(F.trim("doctor_email")).alias("__doc"))
    return doctors.join(lv, F.lower(F.trim(doctors[doctor_col])) == lv["__doc"], "left_semi")


TRUTHY = ["yes", "true", "1", "y"]


def doctors_reference(ref: DataFrame) -> DataFrame:
    """Skip blank ids, name falls back to id, truthy emergency flag; ``seq`` is the place in the file."""
    did = F.trim("doctor_id")
    return ref.filter(did != "").select(
        F.col("seq") if "seq" in ref.columns else F.lit(0).cast("bigint").alias("seq"),
        did.alias("doctor_id"),
        F.coalesce(F.when(F.trim("doctor_name") != "", F.trim("doctor_name")), did).alias("doctor_name"),
        F.trim(F.coalesce("specialization", F.lit(""))).alias("specialization"),
        F.trim(F.coalesce("available_time", F.lit(""))).alias("available_time"),
        F.lower(F.trim(F.coalesce("emergency_doctor", F.lit("")))).isin(TRUTHY).alias("emergency_doctor"))


def emergency_available(ref: DataFrame, leaves: DataFrame, when) -> DataFrame:
    """Emergency doctors with no leave covering ``when``."""
    docs = doctors_reference(ref).filter("emergency_doctor")
    busy = on_leave_at(docs, leaves, "doctor_id", when).select("doctor_id")
    return docs.join(busy, "doctor_id", "left_anti")


def directory(users: DataFrame, ref: DataFrame, leaves: DataFrame, details: DataFrame, when) -> DataFrame:
    """J7 + A10: registered doctors, enriched from the reference list, leave flags at ``when``."""
    docs = users.filter(F.col("role") == "doctor").withColumn("__key", F.lower(F.trim("email")))
    docs = docs.filter(F.col("__key") != "")
    docs = latest_per_key(docs.withColumn("__neg", -F.col("id")), "__key", ["__neg"],
                          ["id", "full_name", "email", "role"])  # first row per email
    dref = doctors_reference(ref).withColumn("__rkey", F.lower("doctor_id"))
    dref = latest_per_key(dref, "__rkey", ["doctor_id"], ["specialization", "available_time", "emergency_doctor"])
    out = docs.join(dref, docs["__key"] == dref["__rkey"], "left").drop("__rkey")
    w = F.lit(when).cast("timestamp") if isinstance(when, str) else when
    out = out.withColumn("__when", w)
    out = leave_for(out, leaves, "__key", "email", "__when")
    hd = details.select(F.col("email").alias("__hd")).withColumn("__has", F.lit(True))
    out = out.join(hd, out["email"] == hd["__hd"], "left")
    return out.select(
        "full_name", "email", "role", F.coalesce("__has", F.lit(False)).alias("health_details_completed"),
        F.coalesce("specialization", F.lit("")).alias("specialization"),
        F.coalesce("available_time", F.lit("")).alias("available_time"),
        F.coalesce("emergency_doctor", F.lit(False)).alias("emergency_doctor"),
        "on_leave", (~F.col("on_leave")).alias("available"), "leave_id")


# ---------------------------------------------------- admissions

PHONE_RE = r"^\d{10}$"
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NAME_RE = r"^[A-Za-z]+(?: [A-Za-z]+)*$"


def phone_error(phone: Column) -> Column:
    """J35 normalize_phone: NULL when valid, else the error text."""
    raw = F.trim(F.coalesce(phone, F.lit("")))
    return (F.when(raw == "", AE["phone_length"]).when(~raw.rlike(r"^\d+$"), AE["phone_digits"])
            .when(~raw.rlike(PHONE_RE), AE["phone_length"]))


def email_error(email: Column) -> Column:
    e = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    return F.when((e == "") | (F.length(e) > 254) | ~e.rlike(EMAIL_RE), AE["email"])


def name_error(name: Column) -> Column:
    n = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    return (F.when((F.length(n) < 2) | (F.length(n) > 100), AE["name_length"])
            .when(~n.rlike(NAME_RE), AE["name_chars"]))


def role_error(role: Column) -> Column:
    return F.when(~F.lower(F.trim(F.coalesce(role, F.lit("")))).isin("patient", "nurse", "doctor"),
                  AE["role"])


WORD_BITS = 64  # doctors of one bitmap word
NO_LEAVE_YET = "0001-01-01 00:00:00"


class EmergencyRoster:
    """Who of the emergency doctors is on duty, per time segment.

    The starts of leaves and the instants after their ends cut the time line into
    segments in which nobody's leave begins or ends, so one list serves all instants of a
    segment.  A doctor is a bit: the place in the file gives word and bit, and a
    segment's busy doctors are one 64-bit word each, built by ``bit_or`` (partial
    before the shuffle).  What shuffles is leaves, instants and words; a list is
    made once per segment that is asked for, from as many names as it shows.
    """

    def __init__(self, ref: DataFrame, leaves: DataFrame):
        docs = doctors_reference(ref).filter("emergency_doctor")
        docs = ordinal_among(docs, "seq", F.lit(True), "__place", tiebreak=["doctor_id", "doctor_name"])
        docs = docs.select(F.lower("doctor_id").alias("__busy_key"), "doctor_name",
                           F.expr(f"(__place - 1) div {WORD_BITS}").alias("__word"),
                           ((F.col("__place") - 1) % WORD_BITS).cast("int").alias("__bit"))
        self.words = docs.groupBy("__word").agg(
            F.array_sort(F.collect_list(F.struct("__bit", "doctor_name"))).alias("__names"))
        self.n_words = docs.agg(F.coalesce(F.max("__word") + 1, F.lit(0))).scalar()
        # A leave per place of its doctor in the file.
        own = leaves.withColumn("__busy_key", F.lower(F.trim("doctor_email"))).join(docs, "__busy_key")
        self.leaves = own.filter("start_at <= end_at").select("id", "doctor_email", "start_at", "end_at", "__word", "__bit")

    def segments(self, instants: DataFrame, when: str) -> DataFrame:
        """The distinct non-null ``when`` and ``__segment``, the instant at which each one's segment begins."""
        after = F.timestamp_micros(F.unix_micros("end_at") + 1)
        cuts = self.leaves.select(F.explode(F.array("start_at", after)).alias("__at")).distinct()
        both = cuts.select("__at", F.col("__at").alias("__cut"), F.lit(0).alias("__kind")).unionByName(
            instants.filter(F.col(when).isNotNull()).select(F.col(when).alias("__at")).distinct().select(
                "__at", F.lit(None).cast("timestamp").alias("__cut"), F.lit(1).alias("__kind")))
        swept = last_non_null_in_key(both.withColumn("__line", F.lit(0)), "__line", "__at", "__kind",
                                     {"__segment": F.col("__cut")}, block_seconds=DAY_SECONDS)
        return swept.filter("__kind = 1").select(
            F.col("__at").alias(when),
            F.coalesce("__segment", F.lit(NO_LEAVE_YET).cast("timestamp")).alias("__segment"))

    def busy(self, segments: DataFrame, leaves: DataFrame) -> DataFrame:
        """Per segment and word, the bits of the doctors on leave."""
        cells = leave_cells(leaves, "__word", "__bit")
        at = _at_levels(segments, "__segment", leaves)
        hits = at.join(cells, (F.col("__level") == F.col("lv_level")) & (F.col("__cell") == F.col("lv_cell"))
                       & F.col("__segment").between(F.col("leave_start"), F.col("leave_end")))
        return hits.groupBy("__segment", "__word").agg(
            F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__busy"))

    def free(self, wanted: DataFrame, leaves: DataFrame) -> DataFrame:
        """``wanted`` (segment, word) and ``__free``: names of the word's doctors on duty, in file order."""
        busy = self.busy(wanted.select("__segment").distinct(), leaves)
        met = wanted.join(busy, ["__segment", "__word"], "left").join(self.words, "__word")
        free = F.filter("__names", lambda d: F.coalesce(F.getbit("__busy", d["__bit"]), F.lit(0)) == 0)
        return met.select("__segment", "__word", F.transform(free, lambda d: d["doctor_name"]).alias("__free"))

    def lists(self, segments: DataFrame) -> DataFrame:
        """Per segment: ``on_duty``, all names on duty joined by ", ", and ``n_on_duty``."""
        whole = F.when(self.n_words > 0, F.sequence(F.lit(0).cast("bigint"), self.n_words - 1))
        wanted = segments.select("__segment", F.explode(whole).alias("__word"))
        pieces = self.free(wanted, self.leaves).select(
            "__segment", F.size("__free").alias("__n"),
            F.when(F.size("__free") > 0, F.struct("__word", F.array_join("__free", ", ").alias("__text"))).alias("__p"))
        return pieces.groupBy("__segment").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("__p")), lambda p: p["__text"]), ", ").alias("on_duty"),
            F.sum("__n").cast("bigint").alias("n_on_duty"))

    def first(self, segments: DataFrame, n: int) -> DataFrame:
        """Per segment: ``on_duty``, the first ``n`` names on duty (fewer if there are fewer).

        The file is walked word by word, twice as many words a step, and a segment
        leaves the walk once it has its names, so long lists are not built."""
        found, lo, hi = None, 0, 1
        left = segments.select("__segment", F.array().cast("array<string>").alias("__so_far"))
        total = segments.sparkSession.range(1).select(self.n_words.alias("n")).first().n
        while lo < total:
            some = self.leaves.filter((F.col("__word") >= lo) & (F.col("__word") < hi))
            wanted = left.select("__segment", F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(min(hi, total) - 1)
                                                                   .cast("bigint"))).alias("__word"))
            heads = self.free(wanted, some).select("__segment", F.struct(
                "__word", F.slice("__free", 1, n).alias("__head")).alias("__p")).groupBy("__segment").agg(
                F.flatten(F.transform(F.array_sort(F.collect_list("__p")), lambda p: p["__head"])).alias("__new"))
            left = left.join(heads, "__segment", "left").select("__segment", F.slice(F.concat(
                "__so_far", F.coalesce("__new", F.array().cast("array<string>"))), 1, n).alias("__so_far"))
            left = left.checkpoint(eager=True)
            done = left.filter(F.size("__so_far") >= n)
            found = done if found is None else found.unionByName(done)
            left, lo, hi = left.filter(F.size("__so_far") < n), hi, 2 * hi
            if left.isEmpty():
                break
        found = left if found is None else found.unionByName(left)
        return found.withColumnRenamed("__so_far", "on_duty")


def booking_admission(requests: DataFrame, users: DataFrame, ref: DataFrame, leaves: DataFrame,
                      created_at: Column | None = None) -> DataFrame:
    """Accept or reject booking requests; accepted ones as the rows to store.

    ``requests``: request_id, patient_email, scheduled_for, appointment_type,
    doctor_email, reason, notes, contact_info.  A rejection because of leave
    names the first three emergency doctors on duty, in file order.
    """
    u = users.select(F.lower(F.trim("email")).alias("__pe"), F.col("role").alias("__prole"))
    r = requests.withColumn("__pe", F.lower(F.trim("patient_email")))
    r = r.join(u, "__pe", "left")
    r = leave_for(r, leaves, "request_id", "doctor_email", "scheduled_for")
    roster = EmergencyRoster(ref, leaves)
    segments = roster.segments(r.filter("on_leave"), "scheduled_for").checkpoint(eager=True)
    names = segments.join(roster.first(segments.select("__segment").distinct(), 3), "__segment").select(
        F.col("scheduled_for").alias("__when"), F.array_join("on_duty", ", ").alias("emergency_names"))
    r = r.join(names, F.col("on_leave") & (F.col("scheduled_for") == F.col("__when")), "left")
    perr = phone_error(F.col("contact_info"))
    reason = (F.when(F.col("__prole").isNull() | (F.col("__prole") != "patient"), F.lit(BE["no_patient"]))
              .when(F.col("doctor_email").isNotNull() & F.col("on_leave"),
                    F.concat(F.lit(BE["doctor_on_leave"]),
                             F.when(F.coalesce(F.col("emergency_names"), F.lit("")) != "",
                                    F.concat(F.lit(BE["emergency_prefix"]), F.col("emergency_names"), F.lit(".")))
                             .otherwise(F.lit(""))))
              .when(perr.isNotNull(), perr))
    accepted = reason.isNull()
    return r.select(
        "request_id", accepted.alias("accepted"), reason.alias("reject_reason"),
        F.when(accepted, F.lit("Pending")).alias("status"),
        F.when(accepted, F.trim(F.coalesce(F.when(F.col("reason") != "", F.col("reason")),
                                           F.col("appointment_type")))).alias("reason"),
        F.when(accepted, F.trim("contact_info")).alias("contact_info"),
        F.when(accepted, F.lower(F.trim("doctor_email"))).alias("doctor_email"),
        F.when(accepted, F.col("__pe")).alias("patient_email"),
        F.when(accepted, F.col("scheduled_for")).alias("scheduled_for"),
        F.when(accepted, F.trim("appointment_type")).alias("appointment_type"),
        F.lit(None).cast("string").alias("priority"),
        F.when(accepted & (F.col("notes") != ""), F.trim("notes")).alias("notes"),
        F.when(accepted, F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def cancel_admission(requests: DataFrame, appointments: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """J10 + J11: cancellation requests -> accepted (status, notes) or rejection reason.

    ``requests``: request_id, patient_email, appointment_id, cancel_reason.
    """
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    u = users.select(F.lower(F.trim("email")).alias("__pe"), F.col("role").alias("__prole"))
    a = appointments.select(F.col("id").alias("appointment_id"), F.col("patient_email").alias("__owner"),
                            F.col("status").alias("__status"), F.col("scheduled_for").alias("__when"),
                            F.col("notes").alias("__notes"))
    r = requests.withColumn("__pe", F.lower(F.trim("patient_email"))).join(u, "__pe", "left")
    r = r.join(a, "appointment_id", "left")
    st = F.lower(F.coalesce("__status", F.lit("Pending")))
    reason = (F.when(F.col("__prole").isNull() | (F.col("__prole") != "patient"), F.lit(BE["no_patient"]))
              .when(F.col("__owner").isNull() | (F.lower(F.trim("__owner")) != F.col("__pe")),
                    F.lit(BE["no_appointment"]))
              .when(st.isin("cancelled", "canceled", "completed"), F.lit(BE["not_cancellable"]))
              .when(F.col("__when") < now, F.lit(BE["past"])))
    accepted = reason.isNull()
    cr = F.trim(F.coalesce("cancel_reason", F.lit("")))
    existing = F.trim(F.coalesce("__notes", F.lit("")))
    prefix = F.concat(F.lit(BE["cancel_prefix"]), cr)
    new_notes = F.when(cr != "", F.substring(F.when(existing == "", prefix).otherwise(
        F.concat(existing, F.lit("\n"), prefix)), 1, 1000))
    return r.select(
        "request_id", "appointment_id", accepted.alias("accepted"), reason.alias("reject_reason"),
        F.when(accepted, F.lit("Cancelled")).otherwise(F.col("__status")).alias("status"),
        F.when(accepted, F.coalesce(new_notes, F.col("__notes"))).otherwise(F.col("__notes")).alias("notes"))


def update_status(appointments: DataFrame, updates: DataFrame) -> DataFrame:
    """The stored table after status updates (id, status, notes, update_id).

    Updates of one appointment apply in ``update_id`` order: the last status
    stands, and a NULL note leaves the stored one as it is.
    """
    order = F.col("update_id")
    last = updates.groupBy(F.col("id").alias("__id")).agg(
        F.max_by("status", order).alias("__status"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), order)).alias("__notes"), F.lit(True).alias("__hit"))
    out = appointments.join(last, appointments["id"] == last["__id"], "left")
    new = {"status": F.when(F.col("__hit"), F.col("__status")).otherwise(F.col("status")),
           "notes": F.coalesce("__notes", "notes")}
    return out.withColumns(new).select(*appointments.columns)


# ------------------------------------------------- history

# The 15 tracked health-detail fields, in audit order.
TRACKED_FIELDS = [
    "age", "gender", "symptoms", "symptom_count", "height_cm", "weight_kg", "bmi", "smoking_habit", "alcohol_habit",
    "average_sleep_hours", "medical_history", "family_history_major_chronic_disease", "glucose", "glucose_type",
    "blood_pressure",
]
NUMERIC_FIELDS = {"age", "symptom_count", "height_cm", "weight_kg", "bmi", "average_sleep_hours", "glucose"}


def audit_value(struct_col: str, field: str) -> Column:
    """Trim strings (blank -> NULL); numbers as float. Returned as text."""
    c = F.col(f"{struct_col}.{field}")
    if field in NUMERIC_FIELDS:
        return c.cast("double").cast("string")
    t = F.trim(c)
    return F.when(t != "", t)


def display_value(text: Column, field: str) -> Column:
    """J16 ``auditText``: NULL/blank -> '-', whole floats without '.0'."""
    if field in NUMERIC_FIELDS:
        x = text.cast("double")
        return F.when(text.isNull(), "-").when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(text)
    return F.when(text.isNull() | (text == ""), "-").otherwise(text)


def field_changes(before: str, after: str) -> Column:
    """array<struct<field, from, to>> of tracked fields whose audit values differ."""
    items = []
    for f in TRACKED_FIELDS:
        old = audit_value(before, f) if before else F.lit(None).cast("string")
        new = audit_value(after, f)
        items.append(F.when(~old.eqNullSafe(new), F.struct(F.lit(f).alias("field"), old.alias("from"),
                                                             new.alias("to"))))
    return non_null(*items)  # fields differ, so no two items are equal


def snapshot(struct_col: str) -> Column:
    """Map of tracked fields that are non-null and non-empty (as text)."""
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in TRACKED_FIELDS]),
                              F.array(*[F.col(f"{struct_col}.{f}").cast("string") for f in TRACKED_FIELDS]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def record_changes(submissions: DataFrame) -> DataFrame:
    """J17 / T3 batch twin: audit event per submission vs the previous one (lag).

    The first submission of a patient diffs against an empty document.  Only
    submissions with at least one change produce an event.  The previous
    version comes from ``previous_in_key`` (skew-safe distributed lag).
    """
    d = parse_details(submissions.withColumn("email", email_key("email")).filter(F.col("email") != ""))
    # distributed lag (see ordinals.previous_in_key): no window per patient
    d = previous_in_key(d, "email", "submitted_at", "id", ["d", "id"]).withColumnRenamed("prev_d", "prev")
    d = d.withColumn("changes", F.when(F.col("prev").isNull(), field_changes(None, "d"))
                     .otherwise(field_changes("prev", "d")))
    return d.filter(F.size("changes") > 0).select(
        F.col("email").alias("patient_email"), F.col("id").alias("event_id"), "prev_id",
        F.col("submitted_at").alias("changed_at"), F.col("email").alias("changed_by_email"),
        F.lit("patient").alias("changed_by_role"), F.lit("patient_form").alias("source"), "changes",
        F.when(F.col("prev").isNull(), F.create_map().cast("map<string,string>")).otherwise(snapshot("prev"))
        .alias("before"), snapshot("d").alias("after"))


def history_top_n(events: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` events per patient, newest first (WindowGroupLimit)."""
    w = Window.partitionBy("patient_email").orderBy(F.desc("changed_at"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def change_lines(events: DataFrame, n_events: int = 10, n_changes: int = 20) -> DataFrame:
    """History feed lines for the latest events, first changes of each."""
    top = history_top_n(events, n_events)
    ex = top.select("patient_email", "event_id", "rn", F.posexplode(F.slice("changes", 1, n_changes)).alias("pos", "c"))
    text = None
    for f in TRACKED_FIELDS:
        pair = F.concat(display_value(F.col("c.from"), f), F.lit(" -> "), display_value(F.col("c.to"), f))
        text = F.when(F.col("c.field") == f, pair) if text is None else text.when(F.col("c.field") == f, pair)
    return ex.select("patient_email", "event_id", "rn", (F.col("pos") + 1).alias("pos"),
                     F.concat(F.lit("  - "), F.col("c.field"), F.lit(": "), text).alias("line"))


def merge_patch(current: DataFrame, patches: DataFrame, users: DataFrame) -> DataFrame:
    """Clinical updates merged into the whole stored document, in (submitted_at, id) order.

    Sequential "non-null overwrites" equals, per field, the latest non-null
    patch value (else the stored one); ``max_by`` with a NULL ordering key for
    NULL values computes it as a partial aggregate.  ``current``: email + ``d``;
    ``patches``: email, submitted_at, id and patch columns.  Accounts without a
    stored document start from an empty one; patches without an account are
    refused.  ``changed_fields``: tracked fields whose audit values differ.
    """
    order = F.struct("submitted_at", "id")
    sym = F.trim(F.col("p_symptoms"))
    p = patches.select(
        email_key("email").alias("email"), "submitted_at", "id",
        F.col("p_age").alias("age"),
        F.when(F.trim("p_gender") != "", F.trim("p_gender")).alias("gender"),
        sym.alias("symptoms"),
        F.when(sym.isNotNull(), F.size(F.filter(F.transform(F.split(sym, "[,;|\\n]+"), lambda x: F.trim(x)),
                                                lambda x: x != ""))).alias("symptom_count"),
        F.col("p_height_cm").alias("height_cm"), F.col("p_weight_kg").alias("weight_kg"),
        F.col("p_bmi").alias("bmi"), F.col("p_glucose").alias("glucose"),
        F.col("p_glucose_type").alias("glucose_type"),
        F.when(F.col("p_systolic").isNotNull() & F.col("p_diastolic").isNotNull(),
               F.concat(F.bround("p_systolic").cast("bigint").cast("string"), F.lit("/"),
                        F.bround("p_diastolic").cast("bigint").cast("string"))).alias("blood_pressure"),
    )
    patched = [c for c in p.columns if c not in ("email", "submitted_at", "id")]
    agg = p.groupBy("email").agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f"__p_{f}") for f in patched],
        F.min("submitted_at").alias("__first_at"), F.max("submitted_at").alias("__updated_at"))
    agg = agg.join(users.select(email_key("email").alias("email")).distinct(), "email", "left_semi")
    out = agg.join(current.select("email", "d"), "email", "left")
    cols = [(F.coalesce(F.col(f"__p_{f}"), F.col(f"d.{f}")) if f in patched else F.col(f"d.{f}")).alias(f)
            for f in TRACKED_FIELDS]
    stored = F.trim(F.col("d.submitted_at"))
    out = out.select("email", "d", F.struct(*cols).alias("after"),
                     F.when(stored != "", F.col("d.submitted_at")).otherwise(F.date_format(
                         "__first_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("submitted_at"),
                     F.col("__updated_at").alias("updated_at"))
    changed = F.array_compact(F.array(*[
        F.when(~audit_value("after", f).eqNullSafe(audit_value("d", f)), F.lit(f)) for f in TRACKED_FIELDS]))
    return out.select("email", "after.*", "submitted_at", "updated_at", changed.alias("changed_fields"))


def protected_form_fold(feed: DataFrame) -> DataFrame:
    """Stored glucose / blood pressure under patient re-submissions.

    A patient form keeps the previous stored glucose and blood_pressure; only
    clinical updates set them.  The ordered fold equals the last non-null value
    written by a clinical row up to each row, computed with the blocked
    carry-forward of ``ordinals.last_non_null_in_key`` (no window per patient).
    ``feed``: email, submitted_at, id, source, glucose, blood_pressure.
    """
    clinical = F.col("source") == "clinical_update"
    out = last_non_null_in_key(
        feed.withColumn("email", email_key("email")), "email", "submitted_at", "id",
        {"stored_glucose": F.when(clinical, F.col("glucose")),
         "stored_blood_pressure": F.when(clinical, F.col("blood_pressure"))})
    return out.select("email", "submitted_at", "id", "source", "stored_glucose", "stored_blood_pressure")
