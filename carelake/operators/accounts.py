"""Account-table operators: validation, uniqueness, renumbering, seeding,
integrity audit, cascade delete, legacy import and table inventory
(J31, J33-J39, S10, S11, S13-S15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import ACCOUNT_ERRORS
from .ordinals import ordinal_among
from .records import email_error, name_error, phone_error, role_error

ALLOWED_ROLES = ["patient", "nurse", "doctor"]


def safe_role(role: Column) -> Column:
    """J35 safe_normalize_role: invalid -> patient."""
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.when(r.isin(ALLOWED_ROLES), r).otherwise("patient")


def validate_users(users: DataFrame) -> DataFrame:
    """Per-row validation errors (email, phone, name, role) in check order."""
    errs = F.array_compact(F.array(name_error(F.col("full_name")), email_error(F.col("email")),
                                   phone_error(F.col("phone")), role_error(F.col("role"))))
    return users.select("id", "email", errs.alias("errors"), (F.size(errs) == 0).alias("valid"))


# Range / length limits of the scoring request.
REQUEST_LIMITS = [
    ("age", "age", 0, 120),
    ("glucose", "glucose", 0, None),
    ("systolic_bp", "systolic_bp", 0, None),
    ("diastolic_bp", "diastolic_bp", 0, None),
    ("bmi", "bmi", 0, None),
]


def validate_requests(requests: DataFrame) -> DataFrame:
    """Violations of the scoring request model as an array of field names."""
    checks = []
    for name, col, lo, hi in REQUEST_LIMITS:
        c = F.col(col)
        bad = c.isNull() | (c < lo)
        if hi is not None:
            bad = bad | (c > hi)
        checks.append(F.when(bad, F.lit(name)))
    checks.append(F.when(~F.coalesce(F.col("glucose_type").isin("fasting", "random"), F.lit(False)),
                         F.lit("glucose_type")))
    checks.append(F.when(F.col("gender").isNull(), F.lit("gender")))
    checks.append(F.when(F.col("symptoms").isNull(), F.lit("symptoms")))
    v = F.array_compact(F.array(*checks))
    return requests.select("request_id", v.alias("violations"), (F.size(v) == 0).alias("valid"))


# Fixed values (J36): the fields of each form with kind, whether required, least and
# largest value (numbers) or length (texts); "above" excludes the least value.
FORM_RULES = {
    "health_details": [
        ("email", "text", True, 5, 254), ("age", "number", True, 0, 120), ("gender", "text", True, 1, 50),
        ("symptoms", "text", True, 1, 1000), ("symptom_count", "number", True, 0, 100),
        ("glucose", "number", False, 0, None), ("blood_pressure", "text", False, None, 30),
        ("height_cm", "above", True, 0, 300), ("weight_kg", "above", True, 0, 500), ("bmi", "above", True, 0, 100),
        ("smoking_habit", "text", True, 1, 50), ("alcohol_habit", "text", True, 1, 50),
        ("average_sleep_hours", "number", True, 0, 24), ("medical_history", "text", False, None, 2000),
        ("family_history_major_chronic_disease", "text", True, 1, 100),
    ],
    "record_update": [
        ("patient_email", "text", True, 5, 254), ("updated_by_email", "text", True, 5, 254),
        ("age", "number", False, 0, 120), ("gender", "text", False, None, 50), ("height_cm", "above", False, 0, 300),
        ("weight_kg", "above", False, 0, 500), ("bmi", "above", False, 0, 100), ("glucose", "number", False, 0, None),
        ("systolic_bp", "number", False, 0, None), ("diastolic_bp", "number", False, 0, None),
    ],
    "booking": [
        ("patient_email", "text", True, 5, 254), ("scheduled_for", "text", True, 10, 64),
        ("appointment_type", "text", True, 2, 100), ("contact_info", "text", True, 3, 200),
        ("doctor_email", "text", False, None, 254), ("reason", "text", False, 2, 200), ("notes", "text", False, None, 1000),
    ],
    "cancel": [
        ("patient_email", "text", True, 5, 254), ("appointment_id", "number", True, 1, None),
        ("cancel_reason", "text", False, None, 200),
    ],
    "leave": [
        ("doctor_email", "text", True, 5, 254), ("start_at", "text", True, 10, 64), ("end_at", "text", True, 10, 64),
        ("reason", "text", False, None, 200),
    ],
}
# Fields that must be one of a few words when given.
FORM_CHOICES = {"record_update": {"updated_by_role": ("nurse", "doctor"), "glucose_type": ("fasting", "random")}}


def validate_form(rows: DataFrame, form: str, key: str = "request_id") -> DataFrame:
    """Violations of a form's model as an array of field names; absent columns count as missing."""
    checks = []
    for field, kind, required, low, high in FORM_RULES[form]:
        if field not in rows.columns:
            checks += [F.lit(field)] if required else []
            continue
        value = F.length(F.col(field).cast("string")) if kind == "text" else F.col(field).cast("double")
        bad = F.col(field).isNull() & F.lit(required)
        if low is not None:
            bad = bad | (value <= low if kind == "above" else value < low)
        if high is not None:
            bad = bad | (value > high)
        checks.append(F.when(bad, F.lit(field)))
    for field, words in FORM_CHOICES.get(form, {}).items():
        if field in rows.columns:
            checks.append(F.when(F.col(field).isNotNull() & ~F.col(field).isin(*words), F.lit(field)))
    v = F.array_compact(F.array(*checks))
    return rows.select(key, v.alias("violations"), (F.size(v) == 0).alias("valid"))


def registration_uniqueness(batch: DataFrame, store: DataFrame, order_col: str = "id") -> DataFrame:
    """Registration batch, first wins within the batch, unique against the store.

    Check order of the reference: name, email, phone, role, then email taken,
    then phone taken.  Uniqueness uses the normalised email / phone.  "First
    wins" keeps the earliest valid request per key; later duplicates reject.
    """
    b = batch.select(
        order_col, "full_name", "email", "phone", "role",
        F.trim(F.regexp_replace(F.coalesce("full_name", F.lit("")), r"(?U)\s+", " ")).alias("__name"),
        F.lower(F.trim("email")).alias("__email"), F.trim(F.coalesce("phone", F.lit(""))).alias("__phone"))
    fmt = F.coalesce(name_error(F.col("full_name")), email_error(F.col("email")), phone_error(F.col("phone")),
                     role_error(F.col("role")))
    b = b.withColumn("__fmt", fmt)
    valid = b.filter(F.col("__fmt").isNull())
    # earliest valid request per email / phone (partial aggregates, skew-safe)
    first_email = valid.groupBy("__email").agg(F.min(order_col).alias("__first_e"))
    first_phone = valid.groupBy("__phone").agg(F.min(order_col).alias("__first_p"))
    st_email = store.select(F.lower(F.trim("email")).alias("__email")).distinct().withColumn("__se", F.lit(True))
    st_phone = (store.select(F.trim("phone").alias("__phone")).filter(F.col("__phone").isNotNull() & (F.col("__phone") != ""))
                .distinct().withColumn("__sp", F.lit(True)))
    b = b.join(first_email, "__email", "left").join(first_phone, "__phone", "left")
    b = b.join(st_email, "__email", "left").join(st_phone, "__phone", "left")
    reason = F.coalesce(
        F.col("__fmt"),
        F.when(F.col("__se") | (F.col("__first_e") < F.col(order_col)),
               F.lit(ACCOUNT_ERRORS["email_taken"])),
        F.when(F.col("__sp") | (F.col("__first_p") < F.col(order_col)),
               F.lit(ACCOUNT_ERRORS["phone_taken"])))
    return b.select(order_col, F.col("__email").alias("email"), F.col("__phone").alias("phone"),
                    reason.isNull().alias("accepted"), reason.alias("reject_reason"))


def renumber_ids(users: DataFrame) -> DataFrame:
    """Per role, renumber 1..n by (id, NULL ids last, then email); flag changes."""
    d = users.withColumn("__role", safe_role(F.col("role"))).withColumn(
        "__sort_id", F.coalesce(F.col("id"), F.lit(1_000_000_000))).withColumn("__email", F.lower(F.trim("email")))
    d = ordinal_among(d, "__sort_id", F.lit(True), "new_id", partition_cols=["__role"], tiebreak=["__email"])
    return d.select("email", F.col("__role").alias("role"), F.col("id").alias("old_id"), "new_id",
                    (~F.col("id").eqNullSafe(F.col("new_id"))).alias("changed"))


def seed_accounts(spark: SparkSession) -> DataFrame:
    """Demo accounts the reference adds when their email is absent."""
    # Demo accounts (passwords not carried).
    rows = [(1, "Patient Demo", "patient@example.com", "patient"),
            (2, "Nurse Demo", "nurse@example.com", "nurse"),
            (3, "Doctor Demo", "doctor@example.com", "doctor")]
    return spark.createDataFrame(rows, "id BIGINT, full_name STRING, email STRING, role STRING")


def seed_union(users: DataFrame, seeds: DataFrame) -> DataFrame:
    """Users plus seed accounts whose email is absent (left anti + union)."""
    u = users.select("id", "full_name", F.lower(F.trim("email")).alias("email"), "role").withColumn(
        "source", F.lit("existing"))
    s = seeds.select("id", "full_name", F.lower(F.trim("email")).alias("email"), "role").withColumn(
        "source", F.lit("seed"))
    missing = s.join(u.select("email"), "email", "left_anti")
    return u.unionByName(missing)


def integrity_audit(users: DataFrame, appts: DataFrame, subs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Constraint checks as counts (orphans, duplicate keys, bad roles, bad intervals)."""
    ue = users.select(F.lower(F.trim("email")).alias("__e")).distinct()
    orphan_appts = appts.join(ue, F.lower(F.trim(appts["patient_email"])) == ue["__e"], "left_anti")
    orphan_subs = subs.join(ue, F.lower(F.trim(subs["email"])) == ue["__e"], "left_anti")
    dup_email = users.groupBy(F.lower(F.trim("email")).alias("k")).count().filter("count > 1")
    dup_phone = (users.filter(F.col("phone").isNotNull()).groupBy(F.trim("phone").alias("k")).count()
                 .filter("count > 1"))
    bad_role = users.filter(~F.coalesce(F.col("role").isin(ALLOWED_ROLES), F.lit(False)))
    bad_leave = leaves.filter(F.col("end_at") < F.col("start_at"))
    checks = [
        ("orphan_appointments", orphan_appts.agg(F.count(F.lit(1)).alias("n"))),
        ("orphan_submissions", orphan_subs.agg(F.count(F.lit(1)).alias("n"))),
        ("duplicate_emails", dup_email.agg(F.count(F.lit(1)).alias("n"))),
        ("duplicate_phones", dup_phone.agg(F.count(F.lit(1)).alias("n"))),
        ("rows_in_duplicate_phones", dup_phone.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("n"))),
        ("bad_roles", bad_role.agg(F.count(F.lit(1)).alias("n"))),
        ("leave_end_before_start", bad_leave.agg(F.count(F.lit(1)).alias("n"))),
    ]
    out = None
    for name, df in checks:
        df = df.select(F.lit(name).alias("check_name"), "n")
        out = df if out is None else out.unionByName(df)
    return out


def cascade_delete(deleted: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Remove rows of dependent tables whose key is a deleted user email.

    ``tables`` maps name -> (frame, email column); audit history is not passed
    (it survives user deletion).
    """
    keys = deleted.select(F.lower(F.trim("email")).alias("__del")).distinct()
    return {name: df.join(keys, F.lower(F.trim(df[col])) == keys["__del"], "left_anti")
            for name, (df, col) in tables.items()}


def bootstrap_import(files: list[DataFrame]) -> DataFrame:
    """Union legacy user files in order; first row per email wins; rows
    without a password hash are skipped (after the first-wins check)."""
    out = None
    for i, f in enumerate(files):
        d = f.select(F.lit(i).alias("__file"), "__row", "full_name", "email", "phone", "role", "password_hash")
        out = d if out is None else out.unionByName(d)
    out = out.withColumn("__email", F.lower(F.trim(F.coalesce("email", F.lit(""))))).filter(F.col("__email") != "")
    first = out.groupBy("__email").agg(F.min_by(F.struct("__file", "__row", "full_name", "phone", "role",
                                                         "password_hash"),
                                                F.struct("__file", "__row")).alias("b"))
    first = first.filter(F.trim(F.coalesce("b.password_hash", F.lit(""))) != "")
    return first.select(
        F.col("__email").alias("email"),
        F.trim(F.coalesce(F.when(F.trim("b.full_name") != "", F.col("b.full_name")), F.col("__email"))).alias("full_name"),
        F.trim(F.coalesce("b.phone", F.lit(""))).alias("phone"), safe_role(F.col("b.role")).alias("role"),
        F.col("b.__file").alias("source_file"), F.col("b.__row").alias("source_row"))


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count (one aggregate each)."""
    out = None
    for name, df in tables.items():
        d = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = d if out is None else out.unionByName(d)
    return out


def truthy_count(df: DataFrame, column: str, truthy: list[str]) -> DataFrame:
    """Count of values in ``truthy`` (trim, lower); 0 when the column is absent."""
    if column not in df.columns:
        return df.agg(F.lit(0).cast("bigint").alias("n")).select(F.lit(column).alias("column_name"), "n")
    return df.agg(F.count_if(F.lower(F.trim(F.col(column))).isin(truthy)).alias("n")).select(
        F.lit(column).alias("column_name"), "n")
