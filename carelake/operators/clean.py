"""Clean the raw patient table (whole table).

Global statistics come from one grouped pass: every row adds its values to
counts per (column, value), combined per task before the shuffle, and medians
and the mode are read from those counts by blocks of the value range, so no
task ever holds all distinct values.  The same pass counts the rows without an
id per block of the order column, which numbers them without a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_symptoms, gender_code, normalize_text, standardize_gender, standardize_symptoms
from .ordinals import DEFAULT_BLOCK

# Inclusive valid ranges; outside -> missing.
NUMERIC_LIMITS = {"Age": (0, 120), "Glucose": (40, 400), "BloodPressure": (30, 250), "BMI": (10, 80)}
# Columns read as numbers, and those filled with their median.
NUMERIC_COLUMNS = ["Patient_ID", "Age", "Glucose", "BloodPressure", "BMI"]
IMPUTED_COLUMNS = ["Age", "Glucose", "BloodPressure", "BMI"]
# Leading column order of the cleaned table.
ORDERED_COLUMNS = ["Patient_ID", "Age", "Gender", "Gender_Encoded", "Symptoms", "Symptom_Count", "Disease",
                   "Glucose", "BloodPressure", "BMI"]


def to_number(c: str):
    """Text -> double; unparseable or NaN -> NULL."""
    x = F.col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def coerce_numeric(df: DataFrame) -> DataFrame:
    """C1 + C2."""
    cols = []
    for c in df.columns:
        if c in NUMERIC_COLUMNS:
            x = to_number(c)
            if c in NUMERIC_LIMITS:
                lo, hi = NUMERIC_LIMITS[c]
                x = F.when(x.between(lo, hi), x)
            cols.append(x.alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


VALUE_BLOCKS = 4096


def value_counts(df: DataFrame, order_col: str) -> DataFrame:
    """(kind, num, text, n, top): how often each value of a filled column occurs,
    rows without an id per block of ``order_col``, and the largest id; one pass.

    Kept in the checkpoint folder, as several statistics read it.
    """
    def entry(kind: str, num: Column | None = None, text: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if num is None else num).cast("double").alias("num"),
                        (F.lit(None) if text is None else text).cast("string").alias("text"))

    entries = [entry(c, F.col(c)) for c in IMPUTED_COLUMNS if c in df.columns]
    top = F.lit(None).cast("double")
    if "Disease" in df.columns:
        entries.append(entry("Disease", text=F.col("Disease")))
    if "Patient_ID" in df.columns:
        block = F.coalesce(F.floor(F.col(order_col) / DEFAULT_BLOCK), F.lit(-1))
        entries.append(entry("no_id", F.when(F.col("Patient_ID").isNull(), block)))
        top = F.col("Patient_ID")
    counted = df.select(F.explode(F.array(*entries)).alias("e"), top.alias("id")).groupBy("e.kind", "e.num", "e.text")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).checkpoint()


def medians(counts: DataFrame) -> DataFrame:
    """(kind, median) from value counts: running totals over blocks of each
    column's valid range, then over the values of the blocks themselves."""
    limits = F.create_map(*[F.lit(x) for c, (lo, hi) in NUMERIC_LIMITS.items() for x in (c, F.struct(
        F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))])
    own = limits[F.col("kind")]
    block = F.floor((F.col("num") - own["lo"]) / (own["hi"] - own["lo"]) * VALUE_BLOCKS)
    values = counts.filter(F.col("kind").isin(IMPUTED_COLUMNS) & F.col("num").isNotNull()).withColumn("block", block)
    before = Window.partitionBy("kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = values.groupBy("kind", "block").agg(F.sum("n").alias("bn")).select(
        "kind", "block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("offset"),
        F.sum("bn").over(Window.partitionBy("kind")).alias("total"))
    within = Window.partitionBy("kind", "block").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("upto", F.sum("n").over(within)).join(blocks, ["kind", "block"])
    last = F.col("offset") + F.col("upto")
    covers = lambda rank: ((rank > last - F.col("n")) & (rank <= last)).cast("int")
    middles = covers(F.floor((F.col("total") + 1) / 2)) + covers(F.floor((F.col("total") + 2) / 2))
    return ranked.groupBy("kind").agg((F.sum(F.col("num") * middles) / 2).alias("median"))


def global_stats(counts: DataFrame) -> DataFrame:
    """One-row frame: medians (C3), Disease mode (C10), whole part of the largest Patient_ID (C11)."""
    rows = counts.select("kind", F.lit(None).cast("double").alias("median"), "text", "n", "top").unionByName(
        medians(counts).select("kind", "median", F.lit(None).cast("string").alias("text"),
                               F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("top")))
    named = (F.col("kind") == "Disease") & F.col("text").isNotNull()
    return rows.agg(
        *[F.max(F.when(F.col("kind") == c, F.col("median"))).alias(f"__med_{c}") for c in IMPUTED_COLUMNS],
        F.min_by("text", F.when(named, F.struct(-F.col("n"), F.col("text")))).alias("__mode_Disease"),
        F.floor(F.max("top")).cast("double").alias("__max_id"))


def number_missing_ids(df: DataFrame, counts: DataFrame, order_col: str, top: Column, tiebreak: list[str]) -> DataFrame:
    """C11: rows without an id get the next ids in ``order_col`` order; other rows are not touched."""
    blocks = counts.filter((F.col("kind") == "no_id") & F.col("num").isNotNull()).select(
        F.col("num").cast("bigint").alias("__block"), F.coalesce(F.sum("n").over(
            Window.orderBy("num").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    missing = df.filter(F.col("Patient_ID").isNull()).withColumn(
        "__block", F.coalesce(F.floor(F.col(order_col) / DEFAULT_BLOCK), F.lit(-1)))
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(order_col, *tiebreak))
    numbered = missing.withColumn("__rank", rank).join(blocks, "__block").withColumn(
        "Patient_ID", F.coalesce(top, F.lit(0.0)) + F.col("__before") + F.col("__rank"))
    return numbered.select(*df.columns)


def clean_patients(raw: DataFrame, order_col: str = "seq", dedup: bool = True) -> DataFrame:
    """C17: C1-C4, C5-C10, C11, C12, C13, C14 on the whole table.

    C13 drops rows that equal an earlier one in every column but ``order_col``;
    the first in that order stays.  Rows whose id was missing have ids of their
    own by then, so only the others take part.
    """
    df = coerce_numeric(raw)
    if "Disease" in df.columns:
        df = df.withColumn("Disease", normalize_text("Disease"))
    counts = value_counts(df, order_col)
    # one aggregate row, used as a single struct-valued scalar subquery
    stats = global_stats(counts)
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    scalar = {c: one[c] for c in stats.columns}
    missing = None
    if "Patient_ID" in df.columns:
        missing = number_missing_ids(df, counts, order_col, scalar["__max_id"], [c for c in df.columns if c != order_col])
        df = df.filter(F.col("Patient_ID").isNotNull())
    fills = {c: F.coalesce(F.col(c), scalar[f"__med_{c}"]) for c in IMPUTED_COLUMNS if c in raw.columns}
    if "Age" in fills:
        fills["Age"] = F.bround(fills["Age"]).cast("int")
    if "Gender" in raw.columns:
        fills["Gender"] = standardize_gender("Gender")
    if "Symptoms" in raw.columns:
        fills["Symptoms"] = standardize_symptoms("Symptoms")
    if "Disease" in raw.columns:
        fills["Disease"] = F.coalesce(F.col("Disease"), scalar["__mode_Disease"], F.lit("Unknown"))

    def filled(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns(fills)
        if "Patient_ID" in rows.columns:
            rows = rows.withColumn("Patient_ID", F.bround("Patient_ID").cast("bigint"))
        if "Symptoms" in rows.columns:
            rows = rows.withColumn("Symptom_Count", count_symptoms("Symptoms"))
        if "Gender" in rows.columns:
            rows = rows.withColumn("Gender_Encoded", gender_code("Gender"))
        return rows

    df = filled(df)
    if dedup:
        names = df.columns
        df = df.groupBy(*[c for c in names if c != order_col]).agg(F.min(order_col).alias(order_col)).select(*names)
    if missing is not None:
        df = df.unionByName(filled(missing))
    lead = [c for c in ORDERED_COLUMNS if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def clean_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows in, rows out, duplicates removed (duplicates only come from C13)."""
    n_out = cleaned.agg(F.count(F.lit(1))).scalar()
    return raw.agg(F.count(F.lit(1)).alias("input_rows")).select(
        "input_rows", n_out.alias("output_rows"), (F.col("input_rows") - n_out).alias("duplicates_removed"))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and type per column, long form (one aggregate pass)."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, null_count)").withColumn(
        "data_type", F.element_at(types, F.col("column_name")))
