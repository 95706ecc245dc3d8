"""File sources and sinks as Spark readers / writers.

Desktop concerns of the reference (locked-file rename retries, temp-file
swaps) are replaced by Spark's job commit protocol: an output folder appears
complete or not at all.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.accounts import safe_role


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_csv_typed(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """Headed CSV read as text, then ``try_cast`` per declared type (bad -> NULL).
    A missing path raises (as the reference does)."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    cols = [F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns]
    return raw.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV, no index, overwrite."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S3: all-string rows; a missing file gives an empty frame with the columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def write_csv_rows(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed field order, NULL -> empty text."""
    out = df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns
                      else F.lit("").alias(f) for f in fields])
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON array files -> rows.  Missing or blank -> empty; a top-level value
    that is not an array, or text that is not JSON, is an error."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], st)
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    parsed = text.filter(F.col("v") != "").select("v", F.from_json("v", T.ArrayType(st)).alias("rows"))
    if parsed.filter(~F.col("v").startswith("[") | F.col("rows").isNull()).limit(1).count():
        raise ValueError(f"{path} must contain a JSON array.")
    return parsed.select(F.explode("rows").alias("r")).select("r.*")


ARRAY_ROWS = 10_000  # rows of one JSON array file


def write_json_array(df: DataFrame, path: str) -> None:
    """Rows as JSON array files of at most ``ARRAY_ROWS`` rows each, committed by the job."""
    numbered = df.select(F.struct(*df.columns).alias("r"), F.spark_partition_id().alias("p"),
                         F.floor(F.monotonically_increasing_id() / ARRAY_ROWS).alias("k"))
    arrays = numbered.groupBy("p", "k").agg(F.collect_list("r").alias("rows"))
    arrays.select(F.to_json("rows", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option(
        "maxRecordsPerFile", 1).text(path)


USERS_CSV_FIELDS = ["id", "full_name", "email", "phone", "role", "salt", "password_hash", "health_details"]


def read_users_csv(spark: SparkSession, path: str, details_schema: str) -> DataFrame:
    """Users file; bad id -> NULL, bad/non-object JSON -> NULL, blank role -> patient."""
    raw = read_csv_rows(spark, path, USERS_CSV_FIELDS)
    hd = F.trim(F.coalesce("health_details", F.lit("")))
    doc = F.when(hd.startswith("{"), F.from_json(hd, details_schema))
    role = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit("patient")).otherwise(safe_role(F.col("role")))
    return raw.select(
        F.col("id").try_cast("int").alias("id"), F.trim(F.coalesce("full_name", F.lit(""))).alias("full_name"),
        F.lower(F.trim(F.coalesce("email", F.lit("")))).alias("email"),
        F.trim(F.coalesce("phone", F.lit(""))).alias("phone"), role.alias("role"),
        F.trim(F.coalesce("salt", F.lit(""))).alias("salt"),
        F.trim(F.coalesce("password_hash", F.lit(""))).alias("password_hash"), doc.alias("health_details"))


def write_users_csv(users: DataFrame, path: str) -> None:
    """Users file; phone kept raw when malformed, details as JSON text."""
    phone = F.trim(F.coalesce("phone", F.lit("")))
    hd = F.to_json("health_details") if "health_details" in users.columns else F.lit("")
    out = users.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce("full_name", F.lit("")).alias("full_name"),
        F.lower(F.trim(F.coalesce("email", F.lit("")))).alias("email"), phone.alias("phone"),
        safe_role(F.col("role")).alias("role"),
        F.coalesce(F.col("salt") if "salt" in users.columns else F.lit(""), F.lit("")).alias("salt"),
        F.coalesce(F.col("password_hash") if "password_hash" in users.columns else F.lit(""), F.lit(""))
        .alias("password_hash"),
        F.coalesce(hd, F.lit("")).alias("health_details"))
    write_csv_rows(out, path, USERS_CSV_FIELDS)


def export_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Every table written under ``folder`` (re-aim of the SQL text dump)."""
    out = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).option("header", True).save(path)
        out[name] = path
    return out


def row_count(spark: SparkSession, path: str, fmt: str = "csv") -> int:
    """Rows of a dataset, 0 when it cannot be read."""
    try:
        return spark.read.format(fmt).option("header", True).load(path).count()
    except Exception:  # unreadable dataset counts as empty, as in the reference
        return 0


def table_count(spark: SparkSession, name: str) -> int:
    """Catalog table / view count, 0 when missing."""
    try:
        return spark.table(name).count()
    except Exception:
        return 0


def save_model(model, path: str, spark: SparkSession) -> None:
    """Fitted pipeline + fill values and label order (one small JSON row)."""
    model.save(f"{path}/pipeline")
    meta = {"numeric": model.numeric, "categorical": model.categorical, "modes": model.modes,
            "labels": model.labels}
    spark.createDataFrame([(json.dumps(meta),)], "meta STRING").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    """Load what ``save_model`` wrote."""
    from pyspark.ml import PipelineModel

    from ..operators.model import RiskModel

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    pm = PipelineModel.load(f"{path}/pipeline")
    return RiskModel(pm, meta["numeric"], meta["categorical"], meta["modes"], meta["labels"])
