"""A keyed table in the shared folder that changes in place, bucket by bucket.

Rows lie in ``buckets`` partitions by a hash of their key.  A change reads and writes
only the buckets that its keys fall in; the files of all others stay as they are.
Every new bucket is computed from files into a checkpoint before the old one goes, so
a lost executor repeats a task, and applying the same change again gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


class BucketedTable:
    """``key`` is one column; ``buckets`` should leave a bucket no larger than a task likes to rewrite."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path, key, buckets, schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(self.path))

    def create(self, rows: DataFrame) -> BucketedTable:
        self._write(rows.withColumn(BUCKET, self.bucket()))
        return self

    def _stored(self) -> DataFrame:
        whole = (f"{self.schema}, {BUCKET} int" if isinstance(self.schema, str)
                 else T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())]))
        if not self._fs().exists(self._path()):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def apply(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched buckets by ``change(their rows, changes)``; only keys of ``changes`` may
        appear anew.  The driver holds bucket numbers, at most ``buckets`` of them."""
        keyed = changes.withColumn(BUCKET, self.bucket())
        hit = sorted(r[0] for r in keyed.select(BUCKET).distinct().collect())
        if not hit:
            return
        current = self._stored().filter(F.col(BUCKET).isin(hit)).drop(BUCKET)
        new = change(current, changes).withColumn(BUCKET, self.bucket()).checkpoint(eager=True)
        filled = {r[0] for r in new.select(BUCKET).distinct().collect()}
        self._write(new)
        for b in hit:
            if b not in filled:  # a bucket without rows is not among what was written
                self._fs().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}"), True)

    def delete(self, keys: DataFrame) -> None:
        """Drop the rows whose key is in ``keys``."""
        self.apply(keys.select(self.key).distinct(), lambda rows, gone: rows.join(gone, self.key, "left_anti"))
