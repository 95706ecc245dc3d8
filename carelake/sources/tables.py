"""Readers for the driver parquet tables.

Every reader returns a lazy DataFrame; column pruning and filter pushdown are
left to Catalyst (the scans show ``ReadSchema``/``PushedFilters`` in explain).
``timestamp_ntz`` columns are cast to session-zone ``timestamp`` (UTC) once,
here, so every operator sees one timestamp type.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    casts = []
    changed = False
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            casts.append(F.col(field.name).cast("timestamp").alias(field.name))
            changed = True
        else:
            casts.append(F.col(field.name))
    return df.select(*casts) if changed else df
