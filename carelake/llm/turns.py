"""Turns of conversations in order (helper of operators 11 and 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"


def turn_digest(role: Column, text: Column) -> Column:
    """128-bit name of a role and a text, unlike any other pair's."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def numbered(rows: DataFrame, group: str, order: list[Column], out: str, label: str) -> DataFrame:
    """``rows`` and ``out``: the row's number, from 1, in ``order`` inside its group.

    All rows are sorted by range, so a group of any size is cut at range borders;
    every range numbers its own rows, and the sizes of a group's pieces, one row
    per group and range, give what stands before.  Rows that tie are numbered in any
    order, and are spread over ranges by a hash of their place of reading.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    keyed = rows.withColumn("spread", spread)
    placed = stored(keyed.repartitionByRange(group, *order, "spread").sortWithinPartitions(group, *order, "spread")
                    .drop("spread").withColumn("place", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("range", F.shiftright("place", 33))
    pieces = placed.groupBy(F.col(group).alias("of"), F.col("range").alias("in_range")).agg(
        F.min("place").alias("begin"), F.count("*").alias("size"))
    before = Window.partitionBy("of").orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("of", "in_range", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("begin") + 1)
                           .alias("shift"))
    joined = placed.join(pieces, F.col(group).eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range")))
    return joined.withColumn(out, F.col("place") + F.col("shift")).drop("place", "range", "of", "in_range", "shift")
