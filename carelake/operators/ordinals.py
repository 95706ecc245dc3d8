"""Distributed ordinal numbering (no single-partition global window).

``row_number().over(Window.orderBy(x))`` moves every row into one task.  Here
rows are cut into fixed-width blocks of the ordering key; each block is
numbered inside its own window partition, and a tiny per-block count table
(one row per block) supplies the running offset.  Work per task is bounded by
the block width, and the offset table by key_range / block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 20


def ordinal_among(df: DataFrame, order_col: str, cond: Column, out: str, partition_cols: list[str] | None = None,
                  block: int = DEFAULT_BLOCK, tiebreak: list[str] | None = None,
                  total_out: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based rank of each row satisfying ``cond`` in ``order_col``
    order (within ``partition_cols`` if given); NULL for rows not satisfying it.

    ``order_col`` must be integral.  ``tiebreak`` columns make equal keys total.
    """
    parts = list(partition_cols or [])
    flag = "__ord_flag"
    blk = "__ord_block"
    d = df.withColumn(flag, F.when(cond, 1).otherwise(0)).withColumn(blk, F.floor(F.col(order_col) / block))
    counts = d.groupBy(*parts, blk).agg(F.sum(flag).alias("__ord_n"))
    w_off = Window.partitionBy(*parts).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    extra = []
    if total_out:  # rows satisfying cond in the whole partition, from the same block counts
        extra = [F.sum("__ord_n").over(Window.partitionBy(*parts)).alias(total_out)]
    offsets = counts.select(*parts, blk, F.coalesce(F.sum("__ord_n").over(w_off), F.lit(0)).alias("__ord_off"),
                            *extra)
    order = [F.col(order_col)] + [F.col(c) for c in (tiebreak or [])]
    w_in = Window.partitionBy(*parts, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("__ord_local", F.sum(flag).over(w_in))
    joined = local.join(offsets, on=parts + [blk], how="inner")
    return joined.withColumn(out, F.when(F.col(flag) == 1, F.col("__ord_off") + F.col("__ord_local"))).drop(
        flag, blk, "__ord_local", "__ord_off")


def previous_in_key(df: DataFrame, key: str, ts_col: str, id_col: str, cols: list[str],
                    block_seconds: int = 3600) -> DataFrame:
    """Distributed ``lag``: attach ``prev_<c>`` (the key's previous row in
    (ts, id) order) without a window partitioned by the key alone.

    Rows get a per-key ordinal from ``ordinal_among`` over time blocks (work per
    task bounded by one key's rows in one block), then each row is joined to
    the row with ordinal - 1: the join key (key, ordinal) is unique per row, so
    a key holding a large share of all rows does not concentrate in one task.
    """
    d = df.withColumn("__us", F.unix_micros(F.col(ts_col)))
    d = ordinal_among(d, "__us", F.lit(True), "__ord", partition_cols=[key], block=block_seconds * 1_000_000,
                      tiebreak=[id_col]).drop("__us")
    prev = d.select(F.col(key).alias("__pk"), (F.col("__ord") + 1).alias("__pord"),
                    *[F.col(c).alias(f"prev_{c}") for c in cols])
    out = d.join(prev, (d[key] == prev["__pk"]) & (d["__ord"] == prev["__pord"]), "left")
    return out.drop("__pk", "__pord")


def last_non_null_in_key(df: DataFrame, key: str, ts_col: str, id_col: str, values: dict[str, Column],
                         block_seconds: int = 3600) -> DataFrame:
    """Distributed ``last(value, ignorenulls) OVER (PARTITION BY key ORDER BY ts, id
    ROWS UNBOUNDED PRECEDING)`` for each named value expression.

    Inside each (key, time block) a running last-non-null is computed; the
    carry from earlier blocks comes from a per-(key, block) table of each
    block's last non-null value (``max_by`` with a NULL ordering key for NULL
    values), folded over blocks -- one row per key and block, never one task
    per key.
    """
    blk = "__lnn_blk"
    order = F.struct(F.col(ts_col), F.col(id_col))
    d = df.withColumn(blk, F.floor(F.unix_seconds(F.col(ts_col)) / block_seconds))
    for name, expr in values.items():
        d = d.withColumn(f"__v_{name}", expr)
    per_block = d.groupBy(key, blk).agg(*[
        F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), order)).alias(f"__b_{n}")
        for n in values])
    w_prev = Window.partitionBy(key).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(key, blk, *[F.last(f"__b_{n}", ignorenulls=True).over(w_prev).alias(f"__c_{n}")
                                         for n in values])
    w_in = Window.partitionBy(key, blk).orderBy(ts_col, id_col).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.last(f"__v_{n}", ignorenulls=True).over(w_in).alias(f"__l_{n}") for n in values])
    out = local.join(carry, [key, blk], "inner")
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")))
    return out.drop(blk, *[f"__{p}_{n}" for p in ("v", "l", "c") for n in values])
