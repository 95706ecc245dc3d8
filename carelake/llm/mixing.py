"""Mixing sources to target weights by a multivariate-hypergeometric splitting
tree (operator 7).  DataFrame functions only.

Documents of a source fall into ``BLOCKS`` blocks by a keyed hash, so block
order is a random permutation of the source.  A source's target gives its quota
of block draws: every block once for each whole time the target holds the
source, then blocks in permuted order until the words are reached (the last one
cut at the document that comes nearest).  The splitting tree deals all draws to
the output shards: at each node a random half of the node's draws goes left,
without replacement, so the sources' counts on each side follow the multivariate
hypergeometric law and every shard gets its exact share of blocks.  Within a
shard rows are ordered by another keyed hash.

Tables of draws have at most 2 * BLOCKS rows a source, whatever the number of
documents; documents meet them in one equi-join, so no source is gathered in a
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import spare_name, stored

# Fixed values of the contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"

SEED = "mix-1"
BLOCK_DIGITS = 3  # hexadecimal digits of a block's number: 4096 blocks a source
BLOCKS = 16 ** BLOCK_DIGITS
LEAD_CHARS = 3  # hexadecimal digits of a lot that part a shard's draws for ranking
SHARD_LEVELS = 3  # 8 output shards
LAST = "g"  # above every hexadecimal digit


def keyed(docs: DataFrame, key: str, text: str, source: str, names: tuple[str, str, str, str]) -> DataFrame:
    """``docs`` with a draw key, its block, the size in words and the source under ``names``."""
    draw, block, size, origin = names
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    hashed = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("")),
                               F.coalesce(F.col(text), F.lit(""))))
    return (docs.withColumn(draw, hashed).withColumn(block, F.substring(draw, 1, BLOCK_DIGITS))
            .withColumn(size, words).withColumn(origin, F.col(source)))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with the weight by code point of the source (null
    last) and the target: SHARE of all sizes by weight, held to MOST_REPEATS times
    the source, the excess reshared by weight until none is above.

    The level at which the shares stop is found in one pass over the sources, by
    rising ratio of limit to weight: with the first k sources at their limits the
    others get (all - limits) / weights, and the first source whose ratio reaches
    that fixes it.  One row a source, as in the mix's specification."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("place", place).withColumn("weight", weights).withColumn(
        "most", F.lit(float(MOST_REPEATS)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(SHARE) * F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (total - below) / above).withColumn("at", F.row_number().over(order))
    level = F.min_by("level", F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("at"))).over(everything)
    return rows.withColumn("level", level).select(
        "source", "source_size", "weight",
        F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def quota(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """The draws (source, block, epoch, cut): a document of the block is drawn if
    its draw key is at most ``cut``."""
    blocks = narrow.groupBy("source", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    own = wanted.withColumnRenamed("source", "from")
    placed = (blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
              .join(own, F.col("source").eqNullSafe(F.col("from"))).withColumn("whole", whole)
              .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    part = F.when(F.col("before") + F.col("words") <= F.col("rest"), F.lit(LAST))
    edge = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    inside = narrow.withColumnRenamed("source", "of").withColumnRenamed("block", "in").join(
        edge, F.col("of").eqNullSafe(F.col("source")) & (F.col("in") == F.col("block")))
    keys = inside.groupBy("source", "block", "rest", "before", "draw").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    near = F.col("before") + F.coalesce(F.sum("words").over(running), F.lit(0)) + F.col("words") / 2
    cuts = keys.withColumn("middle", near).where("middle <= rest").groupBy("source", "block").agg(
        F.max("draw").alias("cut"))
    repeats = placed.select("source", "block", F.explode(F.expr(
        "CASE WHEN whole > 0 THEN sequence(1, CAST(whole AS INT)) ELSE array() END")).alias("epoch"),
        F.lit(LAST).alias("cut"))
    full = placed.where(part.isNotNull()).select("source", "block", (F.col("whole") + 1).cast("int").alias("epoch"),
                                                 F.lit(LAST).alias("cut"))
    last = cuts.join(placed.select(F.col("source").alias("s"), F.col("block").alias("b"), "whole"),
                     F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select(
        "source", "block", (F.col("whole") + 1).cast("int").alias("epoch"), "cut")
    return repeats.unionByName(full).unionByName(last)


def ranked(node: DataFrame) -> DataFrame:
    """``node`` with ``rank``, a draw's place by lot among its shard's, and ``held``, how many
    there are: ranks inside (shard, prefix of the lot) and offsets of the prefixes, so no
    window holds a whole shard."""
    lead = node.withColumn("lead", F.substring("lot", 1, LEAD_CHARS))
    order = Window.partitionBy("shard").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lead.groupBy("shard", "lead").agg(F.count("*").alias("n")).select(
        "shard", "lead", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("shard")).alias("held"))
    own = F.row_number().over(Window.partitionBy("shard", "lead").orderBy("lot", "source", "block", "epoch"))
    return (lead.withColumn("own", own).join(offsets, ["shard", "lead"])
            .withColumn("rank", F.col("before") + F.col("own")).drop("lead", "own", "before"))


def split(draws: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """``draws`` with their shard: level by level, half of each node's draws, in
    the order of a keyed hash, goes to the left child."""
    node = draws.withColumn("shard", F.lit(0))
    for level in range(levels):
        lot = F.md5(F.concat_ws(":", F.lit(f"{SEED}-{level}"), F.coalesce("source", F.lit("")),
                                F.col("source").isNull().cast("string"), "block", F.col("epoch").cast("string")))
        node = ranked(stored(node.withColumn("lot", lot), "op7-lots")).withColumn(
            "shard", F.col("shard") * 2 + F.when(F.col("rank") * 2 <= F.col("held") + 1, 0).otherwise(1)).select(
            *draws.columns, "shard")
    return node


def plan(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(narrow documents, targets, draws with shards), all stored."""
    names = ("draw", "block", "size", "origin")
    narrow = stored(keyed(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")),
                          "key", "text", "source", names).select(
        "key", "source", "draw", "block", "size", F.monotonically_increasing_id().alias("row")), "op7-documents")
    wanted = stored(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "op7-targets")
    return narrow, wanted, stored(split(quota(narrow, wanted)), "op7-draws")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row of ``docs`` for each time it is drawn, with ``shard``, ``epoch`` and
    ``order_key`` (named differently if docs has such columns): the mix, shard by shard.

    A null text has no words; a null source is a source of its own, last in
    order; null keys are keys.  Rows equal in key and text share one fate.  Other
    columns pass through.  An empty table gives an empty mix.  The same rows
    give the same mix."""
    _, _, draws = plan(docs, key, text, source)
    names = tuple(spare_name(docs, n) for n in ("draw", "block", "size", "origin"))
    shard, epoch, order = (spare_name(docs, n) for n in ("shard", "epoch", "order_key"))
    rows = keyed(docs, key, text, source, names)
    draw, block, _, origin = (F.col(f"d.`{n}`") for n in names)
    joined = rows.alias("d").join(draws.alias("m"), origin.eqNullSafe(F.col("m.source"))
                                  & (block == F.col("m.block")) & (draw <= F.col("m.cut")))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("m.shard").alias(shard),
                         F.col("m.epoch").alias(epoch),
                         F.md5(F.concat_ws(":", F.lit(SEED), F.col("m.epoch").cast("string"), draw)).alias(order))


def write_mix(mixed: DataFrame, folder: str, shard: str = "shard", order: str = "order_key") -> None:
    """The mix as Parquet, one folder a shard, each file in its random order."""
    mixed.repartitionByRange(shard, order).sortWithinPartitions(shard, order).write.partitionBy(shard).parquet(folder)


def mix_report(docs: DataFrame) -> DataFrame:
    """Contract of op7: one row per document with its source's target and the words taken of it."""
    narrow, wanted, draws = plan(docs, "doc_id", "text", "source")
    drawn = narrow.alias("d").join(draws.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source"))
                                   & (F.col("d.block") == F.col("m.block")) & (F.col("d.draw") <= F.col("m.cut")))
    times = drawn.groupBy(F.col("d.row").alias("drawn")).agg(F.count("*").alias("times"))
    own = wanted.withColumnRenamed("source", "from")
    return (narrow.join(times, F.col("row") == F.col("drawn"), "left")
            .join(own, F.col("source").eqNullSafe(F.col("from")))
            .select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                    (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"), "source"))


def draw_documents(docs: DataFrame) -> DataFrame:
    """The mixed rows of ``docs``, repeats included, with their own columns only."""
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
