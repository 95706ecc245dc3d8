"""Ranks of the splitting tree: right, and never over a whole shard in one window."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from carelake.llm import mixing


def test_ranks_by_prefix(spark):
    node = (spark.range(6000).select(F.md5(F.col("id").cast("string")).alias("lot"), F.col("id").cast("string").alias("source"),
                                     F.lit("0").alias("block"), F.lit(1).alias("epoch"), (F.col("id") % 3 % 2).alias("shard")))
    ranked = mixing.ranked(node)
    lots = defaultdict(list)
    rows = ranked.collect()
    for r in rows:
        lots[r.shard].append(r.lot)
    place = {k: {x: i + 1 for i, x in enumerate(sorted(v))} for k, v in lots.items()}
    assert len(rows) == 6000 and all(r["rank"] == place[r.shard][r.lot] and r.held == len(lots[r.shard]) for r in rows)
    numbered = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", ranked._jdf.queryExecution().analyzed().toString())
    assert numbered and all(re.match(r"shard#\d+L?, lead#\d+", n) for n in numbered)
