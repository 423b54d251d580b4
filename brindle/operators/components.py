"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans.storage import forget, shared_folder, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reached) for each node of an edge. Any orderable type; nulls and loops don't count.

    A round links each node's neighbours to the least of them. Minima are summed before the shuffle, and joins with a
    hub are those that adaptive execution splits, so a node with very many neighbours doesn't sit in one task. Each
    round is written, so lost executors cost a round at most.
    """
    spark = edges.sparkSession
    base = shared_folder(spark, "components")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = written(e, "edges", f"{base}/0"), None
    for n in range(1, most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "edges", f"{base}/{n}")
        mark = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(now)
        now = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    hubs = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs.select(F.col("v").alias("node"), F.col("v").alias("component")))
