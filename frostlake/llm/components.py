"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from frostlake.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v), the root being the least node of its component. Nodes are numbers, or
    structs, which are in the order of their fields: with what is wanted of a component's best node in front, no
    component need be gathered to find it.

    Rounds of large and small stars: each keeps the components and brings the links nearer to stars around the
    roots, in about the logarithm of the longest path. A link is (upper, lower). The large star moves a link's
    lower end to the least node beside it; nodes with very many links are lower ends, so that join is one that
    Spark can split. The small star then ties each upper node's lower ones to their least. Every round is
    written to the shared folder. Self links and repeated links do no harm; no links give no rows."""
    now = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("upper"), F.least("u", "v").alias("lower")).distinct())
    mark = None
    while True:
        beside = materialise(now.groupBy(F.col("upper").alias("node")).agg(F.min("lower").alias("least")))
        large = now.join(beside, now.lower == beside.node, "left").select("upper", F.coalesce("least", "lower").alias("lower"))
        least = large.withColumn("least", F.min("lower").over(Window.partitionBy("upper")))
        small = least.select(F.explode(F.array(F.struct(F.col("upper"), F.col("least").alias("lower")), F.struct(F.col("lower").alias("upper"), F.col("least").alias("lower")))).alias("x"))
        small = small.select("x.upper", "x.lower").where("upper <> lower").distinct()
        seen = Observation()
        now = materialise(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("upper", "lower").cast("decimal(38,0)")).alias("h")))
        got = (seen.get["n"], seen.get["h"])
        if got == mark:
            break
        mark = got
    return now.select(F.col("upper").alias("node"), F.col("lower").alias("root")).unionByName(now.select(F.col("lower").alias("node"), F.col("lower").alias("root")).distinct())
