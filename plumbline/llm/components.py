"""Connected components of a graph of links, by alternating large and small stars.

Defined results: a node without a link, or linked only to itself, is in no row; repeated links and links given both ways
count once; a link with a null end is none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.scale import materialise, split_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    A large star hangs a node's larger neighbours on the smallest one around it, a small star the smaller ones; both
    keep what is connected, and when nothing changes any more every node hangs on the smallest of its component. The
    number of rounds grows with the logarithm of the longest path. Nothing is gathered on the driver but a checksum.
    """
    now = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        hung = split_join(both.where(F.col("v") > F.col("u")), least, "u")
        large = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        moved = split_join(large, least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v")
        now = materialise(moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "links")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )
