"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.session import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node in `links` (a, b: bigint): label is the smallest node that it reaches.

    A round joins each node's larger neighbours to the smallest node around it, then the rest. A node's neighbours
    are never gathered: the smallest is a partial aggregate, joined back. Rounds are written to the shared folder and
    end when the links repeat."""
    star = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    was = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(small, "a")
        star = materialize(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            linked.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name)
        now = tuple(star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == was or not now[0]:
            break
        was = now
    roots = star.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
