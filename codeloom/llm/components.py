"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.settings import materialize


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.filter("high <> low").distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest neighbour instead."""
    sides = F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("near")) for a, b in (("high", "low"), ("low", "high"))])
    both = pairs.select(F.explode(sides).alias("side")).select("side.*")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    return _distinct(both.filter("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low")))


def _small_star(pairs: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the smallest of them."""
    least = pairs.groupBy("high").agg(F.min("low").alias("least"))
    rest = pairs.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return _distinct(rest.union(least))


def _is_star_forest(pairs: DataFrame) -> bool:
    """No node has two smaller neighbours, and no centre has a smaller neighbour."""
    if not pairs.groupBy("high").count().filter("count > 1").isEmpty():
        return False
    return pairs.join(pairs.select(F.col("high").alias("low")), "low", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node that can be reached.

    Links have no direction; repeated links, links of a node to itself and links with a null are harmless. Each
    round works on links only, is written to the shared folder, and needs no node's neighbours together in memory.
    """
    oriented = links.filter(f"{a} IS NOT NULL AND {b} IS NOT NULL").select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    pairs = materialize(_distinct(oriented), "links")
    while not _is_star_forest(pairs):
        pairs = materialize(_small_star(_large_star(pairs)), "links")
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).union(pairs.select(F.col("low"), F.col("low")).distinct())
