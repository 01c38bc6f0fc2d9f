"""Connected components of a graph of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._spark import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): for each node of a link the smallest node that it reaches. Links need no order and may repeat.

    Each round takes the least label of the neighbours and then the label's own label, so the rounds grow with the logarithm of
    a chain's length. Minima are combined before each exchange; each round's labels are a table in the shared folder.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = stored(hooked.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return labels


def star_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp), as ``connected_components``, by alternating large-star and small-star until the edges stay as they are.

    Large-star hangs each node's larger neighbours on the least node that it sees, small-star its smaller ones and itself. Minima are combined
    before each exchange, and the edges only shrink to one for each node but the least; each round's edges are a table in the shared folder.
    """

    def smaller_last(edges: DataFrame) -> DataFrame:
        return stored(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = smaller_last(links.select(F.col(a).alias("u"), F.col(b).alias("v")))
    seen = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = smaller_last(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = smaller_last(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))))
        last, seen = seen, mark(edges)
        if seen == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
