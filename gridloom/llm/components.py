"""Connected components of an edge table by repeated contraction, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of (u, v) edges; label: the smallest node of the component.

    Each round maps a node to the least of itself and its neighbours and keeps
    the edges between different images.  An edge survives only if its ends do
    not meet in that round, so stars are done after one; labels are composed
    backwards.  Every round is a written table.
    """
    spark = edges.sparkSession
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).select(F.col("u").alias("node"), "m"), "round")
        maps.append(to)
        ends = edges.join(to.select(F.col("node").alias("u"), F.col("m").alias("mu")), "u").join(to.select(F.col("node").alias("v"), F.col("m").alias("mv")), "v")
        edges = materialize(ends.where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "node long, label long")
    out = maps[-1].select("node", F.col("m").alias("label"))
    for to in reversed(maps[:-1]):
        deeper = out.select(F.col("node").alias("m"), F.col("label").alias("further"))
        out = materialize(to.join(deeper, "m", "left").select("node", F.coalesce("further", "m").alias("label")), "labels")
    return out
