"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """v, comp for every end of links (a, b): comp is the least vertex that it reaches. Vertices without links aren't listed.

    Each round points every vertex at the least of its neighbours and itself, follows two pointers, and puts the vertices
    there together; links within one vanish, so what is joined shrinks from round to round. The least vertex of a
    component points at itself, so it is the one that is left. Nothing comes to the driver but whether links are left.
    """
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
    edges = staged(both.where("v <> u").distinct(), "edges")
    labels = None
    while True:
        point = staged(edges.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("p")), "pointers")
        far = point.select(F.col("v").alias("p"), F.col("p").alias("f"))
        moved = staged(point.join(far, "p").select("v", "f"), "moved")
        if labels is None:
            labels = moved.withColumnRenamed("f", "comp")
        else:
            labels = staged(labels.join(moved.withColumnRenamed("v", "comp"), "comp", "left").select("v", F.coalesce("f", "comp").alias("comp")), "labels")
        to = moved.select(F.col("v").alias("u"), F.col("f").alias("fu"))
        edges = staged(edges.join(moved, "v").join(to, "u").where("f <> fu").select(F.col("f").alias("v"), F.col("fu").alias("u")).distinct(), "edges")
        if edges.isEmpty():
            return labels
