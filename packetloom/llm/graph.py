"""Connected components of an undirected graph given as a table of edges."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that the node reaches. Edges are (a long, b long); loops and repeats are
    harmless, a null end drops the edge, an empty table gives an empty one.

    Each round gives a node the smallest label among its neighbours, then the label of its label. Rounds grow with the
    logarithm of the longest path in usual graphs. A round is two joins and one aggregate that combines before its
    shuffle, so a node with very many edges is no single group; its rows are written to the shared folder.
    """
    links = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("label")))
    while True:
        heard = (links.join(labels.select(F.col("node").alias("b"), "label"), "b")
                 .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard")))
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("up"))
        after = cut(near.join(up, "near", "left").select("node", "old", F.least("near", F.coalesce("up", "near")).alias("label")))
        if after.filter("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
