"""Connected components of a table of links, by minimum labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakflow.sources.staging import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links, for nodes with a link.

    Each round takes the smallest label among the neighbours and then that label's own label,
    so labels travel a distance that doubles. Rounds are tables in the shared folder.
    """
    one = links.filter(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = stage(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    first = edges.groupBy("node").agg(F.min("other").alias("least"))
    labels = stage(first.select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("component").alias("seen"))
        seen = edges.join(of_other, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        nearer = labels.join(seen, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "seen").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = stage(
            nearer.join(jump, "component", "left").select(
                "node", "was", F.least("component", F.coalesce("further", "component")).alias("component")
            ),
            "labels",
        )
        labels = jumped.select("node", "component")
        if jumped.filter("was <> component").isEmpty():
            return labels
