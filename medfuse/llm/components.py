"""Connected components of a link table by minimum labels with pointer jumping, as Spark joins.

Every round is written to the shared folder, so both sides of each join are fresh scans: AQE can split a node or a
label that holds a large share of the rows, and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medfuse.llm.common import cut, discard


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of ``links``: ``label`` is the smallest node that can be reached.

    ``links`` may be given in either direction, repeated, and with loops; a link with a NULL end is left out.
    The number of rounds follows the logarithm of the longest path.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = cut(ends.unionByName(ends.selectExpr("v AS u", "u AS v")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                 .select("node", F.least("node", "m").alias("label")))
    while True:
        heard = (both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m")))
        hooked = cut(labels.join(heard, labels["node"] == heard["u"])
                     .select("node", "label", F.least("label", "m").alias("next")))
        parents = hooked.select(F.col("node").alias("parent"), F.col("next").alias("grand"))
        jumped = cut(hooked.join(parents, hooked["next"] == parents["parent"])
                     .select("node", F.col("grand").alias("label"), (F.col("grand") != hooked["label"]).alias("moved")))
        moving = jumped.where("moved").limit(1).count()
        discard(labels)
        discard(hooked)
        labels = jumped
        if not moving:
            discard(both)
            return labels.select("node", "label")
