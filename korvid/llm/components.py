"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import checkpoint, forget


def connected_components(links: DataFrame) -> DataFrame:
    """links(src long, dst long) -> (node, label), label being the smallest node reachable.

    Each round takes the least label among neighbours (combined before the shuffle) and then
    jumps to the label's own label, so that a chain of n links needs about log n rounds. Only
    nodes with a link take part; loops and repeated links are harmless, no links give no rows.
    A hub's links are a skewed join, which adaptive execution splits.
    """
    # Read twice below: computed once, as a forest that is made again may have other links.
    links = checkpoint(links.select("src", "dst").where("src <> dst"))
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = checkpoint(both.groupBy("src", "dst").agg(F.lit(1).alias("one")).select("src", "dst"))
    seen = labels = checkpoint(
        both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("label"))
    )
    while True:
        near = labels.select(F.col("node").alias("dst"), F.col("label").alias("seen"))
        low = both.join(near, "dst").groupBy(F.col("src").alias("node")).agg(F.min("seen").alias("low"))
        hooked = labels.join(low, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = checkpoint(
            hooked.join(up, "label").select("node", F.least("label", "above").alias("label"), (F.least("label", "above") != F.col("old")).alias("moved"))
        )
        ended = after.where("moved").isEmpty()
        forget(seen)
        seen, labels = after, after.select("node", "label")
        if ended:
            return labels
