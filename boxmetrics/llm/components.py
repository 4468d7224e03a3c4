"""Connected components by label propagation with hooking and pointer jumping.

Rounds grow with the logarithm of the longest path. Each round is joins and aggregates over
labels, stored in the shared folder; only the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import stored


def component_labels(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """`node` and `label`, the smallest node of its component, for all nodes in the pairs."""
    ways = F.array(
        F.struct(F.col(left).alias("node"), F.col(right).alias("other")),
        F.struct(F.col(right).alias("node"), F.col(left).alias("other")),
    )
    edges = pairs.select(F.inline(ways))
    labels = stored(
        edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels"
    )
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "other"), "other")
        lowest = seen.groupBy("node").agg(F.min("label").alias("near"))
        state = labels.join(lowest, "node").withColumn("near", F.least("near", "label"))
        # The label of a tree hears of everything its members see.
        hooked = state.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("hook"))
        moved = (
            state.join(hooked, state["label"] == hooked["root"])
            .select("node", F.col("label").alias("old"), F.least("near", "hook").alias("label"))
        )
        jumped = moved.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = moved.join(jumped, moved["label"] == jumped["at"], "left").select(
            "node", "old", F.coalesce("further", "label").alias("label")
        )
        after = stored(after, "labels")
        labels = after.select("node", "label")
        if after.filter(F.col("old") != F.col("label")).isEmpty():
            return labels
