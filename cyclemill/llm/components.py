"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclemill.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in edges (a, b): comp is the smallest id that can be reached.

    Each round takes the smallest label of a node and its neighbours, hooks the old label's node to it, and then jumps to
    the label of the label. Labels only fall; the rounds, about the logarithm of the longest path, end when none does.
    Labels are written to the shared folder each round, so that lineage stays short.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        heard = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("new"))
        hooked = heard.select(F.col("old").alias("id"), "new").unionByName(heard.select("id", "new")).groupBy("id").agg(F.min("new").alias("new"))
        jump = hooked.select(F.col("id").alias("new"), F.col("new").alias("far"))
        after = hooked.join(jump, "new", "left").select("id", F.coalesce("far", "new").alias("comp"))
        after = stored(after)
        moved = after.join(labels.withColumnRenamed("comp", "old"), "id").where("comp <> old").limit(1).count()
        labels = after
        if not moved:
            return labels
