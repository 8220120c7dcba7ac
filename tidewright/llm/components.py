"""Connected components of a table of links, by labels that hook and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import remove_table, write_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and comp (the smallest node that it reaches) for each node of links.

    Every round a node takes the least label among its neighbours', its label's label follows, and
    labels jump to their labels: rounds grow as the logarithm of the longest path. All rounds are
    joins and grouped minima, and a round's labels are written before the next reads them.
    """
    both = write_table(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "links")
    labels = write_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("comp")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("seen"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "comp", F.least("comp", "seen").alias("low"))
        hooks = step.where("low < comp").groupBy(F.col("comp").alias("node")).agg(F.min("low").alias("hook"))
        hooked = write_table(step.join(hooks, "node", "left").select("node", "comp", F.least("low", F.coalesce("hook", "low")).alias("low")), "labels")
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = write_table(hooked.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("comp"), F.col("comp").alias("was")), "labels")
        moved = after.where("comp <> was").limit(1).count()
        remove_table(labels)
        labels = after.select("node", "comp")
        if not moved:
            remove_table(both)
            return labels
