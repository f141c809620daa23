"""Connected components of a graph whose links are rows, by smallest-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> one row (node, component) for each node; component is its smallest member.

    Each round takes the smallest label among neighbours, then the label of one's label; every round's labels
    are a written table, so a lost executor costs at most that round. Rounds grow with the logarithm of the
    longest shortest path. Null ends and links of a node to itself add nothing; an empty table gives no rows.
    """
    given = links.where("a is not null and b is not null and a <> b")
    both = written(given.select("a", "b").union(given.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = spread.select(F.col("node").alias("at"), F.col("label").alias("further"))
        joined = spread.join(jump, spread["label"] == jump["at"]).select("node", "old", F.least("label", "further").alias("label"))
        rounds = written(joined, "labels")
        labels = rounds.select("node", "label")
        if rounds.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
