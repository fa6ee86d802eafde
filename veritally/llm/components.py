"""Connected components of a table of links, by least labels with pointer jumping; nothing is brought to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link; the root is the least node of its component.

    Each round gives a node the least label among its own and its neighbours', then the label of that label. Labels are
    combined before the shuffle, and both sides of each join are written tables, so hot nodes are split at run time.
    """
    both = table(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct(), "links")
    label = table(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = table(label.join(near, "node").select("node", "root", F.least("root", "near").alias("next")), "labels")
        jump = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next").select("node", "root", F.least("next", "far").alias("next"))
        done = table(jump, "labels")
        label = done.select("node", F.col("next").alias("root"))
        if done.filter(F.col("root") != F.col("next")).isEmpty():
            return label
    raise RuntimeError(f"no end after {most_rounds} rounds")
