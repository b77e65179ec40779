"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialume.llm.frames import in_few_tasks
from vialume.llm.store import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the smallest node of its component.

    Each round takes the smallest label of the neighbours and then the label's own label, so chains shorten by half.
    Labels are written to the shared folder after each round.
    """
    stored = lambda rows, what: materialize(in_few_tasks(rows), f"{name}-{what}")
    edges = in_few_tasks(edges.select("a", "b").filter("a <> b"))
    pair = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = stored(edges.select(pair.alias("pair")).select("pair.a", "pair.b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        near = in_few_tasks(both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("theirs")), "b")).groupBy(F.col("a").alias("near")).agg(F.min("theirs").alias("theirs"))
        step = in_few_tasks(labels.join(near, F.col("node") == F.col("near"))).select("node", F.col("root").alias("old"), F.least("root", "theirs").alias("root"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        step = stored(step.join(jump, F.col("root") == F.col("via")).select("node", "old", F.least("root", "beyond").alias("root")), "labels")
        labels = step.select("node", "root")
        if step.filter("old <> root").isEmpty():
            return labels
