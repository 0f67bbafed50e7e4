"""Connected components of an edge table by label propagation with pointer jumping, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), any direction, repeats and loops allowed. Returns (node, comp): comp is the least node reached.

    Each round takes the least label around each node, then the label of that label, so long chains shrink by halves.
    Of labels only those that have a lower one themselves are looked up: a row for each, none for the label that a whole
    component has settled on. Every round is written to the shared folder, which bounds the lineage; only its count of
    changes reaches the driver. A table without edges gives an empty result; a node of the edges is never null.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = materialise(labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new")), "cc-near")
        asked = lower.select("new").distinct()
        jump = lower.select(F.col("node").alias("new"), F.col("new").alias("far")).where("far < new").join(asked, "new", "left_semi")
        jump = materialise(jump, "cc-jump")
        to = F.coalesce("far", "new")
        step = lower.join(jump, "new", "left").select("node", to.alias("comp"), (to != F.col("comp")).alias("moved"))
        step = materialise(step, "cc-round")
        labels = step.select("node", "comp")
        if step.where("moved").isEmpty():
            return labels
