"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the least node reachable.

    Each round takes the least label among the neighbours and then the label of
    that label, so labels travel twice as far in every round. Both the links and
    the labels stay distributed; each round's labels are a written table, so a lost
    executor costs no more than the running round. Only the number of changed
    labels comes to the driver. Links and labels are stored tables, so where many links meet
    in one node, or many nodes hook to one root, adaptive execution splits that side of the join, and
    the least label is taken before the shuffle. An empty link table gives an empty result.
    """
    links = links.where("a <> b")
    edges = work.save(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = work.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        before = work.last
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("hook"))
        further = labels.select(F.col("node").alias("hook"), F.col("root").alias("next"))
        jumped = hooked.join(further, "hook").select("node", F.least("hook", "next").alias("root"), (F.least("hook", "next") != F.col("old")).alias("changed"))
        jumped = work.save(jumped, "labels", instead=before)
        labels = jumped.select("node", "root")
        if not jumped.where("changed").limit(1).count():
            return labels
