"""Connected components of an edge table, by contraction to minimum neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (id, component): every id of an edge with the smallest id it reaches.

    Each round gives every label its smallest neighbour, follows those pointers to their ends and
    contracts the edges; the longest path shrinks at least by half, so rounds grow with its logarithm.
    All steps are joins and aggregates with partial sums, and each round is written to the shared folder.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = cut(live.select("a").union(live.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("component")), "labels")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        pointer = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "pointers")
        while True:
            jump = pointer.select(F.col("a").alias("p"), F.col("p").alias("q"))
            last = pointer
            pointer = cut(last.join(jump, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "pointers")
            drop_cut(last)
            if pointer.where("moved").isEmpty():
                break
        to = pointer.select(F.col("a").alias("component"), "p")
        before = labels, live
        labels = cut(labels.join(to, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
        at, bt = pointer.select("a", F.col("p").alias("x")), pointer.select(F.col("a").alias("b"), F.col("p").alias("y"))
        joined = live.join(at, "a").join(bt, "b").where("x <> y")
        live = cut(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop_cut(*before, pointer)
    drop_cut(live)
    return labels
