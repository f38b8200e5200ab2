"""Connected components of a graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.session import cut_lineage, release


def follow_picks(picks: DataFrame, jumps: int = 3) -> DataFrame:
    """(comp, to): where following each component's pick ends.  Picks form
    trees whose root is a pair that picked each other; the smaller of the pair
    stands for the tree.  Pointer jumping, ``jumps`` doublings between two
    written tables, until the last of them moves nothing."""
    back = picks.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    root = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to"))
    now, old = picks.join(back, "to").select("comp", F.when(root, F.col("comp")).otherwise(F.col("to")).alias("to")), None
    while True:
        new = now
        for _ in range(jumps):
            hop = new.select(F.col("comp").alias("to"), F.col("to").alias("next"))
            new = new.select("comp", "to").join(hop, "to").select("comp", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        new = cut_lineage(new)
        if old is not None:
            release(old)
        if not new.agg(F.max("moved")).first()[0]:
            return new.select("comp", "to")
        now, old = new.select("comp", "to"), new


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp = smallest id of the component).  Contraction: every
    component picks its smallest neighbour, what hangs together by picks
    becomes one component, and the edges are rewritten, until none is left;
    each round at least halves the components that still have edges."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    now = cut_lineage(both.where("src <> dst").distinct())
    lab = cut_lineage(vertices.select("id", F.col("id").alias("comp")))
    while not now.isEmpty():
        to = follow_picks(cut_lineage(now.groupBy("src").agg(F.min("dst").alias("to")).withColumnRenamed("src", "comp")))
        old = lab, now
        lab = cut_lineage(lab.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        ends = now.join(to.toDF("src", "a"), "src").join(to.toDF("dst", "b"), "dst")
        now = cut_lineage(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        release(*old)
    least = lab.groupBy("comp").agg(F.min("id").alias("least"))
    return cut_lineage(lab.join(least, "comp").select("id", F.col("least").alias("comp")))
