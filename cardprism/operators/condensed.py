"""Excess of mass over a condensed cluster tree, as tables.

Input are the split edges of a spanning tree and the atoms (pieces of the tree
between splits).  A split edge joins two clusters, so the tree has one node per
split and one leaf per atom.

1. *Who joins whom.*  Splits are ranked; the two children of a split are the
   components of its ends under all splits before it.  They are found top-down
   by halving the ranks: components of the lower half name the nodes that the
   upper half sees, for all halves of one length at once, until a group of
   ``GROUP`` consecutive ranks is left, which one task solves by union-find.
2. *Where a point leaves.*  A point belongs to the first cluster on its way up
   that was born after its own level; ancestors 1, 2, 4, .. steps up are tables,
   and a point tries the longest step first.
3. *Values from the leaves up.*  A node's value is max(c, k + values of its
   children).  Known children are added to k (rake); a node with one open child
   is max(c, k + x), and such functions compose, so chains shrink by half with
   each join (compress).  Both sums of points and best masses are of this form.
4. *Labels from the root down.*  The highest chosen node above, by doubling.

All steps take a number of rounds that grows with the logarithm of the number
of splits, however deep the tree is.  Nothing but counts reaches the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.operators.blocks import row_numbers
from cardprism.operators.components import connected_components
from cardprism.session import cut_lineage, release

GROUP_BITS = 12
TINY = 1e-300


def _join_fn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over one group of consecutive splits; a component is named
    by its last split, or as the group found it."""
    root, name, rows = {}, {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for node, x, y in pdf.sort_values("node")[["node", "x", "y"]].itertuples(index=False):
        a, b = find(x), find(y)
        rows.append((node, name.get(a, a), name.get(b, b)))
        root[b], name[a] = a, node
    return pd.DataFrame(rows, columns=["node", "left", "right"])


def merge_tree(splits: DataFrame, count: int, group_bits: int = GROUP_BITS) -> DataFrame:
    """(node, left, right) of ``splits`` (node = rank, x, y)."""
    now = splits.select("node", "x", "y")
    for bit in reversed(range(group_bits, max(1, count - 1).bit_length())):
        upper = F.shiftright("node", bit).bitwiseAND(1) == 1
        low = now.where(~upper)
        ends = low.select(F.explode(F.array("x", "y")).alias("id")).distinct()
        comps = connected_components(ends, low.select(F.col("x").alias("src"), F.col("y").alias("dst")))
        last = low.join(comps.withColumnRenamed("id", "x"), "x").groupBy("comp").agg(F.max("node").alias("name"))
        # a node lies in one group only: the halves above have renamed what lower groups touch
        named = comps.join(last, "comp").select("id", "name")
        new = now.join(named.toDF("x", "nx"), "x", "left").join(named.toDF("y", "ny"), "y", "left")
        old, now = now, cut_lineage(new.select("node", F.when(upper, F.coalesce("nx", "x")).otherwise(F.col("x")).alias("x"),
                                               F.when(upper, F.coalesce("ny", "y")).otherwise(F.col("y")).alias("y")))
        release(old)
    return now.groupBy(F.shiftright("node", group_bits)).applyInPandas(_join_fn, "node long, left long, right long")


def climb(start: DataFrame, up: DataFrame) -> DataFrame:
    """``start`` (node, level, ..) with node replaced by the first one on its
    way up whose birth comes after level.  ``up``: node, parent, birth (rising
    on the way up; the root has no row)."""
    steps = [cut_lineage(up.select("node", F.col("parent").alias("to"), F.col("birth").alias("last")))]
    while True:   # twice as far: the last cluster passed is that of the second half
        half = steps[-1]
        far = half.select("node", "to").join(half.select(F.col("node").alias("to"), F.col("to").alias("next"), "last"), "to")
        far = cut_lineage(far.select("node", F.col("next").alias("to"), "last"))
        if far.isEmpty():
            break
        steps.append(far)
    out, columns = start, start.columns
    for k, step in enumerate(reversed(steps)):
        out = out.join(step, "node", "left").withColumn("node", F.when(F.col("level") >= F.col("last"), F.col("to")).otherwise(F.col("node"))).select(columns)
        if k % 4 == 3:
            out = cut_lineage(out)
    return cut_lineage(out)


def tree_values(nodes: DataFrame) -> DataFrame:
    """(node, value) with value = greatest(c, k + values of a and b); ``nodes``:
    node, c, k, a, b (children; null: none)."""
    now = cut_lineage(nodes.select("node", "c", "k", "a", "b", F.when(F.col("a").isNull() & F.col("b").isNull(), F.greatest("c", "k")).alias("value")))
    while not now.where("value is null").isEmpty():
        known = now.where("value is not null").select("node", "value")
        new = now.where("value is null").drop("value")
        new = new.join(known.toDF("a", "va"), "a", "left").join(known.toDF("b", "vb"), "b", "left")
        a, b = F.when(F.col("va").isNull(), F.col("a")), F.when(F.col("vb").isNull(), F.col("b"))
        new = new.select("node", "c", (F.col("k") + F.coalesce("va", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0))).alias("k"),
                         F.coalesce(a, b).alias("a"), F.when(a.isNotNull(), b).alias("b"))
        new = cut_lineage(new.withColumn("value", F.when(F.col("a").isNull(), F.greatest("c", "k"))))
        for _ in range(2):
            chain = new.where("a is not null and b is null").select(F.col("node").alias("a"), F.col("c").alias("c2"), F.col("k").alias("k2"), F.col("a").alias("a2"))
            on = new.join(chain, "a", "left")
            hop = F.col("a2").isNotNull() & F.col("b").isNull()
            new = on.select("node", F.when(hop, F.greatest(F.col("c"), F.col("k") + F.col("c2"))).otherwise(F.col("c")).alias("c"),
                            F.when(hop, F.col("k") + F.col("k2")).otherwise(F.col("k")).alias("k"),
                            F.when(hop, F.col("a2")).otherwise(F.col("a")).alias("a"), "b", "value")
        old, now = now, cut_lineage(now.where("value is not null").unionByName(new))
        release(old)
    return now.select("node", "value")


def topmost(nodes: DataFrame) -> DataFrame:
    """(node, top): the highest chosen node on the way up, itself included
    (null: none).  ``nodes``: node, parent (null: root), chosen."""
    now = cut_lineage(nodes.select("node", F.col("parent").alias("to"), F.when(F.col("chosen"), F.col("node")).alias("top")))
    while not now.where("to is not null").isEmpty():
        above = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("top").alias("higher"))
        old, now = now, cut_lineage(now.join(above, "to", "left").select("node", F.col("next").alias("to"), F.coalesce("higher", "top").alias("top")))
        release(old)
    return now.select("node", "top")


def excess_of_mass(members: DataFrame, splits: DataFrame, group_bits: int = GROUP_BITS) -> DataFrame:
    """(id, label) of the points in chosen clusters.  ``members``: id, atom,
    level (struct of weight, src, dst: the edge with which the point's component
    reaches the least cluster size); ``splits``: weight, src, dst, a, b (atoms)."""
    ranked = row_numbers(splits, ["weight", "src", "dst"], "node")
    count = ranked.count()
    if not count:
        return members.select("id", F.lit(None).cast("long").alias("label")).limit(0)
    atoms = row_numbers(ranked.select(F.explode(F.array("a", "b")).alias("atom")).distinct(), ["atom"], "nr")
    atoms = atoms.select("atom", (-F.col("nr") - 1).alias("node"))   # splits are numbered from 0 up, atoms from -1 down
    ends = ranked.join(atoms.toDF("a", "x"), "a").join(atoms.toDF("b", "y"), "b")
    tree = cut_lineage(merge_tree(ends, count, group_bits))
    edge = F.struct("weight", "src", "dst")
    up = tree.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    up = cut_lineage(up.join(ranked.select(F.col("node").alias("parent"), edge.alias("birth")), "parent").select("node", "parent", "birth"))
    placed = climb(members.join(atoms, "atom").select("node", "level", "id"), up)
    sums = placed.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("inside"), F.sum(1.0 / F.greatest("level.weight", F.lit(TINY))).alias("own"))
    nodes = atoms.select("node", F.lit(0.0).alias("weight")).unionByName(ranked.select("node", "weight"))
    nodes = nodes.join(tree, "node", "left").join(up, "node", "left").join(sums, "node", "left").fillna(0.0, ["inside", "own"])
    nodes = cut_lineage(nodes.select("node", "weight", "left", "right", "parent", F.col("birth.weight").alias("birth"), "inside", "own"))
    children = [F.col("left").alias("a"), F.col("right").alias("b")]
    size = tree_values(nodes.select("node", F.lit(float("-inf")).alias("c"), F.col("inside").alias("k"), *children))
    born = 1.0 / F.greatest("birth", F.lit(TINY))
    below = F.col("value") - F.col("inside")
    at_split = F.when(below > 0, below * (1.0 / F.greatest("weight", F.lit(TINY)) - born)).otherwise(0.0)
    mass = nodes.join(size, "node").withColumn("mass", F.coalesce(at_split + F.col("own") - F.col("inside") * born, F.lit(float("-inf"))))   # no cluster: the root
    mass = cut_lineage(mass.select("node", "left", "right", "parent", "mass"))
    best = tree_values(mass.select("node", F.col("mass").alias("c"), F.lit(0.0).alias("k"), *children).withColumn("k", F.when(F.col("a").isNull(), F.lit(float("-inf"))).otherwise(0.0)))
    kids = best.toDF("child", "value").join(up.select(F.col("node").alias("child"), F.col("parent").alias("node")), "child").groupBy("node").agg(F.sum("value").alias("kids"))
    chosen = F.col("parent").isNotNull() & F.coalesce(F.col("mass") >= F.col("kids"), F.lit(True))
    top = topmost(mass.join(kids, "node", "left").select("node", "parent", chosen.alias("chosen")))
    return placed.join(top, "node").where("top is not null").select("id", F.col("top").alias("label"))
