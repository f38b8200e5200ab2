"""Density clustering (HDBSCAN) as distributed DataFrame jobs.

* core distance (C06a): distance to the ``min_samples``-th nearest neighbour
  (the point itself counts as the first, as in the usual HDBSCAN convention;
  ``include_self=False`` switches it off).  Points lie in metric blocks
  (``metric_blocks.py``); a block is searched in itself first, which bounds the
  distance asked for, and then only in blocks that may lie within the bound;
* mutual reachability (C06b): max(core a, core b, d(a, b));
* minimum spanning tree of the mutual reachability graph over ALL pairs
  (C06c): Borůvka rounds.  A component's lightest edge is bounded by what its
  neighbour lists and the blocks' ranges tell; only block pairs that may hold a
  lighter one, and that do not lie in one component, are formed.  Nothing is cut
  to nearest neighbours;
* components at one density level (C06d);
* cluster choice by excess of mass over all levels (C06e), see
  ``condensed.py``.

Points whose vector is null or holds null or non-finite numbers can't be placed;
``density_sweep`` sets them apart and returns them as noise
(``unusable_points`` names the reason).  The steps below expect finite vectors
of one length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.operators.blocks import near_squares, pair_distances, row_numbers, sides, vectors
from cardprism.operators.components import connected_components, follow_picks
from cardprism.operators.condensed import excess_of_mass
from cardprism.operators.metric_blocks import MetricBlocks, metric_blocks
from cardprism.session import at_once, cut_lineage, release

NOISE = -1


# --- points that can't be placed ----------------------------------------------------

def _reason():
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(F.col("v").isNull(), F.lit("no vector")).when(~F.forall("v", number), F.lit("null or non-finite number"))


def unusable_points(points: DataFrame) -> DataFrame:
    """(id, reason) of the points without a finite vector."""
    return points.select("id", _reason().alias("reason")).where("reason is not null")


def usable_points(points: DataFrame) -> DataFrame:
    """The other ones."""
    return points.where(_reason().isNull())


# --- neighbours -------------------------------------------------------------------

def _knn_fn(m: int, bounded: bool):
    """The m nearest in the other block of each point that may have some there
    (``bounded``: points carry the distance ``reach`` that they need not
    look beyond).  A matrix product tells which pairs can be among them; only
    their distances are computed to the last bit and compared."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "d": np.zeros(0)})]
        for left, right in sides(pdf):
            if bounded:
                left = left[left["reach"] >= left["lower"]]
                if left.empty:
                    continue
            right = right.sort_values("id", kind="stable")   # ties are broken by the neighbour's id
            lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
            kk = min(m, len(rid))
            L, R = vectors(left), vectors(right)
            reach = left["reach"].to_numpy() if bounded else np.full(len(lid), np.inf)
            for rows, G, err in near_squares(L, R):
                top = reach[rows]
                with np.errstate(over="ignore"):
                    top = top * top * (1 + 1e-12) + err
                some = np.flatnonzero(G.min(1) <= top)   # the others have none within reach
                if not len(some):
                    continue
                G = G if len(some) == len(G) else G[some]
                top = np.minimum(top[some], np.partition(G, kk - 1, axis=1)[:, kk - 1] + 2 * err[some])
                r, c = np.nonzero(G <= top[:, None])
                r = some[r] + rows.start
                d = pair_distances(L, R, r, c)
                ok = d <= reach[r]
                r, c, d = r[ok], c[ok], d[ok]
                order = np.lexsort((c, d, r))
                r, c, d = r[order], c[order], d[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < kk
                out.append(pd.DataFrame({"id": lid[r[first]], "other": rid[c[first]], "d": d[first]}))
        return pd.concat(out, ignore_index=True)
    return fn


def knn(points: DataFrame, m: int, include_self: bool = True, block_size: int | None = None, blocks: MetricBlocks | None = None,
        formed: list | None = None) -> DataFrame:
    """(id, other, d, rank): the m nearest neighbours of every point (rank 1 =
    nearest; with ``include_self`` the point itself is rank 1).  ``formed``
    receives the number of block pairs that were compared, and of all."""
    k = m if include_self else m + 1
    blocks = blocks or metric_blocks(points, block_size)
    schema = "id long, other long, d double"
    own = blocks.points.select("id", "v", F.col("block").alias("bi"), F.col("block").alias("bj"), F.lit(False).alias("side"))
    near = cut_lineage(own.groupBy("bi", "bj").applyInPandas(_knn_fn(k, False), schema))
    reach = near.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("reach"))
    placed = cut_lineage(blocks.points.join(reach, "id"))
    far = np.zeros(len(blocks))
    for block, r in placed.groupBy("block").agg(F.max("reach")).collect():   # a row per block
        far[block] = r
    pairs = blocks.pairs(lambda i, lower: (lower <= np.maximum(far[i], far)) & (np.arange(len(far)) != i))
    pairs = cut_lineage(pairs)
    if formed is not None:
        formed.append((pairs.count() + len(blocks), len(blocks) * (len(blocks) + 1) // 2))
    others = blocks.meet(placed, pairs).groupBy("bi", "bj").applyInPandas(_knn_fn(k, True), schema)
    cand = near.unionByName(others)
    if not include_self:
        cand = cand.where(F.col("id") != F.col("other"))
    w = Window.partitionBy("id").orderBy("d", "other")   # at most blocks x m rows a point
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def core_distances(neigh: DataFrame, m: int) -> DataFrame:
    """(id, core_distance) = distance of rank m."""
    return neigh.where(F.col("rank") == m).select("id", F.col("d").alias("core_distance"))


def mutual_reachability(neigh: DataFrame, core: DataFrame) -> DataFrame:
    """Undirected k-NN edges (src < dst) weighted by
    max(core src, core dst, distance)."""
    e = neigh.where(F.col("id") != F.col("other")).select(
        F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), "d")
    e = e.groupBy("src", "dst").agg(F.min("d").alias("d"))
    cs = core.select(F.col("id").alias("src"), F.col("core_distance").alias("cs"))
    cd = core.select(F.col("id").alias("dst"), F.col("core_distance").alias("cd"))
    return e.join(cs, "src").join(cd, "dst").select("src", "dst", F.greatest("cs", "cd", "d").alias("weight"))


# --- one density level --------------------------------------------------------------

def density_cut(points: DataFrame, edges: DataFrame, eps: float, min_cluster_size: int) -> DataFrame:
    """C06d: components of the graph of edges with weight <= eps; components
    smaller than ``min_cluster_size`` are noise.  Returns (id, cluster), the
    clusters numbered 0.. by their smallest member id."""
    cc = connected_components(points.select("id"), edges.where(F.col("weight") <= eps))
    sizes = cc.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_cluster_size)
    return cc.join(row_numbers(sizes.select("comp"), ["comp"], "cluster"), "comp", "left").select(
        "id", F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"))


# --- minimum spanning tree -------------------------------------------------------------

def _lightest_fn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per component of a block: its lightest edge to another component, ties
    by the smaller, then the larger end.  Points whose component has a lighter
    edge than any in this pair of blocks are left out."""
    out = [pd.DataFrame({"comp": np.zeros(0, np.int64), "weight": np.zeros(0), "src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})]
    for left, right in sides(pdf):
        left = left[left["bound"] >= left["lower"]]
        if left.empty:
            continue
        lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
        lc, rc = left["comp"].to_numpy(), right["comp"].to_numpy()
        lcore, rcore = left["core"].to_numpy(), right["core"].to_numpy()
        L, R = vectors(left), vectors(right)
        with np.errstate(over="ignore"):
            lsq, rsq = lcore * lcore, rcore * rcore
        for rows, W, err in near_squares(L, R):
            apart = lc[rows][:, None] != rc[None, :]
            if np.isfinite(err).all() and np.isfinite(lsq).all() and np.isfinite(rsq).all():
                np.maximum(W, lsq[rows][:, None], out=W)
                np.maximum(W, rsq[None, :], out=W)
                W[~apart] = np.inf
                high = W.min(1) * (1 + 1e-12) + err   # the square of the point's lightest edge is no larger
                least = pd.Series(high).groupby(lc[rows]).transform("min").to_numpy()
                apart &= W <= (least + err)[:, None]
            r, c = np.nonzero(apart)
            r = r + rows.start
            weight = np.maximum(np.maximum(pair_distances(L, R, r, c), lcore[r]), rcore[c])
            ok = np.isfinite(weight)
            r, c, weight = r[ok], c[ok], weight[ok]
            near = pd.DataFrame({"comp": lc[r], "weight": weight, "src": np.minimum(lid[r], rid[c]), "dst": np.maximum(lid[r], rid[c])})
            out.append(near.sort_values(["comp", "weight", "src", "dst"]).drop_duplicates("comp"))
    found = pd.concat(out, ignore_index=True)
    return found.sort_values(["comp", "weight", "src", "dst"]).drop_duplicates("comp")


def _leaving(edges: DataFrame, lab: DataFrame) -> DataFrame:
    """(comp, weight, src, dst): the edges between components, for both ends."""
    both = edges.join(lab.toDF("src", "a"), "src").join(lab.toDF("dst", "b"), "dst").where("a <> b")
    return both.select(F.explode(F.array("a", "b")).alias("comp"), "weight", "src", "dst")


def _bounds(blocks: MetricBlocks, info: pd.DataFrame) -> np.ndarray:
    """Per block a weight that the lightest edge leaving each of its components
    can't exceed: from known edges; for a block within one component from the
    farthest that the members of any block outside it may be; for any other
    block from its own extent."""
    one, comp = (info["low"] == info["high"]).to_numpy(), info["low"].to_numpy()
    core, known, ranges = info["core_high"].to_numpy(), info["known"].to_numpy(), blocks.ranges

    def at(i):
        far = np.maximum(np.maximum(ranges.upper(i), core), core[i])
        if one[i]:
            far[one & (comp == comp[i])] = np.inf
        return pd.DataFrame({"block": [i], "far": [far.min() if one[i] else far[i]]})

    far = blocks.each(at, "block long, far double").toPandas().sort_values("block")["far"].to_numpy()
    least = pd.Series(far[one]).groupby(comp[one]).transform("min").to_numpy()
    far[one] = least
    return np.minimum(far, known)


def minimum_spanning_tree(points: DataFrame, core: DataFrame, block_size: int | None = None, neigh: DataFrame | None = None,
                          blocks: MetricBlocks | None = None, formed: list | None = None) -> DataFrame:
    """The minimum spanning tree of the mutual reachability graph over
    all pairs, as edges (src < dst, weight), ordered by (weight, src, dst)
    where weights tie.  ``neigh`` (from ``knn``) bounds the first rounds;
    ``formed`` receives the number of block pairs of each round."""
    blocks = blocks or metric_blocks(points, block_size)
    p = cut_lineage(blocks.points.join(core.select("id", F.col("core_distance").alias("core")), "id"))
    known = cut_lineage(mutual_reachability(neigh, core)) if neigh is not None else None
    lab, parts = cut_lineage(p.select("id", F.col("id").alias("comp"))), []
    while lab.agg(F.min("comp") != F.max("comp")).first()[0]:
        placed = p.join(lab, "id")
        if known is not None:
            light = cut_lineage(_leaving(known, lab).groupBy("comp").agg(F.min(F.struct("weight", "src", "dst")).alias("e")).select("comp", "e.*"))
            placed = placed.join(light.select("comp", F.col("weight").alias("known")), "comp", "left")
        else:
            light, placed = None, placed.withColumn("known", F.lit(None).cast("double"))
        placed = cut_lineage(placed.withColumn("known", F.coalesce("known", F.lit(float("inf")))))
        info = placed.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("core").alias("core_low"),
                                           F.max("core").alias("core_high"), F.max("known").alias("known")).toPandas().sort_values("block")   # a row per block
        low, high, least, bound = info["low"].to_numpy(), info["high"].to_numpy(), info["core_low"].to_numpy(), _bounds(blocks, info)

        def wanted(i, lower, low=low, high=high, least=least, bound=bound):
            apart = (low != high) | (low[i] != high[i]) | (low != low[i])
            return apart & (np.maximum(np.maximum(lower, least[i]), least) <= np.maximum(bound[i], bound))

        pairs = cut_lineage(blocks.pairs(wanted))
        if formed is not None:
            formed.append(pairs.count())
        limit = points.sparkSession.createDataFrame(pd.DataFrame({"block": np.arange(len(bound)), "limit": bound}))   # a row per block
        placed = placed.join(F.broadcast(limit), "block").withColumn("bound", F.least("known", "limit"))
        found = blocks.meet(placed, pairs).groupBy("bi", "bj").applyInPandas(
            _lightest_fn, "comp long, weight double, src long, dst long")
        found = found if light is None else found.unionByName(light)
        pick = found.groupBy("comp").agg(F.min(F.struct("weight", "src", "dst")).alias("e")).select("comp", "e.*")
        pick = cut_lineage(pick)   # a row per component
        parts.append(pick.select("src", "dst", "weight").distinct())
        at = lab.select(F.col("id"), F.col("comp").alias("c"))
        ends = pick.join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst")
        merged = follow_picks(cut_lineage(ends.select("comp", F.when(F.col("a") == F.col("comp"), F.col("b")).otherwise(F.col("a")).alias("to"))))
        lab = cut_lineage(lab.join(merged, "comp").select("id", F.col("to").alias("comp")))
    if not parts:
        return points.sparkSession.createDataFrame([], "src long, dst long, weight double")
    tree = parts[0]
    for part in parts[1:]:
        tree = tree.unionByName(part)
    return cut_lineage(tree)


# --- cluster choice -----------------------------------------------------------------------

def cluster_levels(points: DataFrame, tree: DataFrame, sizes) -> DataFrame:
    """(id, size, level): the edge (weight, src, dst) with which the point's
    component reaches each of ``sizes`` points, edges taken in that order (no row
    if it never does).  One search from each point along the first edge that leaves
    what it has reached serves all sizes; from one vertex only the first edges, as
    many as the largest size, can matter."""
    edge = "struct<weight:double,src:bigint,dst:bigint>"
    size, wanted = max(sizes), sorted({s for s in sizes if s > 1})
    bottom = F.struct(F.lit(0.0).alias("weight"), F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"))
    at = lambda s, level: F.struct(F.lit(s).alias("size"), level.cast(edge).alias("level"))
    rows = F.array(*[at(s, bottom) for s in sorted({s for s in sizes if s <= 1})]).cast(f"array<struct<size:int,level:{edge}>>")
    state = points.select("id", F.col("id").alias("at"), F.array("id").alias("seen"), rows.alias("levels"))
    if wanted:
        both = tree.select(F.col("src").alias("at"), "weight", "src", "dst", F.col("dst").alias("to")).unionByName(
            tree.select(F.col("dst").alias("at"), "weight", "src", "dst", F.col("src").alias("to")))
        w = Window.partitionBy("at").orderBy("weight", "src", "dst")
        near = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
        near = near.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("weight", "src", "dst", "to"))).alias("edges"))   # at most ``size`` edges
        near = cut_lineage(near)
    none = F.array().cast("array<struct<weight:double,src:bigint,dst:bigint,to:bigint>>")
    state = state.select("*", none.alias("open"), F.lit(None).cast(edge).alias("level"))
    old = []
    for step in range(size - 1):
        state = state.join(near, "at", "left").select("id", "seen", "levels", "level", F.sort_array(F.concat("open", F.coalesce("edges", none))).alias("open"))
        state = state.select("id", "seen", "levels", "level", F.filter("open", lambda e: ~F.array_contains(F.col("seen"), e["to"])).alias("open"))
        first = F.get("open", F.lit(0))
        state = state.select("id", first["to"].alias("at"), F.when(first["to"].isNotNull(), F.concat("seen", F.array(first["to"]))).otherwise(F.col("seen")).alias("seen"),
                             "levels", F.slice("open", 2, size).alias("open"),
                             F.greatest("level", F.struct(first["weight"].alias("weight"), first["src"].alias("src"), first["dst"].alias("dst")).cast(edge)).alias("level"))
        if step + 2 in wanted:
            reached = F.concat("levels", F.array(at(step + 2, F.col("level"))))
            state = state.withColumn("levels", F.when(F.size("seen") == step + 2, reached).otherwise(F.col("levels")))
        if step % 4 == 3:
            state = cut_lineage(state)
            release(*old)
            old = [state]
    out = cut_lineage(state.select("id", F.explode("levels").alias("l")).select("id", "l.*"))
    release(*old, *([near] if wanted else []))
    return out


def _chosen(points: DataFrame, tree: DataFrame, level: DataFrame) -> DataFrame:
    """(id, label) of the points in the clusters that excess of mass chooses in a
    tree, or in each of several trees without common points.  ``level``: id, level
    (from ``cluster_levels``)."""
    end = lambda c, r: level.select(F.col("id").alias(c), F.col("level").alias(r))
    edges = tree.join(end("src", "rs"), "src", "left").join(end("dst", "rd"), "dst", "left")
    own = F.struct("weight", "src", "dst")
    is_split = F.coalesce((F.col("rs") < own) & (F.col("rd") < own), F.lit(False))
    edges = cut_lineage(edges.select("src", "dst", "weight", is_split.alias("split")))
    atoms = connected_components(points, edges.where("not split")).withColumnRenamed("comp", "atom")
    end = lambda c, a: atoms.select(F.col("id").alias(c), F.col("atom").alias(a))
    splits = edges.where("split").join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("weight", "src", "dst", "a", "b")
    return excess_of_mass(atoms.join(level, "id"), splits)


def eom_select(points: DataFrame, tree: DataFrame, min_cluster_size: int) -> DataFrame:
    """C06e: excess-of-mass selection; (id, cluster), noise -1, clusters
    numbered by their smallest member."""
    members = _chosen(points, tree, cluster_levels(points, tree, [min_cluster_size]).select("id", "level"))
    order = members.groupBy("label").agg(F.min("id").alias("first"))
    numbers = row_numbers(order, ["first"], "cluster").select("label", F.col("cluster").cast("int").alias("cluster"))
    return points.select("id").join(members.join(numbers, "label").select("id", "cluster"), "id", "left").select(
        "id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def eom_grid(points: DataFrame, trees: dict, grid) -> DataFrame:
    """``eom_select`` for each (min_cluster_size, key of its tree) of ``grid``:
    (cell, id, cluster), cell the place in the grid.  All cells go through the same
    jobs as one forest: point nr of n is vertex ``cell * n + nr`` of its cell."""
    spark = points.sparkSession
    ids = cut_lineage(row_numbers(points.select("id").where("id is not null").distinct(), ["id"], "nr"))
    n, names = max(1, ids.count()), list(trees)
    ends = [trees[name].join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").select(
        F.lit(t).alias("tree"), (F.col("s") + t * n).alias("src"), (F.col("d") + t * n).alias("dst"), "weight") for t, name in enumerate(names)]
    forest = ends[0]
    for more in ends[1:]:
        forest = forest.unionByName(more)
    forest = cut_lineage(forest)
    vertices = lambda k: ids.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("k"), "nr").select((F.col("k") * n + F.col("nr")).alias("id"))
    levels = cluster_levels(vertices(len(names)), forest, [size for size, _ in grid])
    cells = spark.createDataFrame([(i, names.index(t), size) for i, (size, t) in enumerate(grid)], "cell long, tree long, size int")   # a row per cell
    moved = (F.col("cell") - F.col("tree")) * n
    levels = levels.withColumn("tree", F.floor(F.col("id") / n)).join(F.broadcast(cells), ["tree", "size"]).select(
        (F.col("id") + moved).alias("id"), F.struct(F.col("level.weight").alias("weight"), (F.col("level.src") + moved).alias("src"), (F.col("level.dst") + moved).alias("dst")).alias("level"))
    edges = forest.join(F.broadcast(cells), "tree").select((F.col("src") + moved).alias("src"), (F.col("dst") + moved).alias("dst"), "weight")
    members = _chosen(vertices(len(grid)), cut_lineage(edges), cut_lineage(levels))
    order = members.groupBy("label").agg(F.min("id").alias("first"))
    cell = lambda c: F.floor(F.col(c) / n).alias("cell")
    numbers = cut_lineage(row_numbers(order, ["first"], "number").select("label", "number", cell("first")))
    before = numbers.groupBy("cell").agg(F.min("number").alias("before"))   # a row per cell
    found = members.join(numbers, "label").join(F.broadcast(before), "cell").select(
        "cell", (F.col("id") - F.col("cell") * n).alias("nr"), (F.col("number") - F.col("before")).cast("int").alias("cluster")).join(ids, "nr")
    every = points.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(grid) - 1).cast("long"))).alias("cell"))
    return every.join(found.select("cell", "id", "cluster"), ["cell", "id"], "left").select("cell", "id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def density_sweep(points: DataFrame, grid, block_size: int | None = None) -> list[DataFrame]:
    """Clusterings for each (min_cluster_size, min_samples): one neighbour pass
    for all (smaller ``min_samples`` are prefixes of it), one tree per
    ``min_samples``, made side by side; all cells are cut from them together.
    Points without a finite vector are noise."""
    grid = list(grid)
    placed = cut_lineage(usable_points(points).select("id", "v"))
    blocks = metric_blocks(placed, block_size)
    neigh = cut_lineage(knn(placed, max(ms for _, ms in grid), True, block_size, blocks))
    spark, samples = points.sparkSession, sorted({ms for _, ms in grid})
    trees = dict(zip(samples, at_once(
        spark, lambda ms: minimum_spanning_tree(placed, core_distances(neigh, ms), block_size, neigh.where(F.col("rank") <= ms), blocks), samples), strict=True))
    rest = unusable_points(points).select("id", F.lit(NOISE).alias("cluster"))
    found = cut_lineage(eom_grid(placed, trees, grid).repartitionByRange("cell", "id"))   # a cell in few files
    return [found.where(F.col("cell") == i).select("id", "cluster").unionByName(rest) for i in range(len(grid))]


def density_cluster(points: DataFrame, min_cluster_size: int, min_samples: int, block_size: int | None = None) -> DataFrame:
    """Full density clustering for one parameter pair."""
    return density_sweep(points, [(min_cluster_size, min_samples)], block_size)[0]
