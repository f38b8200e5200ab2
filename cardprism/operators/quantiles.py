"""Exact, interpolated quantiles per group without holding a group in one task.

Spark's exact ``percentile``/``median`` aggregates keep every distinct value
of a group in one buffer, merged in a single final task: a hot card (or a
quantile over millions of cards) would end in one task.  This operator gives
the same numbers (linear interpolation between order statistics, as DuckDB
``quantile_cont`` / pandas ``median``) in bounded memory:

1. sketch pass: ``percentile_approx`` (mergeable, partial-aggregated)
   brackets each target rank with a narrow value window ``[lo, hi]``;
   groups so large that the window could exceed ``max_window`` values are
   narrowed further with a finer sketch restricted to the window rows;
2. selection pass: rows below ``lo`` collapse into one count, rows inside the
   window into a (value, count) histogram (ties of a hot value become one
   row); a running sum over at most ``max_window`` entries finds the two
   order statistics and *verifies* the bracket, so exactness never rests on
   the sketch's error bound;
3. groups whose bracket failed (not expected) are recomputed over their
   full ``[min, max]`` range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.session import cut_lineage

_BCOLS = ("_i", "_p", "_n", "_mn", "_mx", "_pos", "_r0", "_r1", "_lo", "_hi")


def grouped_quantiles(df: DataFrame, keys, value: str, probs, names=None, *,
                      accuracy: int = 10000, max_window: int = 200_000,
                      bounded_groups: bool = False) -> DataFrame:
    """Return one row per group with columns ``keys + names`` (one per prob).

    ``bounded_groups=True`` states that the number of groups is small and
    fixed (feature names, cluster ids), which allows broadcasting the
    per-group bounds; otherwise AQE plans the join from runtime sizes.
    Groups without non-null values are absent (callers left-join)."""
    keys = list(keys)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    gkeys = keys or ["_g"]
    small = bounded_groups or not keys
    x = F.col(value).cast("double")
    base = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if not keys:
        base = base.withColumn("_g", F.lit(0))

    margin = 4.0 / accuracy
    mprobs = []
    for p in probs:
        mprobs += [max(0.0, p - margin), min(1.0, p + margin)]
    stats = base.groupBy(*gkeys).agg(
        F.count("_x").alias("_n"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"),
        F.percentile_approx("_x", mprobs, accuracy).alias("_qa"))
    per_q = [F.struct(F.lit(i).alias("_i"), F.lit(p).alias("_p"),
                      F.col("_qa")[2 * i].alias("_lo"), F.col("_qa")[2 * i + 1].alias("_hi"))
             for i, p in enumerate(probs)]
    bounds = (stats.select(*gkeys, "_n", "_mn", "_mx", F.explode(F.array(*per_q)).alias("_b"))
              .select(*gkeys, "_n", "_mn", "_mx", "_b.*")
              .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
              .withColumn("_r0", F.floor("_pos").cast("long"))
              .withColumn("_r1", F.ceil("_pos").cast("long"))
              .select(*gkeys, *_BCOLS))
    bounds = _materialise(bounds, small)

    def join_bounds(b):
        return base.join(F.broadcast(b) if small else b, gkeys)

    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    # a window holds about 2 * margin * n values; only larger groups need narrowing
    big_n = int(max_window / (2.5 * margin))
    last = None
    while True:   # until no window is too large, or none of them shrinks (one value fills it)
        now = bounds.where(F.col("_n") > big_n).agg(F.count(F.lit(1)), F.sum("_n")).first()
        if not now[0] or now == last:
            break
        last = now
        big = bounds.where(F.col("_n") > big_n)
        counts = join_bounds(big).groupBy(*gkeys, "_i").agg(
            F.count_if(F.col("_x") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_win"))
        big = big.join(counts, gkeys + ["_i"])
        grid_n = 1000
        grid = [j / grid_n for j in range(grid_n + 1)]
        sketch = (base.join(big.where(F.col("_win") > max_window).select(*gkeys, "_i", "_lo", "_hi"), gkeys)
                  .where(inside).groupBy(*gkeys, "_i")
                  .agg(F.percentile_approx("_x", grid, accuracy * 100).alias("_grid")))
        t0 = (F.col("_r0") - F.col("_below")) / F.col("_win")
        t1 = (F.col("_r1") - F.col("_below") + 1) / F.col("_win")
        lo_i = F.greatest(F.floor(t0 * grid_n) - 2, F.lit(0)).cast("int")
        hi_i = F.least(F.ceil(t1 * grid_n) + 2, F.lit(grid_n)).cast("int")
        refined = (big.join(sketch, gkeys + ["_i"])
                   .withColumn("_lo", F.element_at("_grid", lo_i + 1))
                   .withColumn("_hi", F.element_at("_grid", hi_i + 1))
                   .withColumn("_n", F.col("_win"))       # now bounded by the window size
                   .select(*gkeys, *_BCOLS))
        rest = bounds.join(refined.select(*gkeys, "_i"), gkeys + ["_i"], "left_anti")
        bounds = cut_lineage(rest.unionByName(refined))

    res = _materialise(_select(join_bounds(bounds), gkeys), small)
    failed = res.where(~F.col("_ok"))
    any_failed = (not all(r["_ok"] for r in res.collect())) if small else failed.limit(1).count() > 0
    if any_failed:
        full = (bounds.join(failed.select(*gkeys, "_i"), gkeys + ["_i"])
                .withColumn("_lo", F.col("_mn")).withColumn("_hi", F.col("_mx")))
        res = res.where(F.col("_ok")).unionByName(_select(join_bounds(full), gkeys))
    out = res.groupBy(*gkeys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n)
                                    for i, n in enumerate(names)])
    return out.drop("_g") if not keys else out


def _materialise(df: DataFrame, small: bool) -> DataFrame:
    """Per-group bound / result tables: with a bounded number of groups they
    are collected (groups x quantiles rows) and re-created locally, else
    checkpointed to the shared checkpoint folder."""
    if small:
        return df.sparkSession.createDataFrame(df.collect(), df.schema)
    return cut_lineage(df)


def _select(joined: DataFrame, gkeys) -> DataFrame:
    """Histogram of the window (plus one 'below' bucket) -> order statistics."""
    rows = joined.where(F.col("_x") <= F.col("_hi"))
    inwin = F.col("_x") >= F.col("_lo")
    hist = rows.groupBy(*gkeys, "_i", "_pos", "_r0", "_r1", inwin.alias("_in"),
                        F.when(inwin, F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*gkeys, "_i").orderBy("_in", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_c").over(w))
    sel = hist.groupBy(*gkeys, "_i", "_pos", "_r0", "_r1").agg(
        F.coalesce(F.sum(F.when(~F.col("_in"), F.col("_c"))), F.lit(0)).alias("_below"),
        F.sum("_c").alias("_tot"),
        F.min(F.when(F.col("_in") & (F.col("_cum") > F.col("_r0")), F.col("_v"))).alias("_v0"),
        F.min(F.when(F.col("_in") & (F.col("_cum") > F.col("_r1")), F.col("_v"))).alias("_v1"))
    ok = (F.col("_below") <= F.col("_r0")) & (F.col("_tot") >= F.col("_r1") + 1)
    return sel.select(*gkeys, "_i", ok.alias("_ok"),
                      (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_pos") - F.col("_r0"))).alias("_q"))


def column_quantiles(df: DataFrame, columns, probs, names=None, **kw) -> DataFrame:
    """Exact quantiles of several columns at once: unpivot to (feature, x)
    and group by the feature name (a bounded set of groups)."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "x")
    return grouped_quantiles(long, ["feature"], "x", probs, names, bounded_groups=True, **kw)


def _coarse(x):
    """A long that rises with x: sign and 1/256 octaves of its size (``log2``
    rises or stays as its argument rises, so equal or larger x never get a
    smaller one).  At most about a million values."""
    octave = F.when(F.abs(x) == float("inf"), F.lit(1_000_000)).otherwise(F.floor(F.log2(F.abs(x)) * 256) + 300_000)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * octave).cast("long")


def ordered_quantiles(df: DataFrame, keys, value: str, probs, names) -> DataFrame:
    """Exact quantiles for MANY groups of any size (e.g. one median per card),
    as one lazy plan: no job before the caller's action, no cache, no list of
    large groups, nothing broadcast by hand.

    The order statistics are found digit by digit.  Rows collapse into (group,
    value, count), spread by group *and* value.  A first digit (1/256 octave)
    has at most a million values whatever the data: its counts, summed up per
    group, tell in which bin each wanted rank lies.  Only these bins' rows are
    looked at again: by their value as a float (some 20,000 in a bin), then by
    the value itself (the doubles that round to one float).  So a group with a
    third of all rows is never sorted or held by one task; its windows run over
    bins.  The rows' second distribution, by group and bin, serves both
    looks.  Groups without non-null values are absent (callers left-join)."""
    keys = list(keys)
    x = F.col(value).cast("double")
    base = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    hist = base.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_e", _coarse(F.col("_x")))
    spread = hist.select(*keys, "_e", "_x", "_c").repartition(*keys, "_e")

    def sums(counts, within, order):
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))

    def holds(rank):
        return (rank >= F.col("_from")) & (rank < F.col("_to"))

    bins = sums(hist.groupBy(*keys, "_e").agg(F.sum("_c").alias("_c")), keys, "_e")
    bins = bins.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        wanted += [F.struct(F.lit(2 * i + up).alias("_i"), at.alias("_pos"), rank.cast("long").alias("_rank")) for up, rank in enumerate((F.floor(at), F.ceil(at)))]
    bins = bins.select(*keys, "_e", "_from", F.explode(F.filter(F.array(*wanted), lambda r: holds(r["_rank"]))).alias("_w"))
    bins = bins.select(*keys, "_e", "_w._i", "_w._pos", (F.col("_w._rank") - F.col("_from")).alias("_rank"))
    rank = [*keys, "_i"]
    narrow = F.col("_x").cast("float")
    floats = spread.join(bins, [*keys, "_e"]).groupBy(*rank, "_e", "_pos", "_rank", narrow.alias("_f")).agg(F.sum("_c").alias("_c"))
    floats = sums(floats, rank, "_f").where(holds(F.col("_rank")))
    floats = floats.select(*rank, "_e", "_pos", "_f", (F.col("_rank") - F.col("_from")).alias("_rank"))
    # "not less and not more" instead of "=": so the rows stay where they are, spread by group and bin
    exact = spread.join(floats, [*keys, "_e"]).where((narrow >= F.col("_f")) & (narrow <= F.col("_f")))
    exact = exact.groupBy(*rank, "_pos", "_rank", "_x").agg(F.sum("_c").alias("_c"))
    exact = sums(exact, rank, "_x").where(holds(F.col("_rank")))
    out = []
    for i, name in enumerate(names):
        low, high = (F.max(F.when(F.col("_i") == 2 * i + up, F.col("_x"))) for up in (0, 1))
        pos = F.max(F.when(F.col("_i") == 2 * i, F.col("_pos")))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos))).alias(name))
    return exact.groupBy(*keys).agg(*out)


def with_places(df: DataFrame, keys, value: str, place: str = "_place", size: str = "_size") -> DataFrame:
    """``df`` with each row's place (from 0) among its group's non-null values
    and their number, for ``place_quantile`` in the caller's own aggregation by
    ``keys``: rows that are to be grouped anyway are moved once for both.  Nulls
    come last.  A group's rows are sorted by one task and may spill; groups that
    hold much of the data are better served by ``ordered_quantiles``."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    return df.withColumn(place, F.row_number().over(order) - 1).withColumn(
        size, F.count(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def place_quantile(value: str, prob: float, place: str = "_place", size: str = "_size"):
    """Aggregate: the interpolated quantile of a group of ``with_places`` rows
    (null without non-null values), the same numbers as ``ordered_quantiles``."""
    at, x = F.lit(float(prob)) * (F.col(size) - 1), F.col(value)
    low, high = (F.max(F.when(x.isNotNull() & (F.col(place) == rank), x)) for rank in (F.floor(at), F.ceil(at)))
    return F.when(low == high, low).otherwise(low + (high - low) * F.max(at - F.floor(at)))


def histogram_quantiles(df: DataFrame, keys, value: str, probs, names, group_sizes: DataFrame | None = None, *,
                        max_group: int | None = None) -> DataFrame:
    """``ordered_quantiles``, which needs neither the groups' sizes nor a limit."""
    return ordered_quantiles(df, keys, value, probs, names)
