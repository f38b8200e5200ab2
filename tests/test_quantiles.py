"""The bounded-memory exact quantile operators equal numpy's interpolated
percentiles, including ties, a hot group and forced window refinement."""

import numpy as np
import pytest

from cardprism.operators.quantiles import column_quantiles, grouped_quantiles, histogram_quantiles


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(7)
    rows = []
    for g in range(5):
        n = 3000 if g == 0 else 20 + 7 * g          # group 0 is "hot"
        vals = np.round(rng.lognormal(3, 1, n), 2)
        if g == 1:
            vals[:10] = 5.0                          # ties
        rows += [(g, float(v)) for v in vals]
    rows.append((5, None))                           # a group with no values
    return spark.createDataFrame(rows, "g int, x double"), rows


def expected(rows, probs):
    out = {}
    for g in {r[0] for r in rows}:
        v = np.array([r[1] for r in rows if r[0] == g and r[1] is not None])
        if len(v):
            out[g] = [float(np.percentile(v, p * 100)) for p in probs]
    return out


@pytest.mark.parametrize("max_window", [200_000, 50])
def test_grouped(data, max_window):
    df, rows = data
    probs = [0.25, 0.5, 0.75]
    got = {r["g"]: [r["a"], r["b"], r["c"]] for r in
           grouped_quantiles(df, ["g"], "x", probs, ["a", "b", "c"], max_window=max_window).collect()}
    exp = expected(rows, probs)
    assert set(got) == set(exp)
    for g in exp:
        assert got[g] == pytest.approx(exp[g], abs=1e-9)


def test_histogram_with_hot_group(data, spark):
    df, rows = data
    sizes = df.groupBy("g").agg({"x": "count"}).withColumnRenamed("count(x)", "_n")
    got = {r["g"]: r["m"] for r in histogram_quantiles(df, ["g"], "x", [0.5], ["m"], sizes, max_group=100).collect()}
    exp = expected(rows, [0.5])
    for g in exp:
        assert got[g] == pytest.approx(exp[g][0], abs=1e-9)


def test_global_columns(spark):
    rng = np.random.RandomState(1)
    a, b = rng.normal(size=101), rng.randint(0, 5, size=101).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {r["feature"]: r["q"] for r in column_quantiles(df, ["a", "b"], [0.5], ["q"]).collect()}
    assert got["a"] == pytest.approx(np.median(a))
    assert got["b"] == pytest.approx(np.median(b))


def test_windows_that_cannot_shrink_end_the_narrowing(spark):
    """One value fills the window: the histogram holds it in one row."""
    from cardprism.operators.quantiles import grouped_quantiles
    df = spark.range(0, 5000).selectExpr("case when id < 4000 then 7.0 else id end as x", "1 as g")
    q = grouped_quantiles(df, ["g"], "x", [0.5, 0.9], ["a", "b"], accuracy=50, max_window=20).first()
    assert (q["a"], q["b"]) == (7.0, 4499.1)


EDGES = [0.0, -0.0, 1e-300, -1e-300, 5e-324, 1.0, 1.0 + 2**-52, 1.0 + 2**-24, 1.0 - 2**-53, 2.0, -2.0, -2.0 - 2**-50, 1e300, -1e300,
         float("inf"), float("-inf"), 3.5e38, 3.6e38, 2.0**0.5, 7.25, 7.25]


def test_ordered_quantiles_equal_sorting(spark):
    """Ties, tiny and huge values, values that share a float, one row, nulls."""
    from cardprism.operators.quantiles import ordered_quantiles
    rng = np.random.RandomState(3)
    groups = {0: EDGES[:14] + EDGES[16:], 1: [5.0], 2: [3.0] * 50 + [4.0] * 50, 3: (1 + rng.randint(0, 50, 400) * 2.0**-52).tolist(),
              4: np.round(rng.lognormal(3, 2, 3000), 2).tolist(), 5: (-rng.lognormal(0, 9, 501)).tolist(), 7: [1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [(6, None), (1, None), (4, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: list(r)[1:] for r in ordered_quantiles(df, ["g"], "x", probs, list("abcde")).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, probs).tolist(), rel=1e-12, abs=0), g
    edge = spark.createDataFrame([(1, x) for x in EDGES], "g int, x double")
    ranks = [i / (len(EDGES) - 1) for i in range(len(EDGES))]
    found = list(ordered_quantiles(edge, ["g"], "x", ranks, [f"q{i}" for i in range(len(EDGES))]).first())[1:]
    assert all(x in (a, b) or a <= x <= b for x, a, b in zip(found, sorted(EDGES), sorted(EDGES)[1:] + [float("inf")], strict=True))


def test_the_first_digit_rises_with_the_value(spark):
    from cardprism.operators.quantiles import _coarse
    rng = np.random.RandomState(4)
    xs = sorted(EDGES + [s * 2.0 ** (k / 256) * (1 + e) for s in (1, -1) for k in rng.randint(-3000, 3000, 300) for e in (-1e-16, 0, 1e-16)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = [r.e for r in df.select("i", _coarse(df.x).alias("e")).orderBy("i").collect()]
    assert got == sorted(got)


def test_a_card_with_a_third_of_all_rows_is_spread(spark):
    """Its rows lie in many partitions wherever they are distributed."""
    from cardprism.operators.quantiles import _coarse, ordered_quantiles
    df = spark.range(0, 60_000).selectExpr("case when id % 3 = 0 then 0 else id end as g", "pmod(xxhash64(id), 100000) / 100.0D as x")
    got = {r.g: r.m for r in ordered_quantiles(df, ["g"], "x", [0.5], ["m"]).where("g < 3").collect()}
    heavy = sorted(r.x for r in df.where("g = 0").collect())
    assert got[0] == (heavy[9999] + heavy[10000]) / 2 and set(got) == {0, 1, 2}
    coded = df.withColumn("e", _coarse(df.x)).repartition(16, "g", "e").where("g = 0")
    parts = coded.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 20_000 / 4
