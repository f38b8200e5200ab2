"""Preprocessing invariants, profile rules and sources."""

import numpy as np
import pytest

from cardprism.operators import preprocess as PP
from cardprism.operators import profiles as PR
from cardprism.sources.readers import detect_format, load_transactions


@pytest.fixture(scope="module")
def mat(spark):
    rng = np.random.RandomState(42)
    X = rng.normal(size=(300, 4)) * [1, 10, 100, 0.1] + [0, 5, -3, 1]
    X[:, 3] = X[:, 0] * 0.99 + rng.normal(scale=0.01, size=300)       # correlated with column a
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in X], "a double, b double, c double, d double")
    return df, X


def test_robust_scale_matches_numpy(mat):
    df, X = mat
    p = PP.robust_params(df, ["a", "b", "c", "d"])
    for i, c in enumerate("abcd"):
        q1, md, q3 = np.percentile(X[:, i], [25, 50, 75])
        assert p[c][0] == pytest.approx(md) and p[c][1] == pytest.approx(q3 - q1)


def test_drop_rule_and_pca(mat):
    df, X = mat
    corr = PP.correlation_matrix(df, list("abcd"))
    assert corr == pytest.approx(np.corrcoef(X.T), abs=1e-9)
    assert PP.drop_rule(corr, 0.8) == [3]
    fit = PP.pca_fit(df, list("abcd"), None)
    assert fit["all_ratio"].sum() == pytest.approx(1.0)
    assert fit["all_variance"].sum() == pytest.approx(np.trace(np.cov(X.T)))
    scores = np.array([list(r)[1:] for r in PP.pca_project(df.withColumn("card_id", df.a * 0), list("abcd"), fit).collect()])
    assert scores.mean(0) == pytest.approx(np.zeros(4), abs=1e-8)


def test_yeo_johnson_identity_and_fit(mat, spark):
    df, X = mat
    one = df.select(PP.yeo_johnson(df.a, 1.0).alias("y"), "a").collect()
    assert all(r["y"] == pytest.approx(r["a"]) for r in one)
    lam = PP.yj_fit(df, ["a"], rounds=3)
    assert -2.0 <= lam["a"] <= 2.0


def _yj_loglik(x, lam):
    """Log-likelihood the plain way, for moderate values."""
    pos, neg = np.maximum(x, 0), np.maximum(-x, 0)
    a = np.log1p(pos) if abs(lam) < 1e-12 else ((1 + pos) ** lam - 1) / lam
    b = np.log1p(neg) if abs(lam - 2) < 1e-12 else ((1 + neg) ** (2 - lam) - 1) / (2 - lam)
    return -len(x) / 2 * np.log((a - b).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def _golden(f, lo, hi):
    g = (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-8:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if f(a) > f(b) else (a, hi)
    return (lo + hi) / 2


def test_yeo_johnson_has_no_bounds(spark):
    """Optima inside and far outside [-2, 2], on both sides; a constant, an
    empty and an all but constant column."""
    z = np.random.RandomState(8).normal(size=1500)
    columns = {}
    for name, lam in (("a", 0.4), ("b", 2.9), ("c", 10.0), ("d", 25.0)):
        y = 1 + 0.1 * z / max(1.0, np.abs(z).max() / 4)
        columns[name] = (lam * y + 1) ** (1 / lam) - 1   # psi(x) = y
    for name in "bcd":
        columns[f"m{name}"] = -columns[name]   # mirrored: 2 - lambda
    columns["k"], columns["e"] = np.full(1500, 3.0), np.full(1500, np.nan)
    names = sorted(columns)
    df = spark.createDataFrame([[float(columns[c][i]) for c in names] for i in range(1500)], names).repartition(5)
    got = PP.yj_fit(df, names)
    assert got["k"] == 1.0 and got["e"] == 1.0
    for c in names:
        if c not in "ke":
            # the likelihood itself is flat to about 1e-8 of lambda's scale
            assert got[c] == pytest.approx(_golden(lambda lam, x=columns[c]: _yj_loglik(x, lam), -60, 60), abs=1e-4)
    assert got["c"] > 5 and got["d"] > 15 and got["mc"] < -3 and got["md"] < -13


def test_yeo_johnson_likelihood_does_not_overflow(spark):
    x = np.exp(np.random.RandomState(9).normal(size=300) * 2 + 6)
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "a double, b double")
    grid = [-90.0, -3.0, 0.0, 2.0, 60.0, 150.0]
    ll = {(r.feature, r.lam): r.ll for r in PP.yj_loglik_grid(df, ["a", "b"], {"a": grid, "b": [2 - g for g in grid]}).collect()}
    assert all(ll["a", g] == pytest.approx(ll["b", 2 - g], rel=1e-9) for g in grid if ll["a", g] is not None)
    assert ll["a", 60.0] is not None and ll["a", 150.0] is not None and ll["a", 150.0] < ll["a", 60.0] < ll["a", 2.0]


def test_profile_rules(spark):
    rows = []
    for cid, amt, dig, tx, clv in [(-1, 1000, 0.1, 10, 1000), (0, 25000, 0.8, 10, 500000), (1, 100, 0.6, 9000, 300000),
                                   (3, 100, 0.04, 2000, 10), (7, 100, 0.5, 10, 100)]:
        rows.append((cid, float(amt), dig, float(tx), 0.5, float(clv), 0.2, 0.6, 0.07, 0.31, 1.5))
    p = spark.createDataFrame(rows, "cluster int, avg_amount double, digital_wallet_usage double, avg_transactions double, payment_sophistication double, "
                                    "clv double, tx_frequency double, activity_consistency double, international_usage double, weekend_activity double, amount_volatility double")
    names = {r["cluster"]: r["segment_name"] for r in PR.name_segments(p).collect()}
    assert names[0] == "Segment 0: large tickets, wallet users"
    assert names[1] == "Segment 1: wallet users, many payments"
    assert names[3] == "Segment 3: few wallets, many payments"
    assert names[7] == "Cluster 7" and names[-1] == "Cluster -1"
    pr = {r["cluster"]: (r["priority"], r["investment_level"]) for r in PR.priority_levels(p).collect()}
    assert pr[0] == ("High", "Standard") and pr[1] == ("Medium", "Standard") and pr[3] == ("Standard", "Standard")
    fc = {r["cluster"]: tuple(r)[1:] for r in PR.forecast(p).collect()}
    assert set(fc[7]) == set(fc[-1]) == {None}
    assert fc[0] == ("some", "nearly complete", "above the portfolio", "small", "first steps")
    rec = {r["cluster"]: r for r in PR.recommend(p, PR.name_segments(p)).collect()}
    assert rec[7]["recommendations"] == [] and len(rec[3]["recommendations"]) == 5
    assert rec[0]["recommendations"][1] == "Assign a named adviser" and rec[0]["recommendations"][2] == "Announce travel cover before holidays"
    bad = spark.createDataFrame([("no json",), ('```json\n{"cluster_1": {"segment_name": "x", "recommendations": ["a"], "priority": "High"}}\n```',), (None,)], "response string")
    plain = PR.parse_responses(bad).collect()
    assert sorted((r["cluster"] or -9, r["parse_error"]) for r in plain) == [(-9, True), (-9, True), (1, False)]
    full = PR.parse_responses(bad, PR.recommend(p, PR.name_segments(p))).collect()
    assert len(full) == 1 + 2 * 5
    assert [r["segment_name"] for r in full if not r["parse_error"]] == ["Segment 1: wallet users, many payments"]
    p2 = p.withColumn("size", p.cluster * 0 + 5)
    ranks = [r["cluster"] for r in PR.rank_segments(p2).where("metric = 'size'").orderBy("rank").collect()]
    assert ranks == [-1, 0, 1, 3, 7]                                # ties keep cluster order


def test_failing_power_transform_raises_or_is_skipped(spark, monkeypatch):
    from cardprism.config import SegmentationConfig
    rng = np.random.RandomState(1)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(60)], "card_id int, a double, b double, c double")

    def broken(*_, **__):
        raise ArithmeticError("no lambda")
    monkeypatch.setattr(PP, "yj_fit", broken)
    with pytest.raises(ArithmeticError):
        PP.fit_preprocess(df, SegmentationConfig(), cols=["a", "b", "c"])
    model = PP.fit_preprocess(df, SegmentationConfig(power_on_error="skip"), cols=["a", "b", "c"])
    assert model.lambdas is None and model.transform(df).count() == 60


def test_statistics_do_not_depend_on_partitions(spark):
    rng = np.random.RandomState(2)
    X = rng.lognormal(size=(500, 3)) + 1e6
    df = spark.createDataFrame([tuple(map(float, x)) for x in X], "a double, b double, c double")
    for n in (1, 7):
        mean, cov, k = PP.covariance(df.repartition(n), ["a", "b", "c"])
        assert k == 500 and mean == pytest.approx(X.mean(0)) and cov == pytest.approx(np.cov(X.T), rel=1e-6)
    assert np.isnan(PP.covariance(df.where("false"), ["a", "b"])[1]).all()


def test_type_and_column_reports(spark):
    from cardprism.operators.validation import column_report, table_profile, type_violations
    bad = spark.createDataFrame([("2020", "x")], "transaction_timestamp string, transaction_amount_kzt string")
    assert {r["column_name"] for r in type_violations(spark, bad).collect()} == {"transaction_timestamp", "transaction_amount_kzt"}
    good = spark.sql("select timestamp'2020-01-01' as transaction_timestamp, 1.5D as transaction_amount_kzt")
    assert type_violations(spark, good).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, 1, "a"), (1, 2, None)], "x int, y int, z string")
    got = {r["column_name"]: (r["present"], r["n_values"]) for r in column_report(df, ("x", "y", "nope")).collect()}
    assert got == {"x": (True, 3), "y": (True, 2), "nope": (False, 0)}
    r = table_profile(df).first()
    assert (r["n_rows"], r["n_columns"], r["missing_cells"], r["duplicate_rows"]) == (4, 3, 4, 1)
    assert table_profile(df.where("false")).first()["n_rows"] == 0


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        detect_format("x.xlsx")
    with pytest.raises(FileNotFoundError):
        load_transactions(spark, str(tmp_path / "missing.parquet"))
    from cardprism.sources.sinks import save_table
    with pytest.raises(ValueError):
        save_table(spark.range(1), str(tmp_path / "o"), "xml")


def test_dictionary_audit(spark, tmp_path):
    from cardprism.operators.validation import dictionary_audit, dictionary_categories
    from cardprism.sources.readers import read_dictionary
    p = tmp_path / "dict.csv"
    p.write_text("# data dictionary\nname,category\ncard_id,raw\nfoo,raw\ntx_count,engineered\n")
    d = read_dictionary(spark, str(p))
    a = {(r["kind"], r["problem"], r["name"]) for r in
         dictionary_audit(spark, d, ["card_id", "merchant_city"], "raw", ["tx_count", "segment"]).collect()}
    assert a == {("raw", "undocumented", "merchant_city"), ("raw", "superfluous", "foo"),
                 ("engineered", "undocumented", "segment")}
    cats = [(r["category"], r["n_fields"]) for r in dictionary_categories(d).collect()]
    assert cats == [("raw", 2), ("engineered", 1)]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "customer_lifetime_value" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
