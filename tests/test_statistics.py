import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from tidemark.operators import statistics


def series(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "t int, v double").repartition(3)


def test_autocorrelation_matches_numpy(spark):
    x = np.random.default_rng(4).normal(size=60).cumsum()
    got = {r["lag"]: r["acf"] for r in statistics.autocorrelation(series(spark, x), "t", "v", 5).collect()}
    d = x - x.mean()
    assert all(abs(got[k] - (d[k:] * d[:-k]).sum() / (d * d).sum()) < 1e-9 for k in range(1, 6))
    flat = statistics.autocorrelation(series(spark, [3, 3, None, 3]), "t", "v", 1).collect()
    assert [tuple(r) for r in flat] == [(1, None)]
    assert statistics.autocorrelation(series(spark, [1, 2]), "t", "v", 4).count() == 4


def test_autocorrelation_by_group(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -1.0), ("a", 3, 1.0), ("a", 4, -1.0), ("b", 1, 2.0)], "g string, t int, v double")
    got = {(r["g"], r["lag"]): r["acf"] for r in statistics.autocorrelation(df, "t", "v", 2, ("g",)).collect()}
    assert got == {("a", 1): -0.75, ("a", 2): 0.5, ("b", 1): None, ("b", 2): None}


def test_unit_root_matches_least_squares(spark):
    x = np.random.default_rng(5).normal(size=80)
    r = statistics.unit_root(series(spark, x), "t", "v").first()
    a = np.column_stack([x[:-1], np.ones(79)])
    y = np.diff(x)
    beta, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    error = np.sqrt(rss[0] / 77 * np.linalg.inv(a.T @ a)[0, 0])
    assert r["n"] == 79 and abs(r["slope"] - beta[0]) < 1e-9 and abs(r["statistic"] - beta[0] / error) < 1e-6
    assert statistics.unit_root(series(spark, [1]), "t", "v").first()["statistic"] is None


def test_significance_names_and_stars(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(200, 2))
    rows = [(float(a), float(b), float(3 * a + e)) for (a, b), e in zip(x, rnd.normal(size=200), strict=True)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, y double"))
    got = {r["name"]: r for r in statistics.significance(spark, LinearRegression(labelCol="y", solver="normal").fit(df), ["a", "b"]).collect()}
    assert set(got) == {"a", "b", "(intercept)"} and got["a"]["stars"] == "***" and abs(got["a"]["coefficient"] - 3) < 0.3
    assert abs(got["a"]["t_value"] - got["a"]["coefficient"] / got["a"]["std_error"]) < 1e-6


def test_feature_audit(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 2.0), (3, 4.0, 3.0)], "a int, `b` double, y double")
    got = {r["feature"]: r for r in statistics.feature_audit(df, ("a", "b"), "y").collect()}
    assert got["b"]["n_null"] == 1 and got["b"]["mean"] == 3.0 and abs(got["a"]["corr"] - 1) < 1e-12 and got["a"]["high"] == 3.0
