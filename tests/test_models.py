import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import flights, metrics, models, network, series, statistics
from tidemark.plans.flights import flights_table


@pytest.fixture(scope="module")
def lineage(spark, sf):
    return flights.add_lineage_features(flights_table(lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))).cache()


def test_meta_models_predict_known_flights_and_fall_back(lineage):
    made = models.MetaModels(["prev_flight_distance", "prev_flight_taxi_out"], ["prev_flight_origin"], kind="rf", numTrees=4, maxDepth=5, seed=1).fit(lineage)
    out = made.transform(lineage)
    assert out.columns == [*lineage.columns, *models.META]
    rows = out.select("lineage_rank", "lineage_is_jump", "crs_elapsed_time", "prev_flight_air_time", *models.META).collect()
    first = [r for r in rows if r["lineage_rank"] == 1 or r["lineage_is_jump"]]
    assert first and all(r["meta_air_time"] == r["crs_elapsed_time"] and r["meta_taxi_time"] == 25.0 for r in first)
    known = [r for r in rows if r["lineage_rank"] > 1 and not r["lineage_is_jump"]]
    assert np.mean([abs(r["meta_air_time"] - r["prev_flight_air_time"]) for r in known]) < 40
    few = models.MetaModels(["prev_flight_distance"], least=10**9).fit(lineage).transform(lineage).first()
    assert few["meta_taxi_time"] == 25.0 and few["meta_total_duration"] == few["crs_elapsed_time"]


def test_targets_of_meta_models(spark):
    df = spark.createDataFrame([(None, 40.0, 2350, 10), (30.0, 40.0, 100, 200)], "lineage_actual_turnover_time_minutes double, scheduled_lineage_turnover_time_minutes double, prev_flight_dep_time int, dep_time int")
    rows = models.rotation_target(models.turnover_target(df)).collect()
    assert [(r["target_turnover"], r["target_rotation"]) for r in rows] == [(40.0, 20.0), (30.0, 60.0)]
    assert [models.boosting_size(n) for n in (10, 6_000_000, 20_000_000)] == [(75, 6), (60, 6), (50, 5)]


def _line(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(f"2020-{1 + i * 12 // n:02d}-{1 + i % 28:02d}", float(x), c, float(3 * x + (5 if c == "b" else 0) + 1)) for i, (x, c) in enumerate(zip(rng.normal(size=n), rng.choice(list("abc"), n), strict=True))]
    return spark.createDataFrame(rows, "d string, x double, c string, y double")


def test_cross_validation_driver_summary_benchmark_and_grid(spark):
    folds = series.temporal_folds(_line(spark), "d")
    cv = models.CrossValidation(lambda i: models.pipeline("lr", "y", ["x"], ["c"], regParam=0.0), folds, "y")
    assert cv.fit_fold(1) is cv.fit_fold(1)
    got = cv.results(with_train=True).collect()
    assert [(r["fold"], r["kind"]) for r in got] == [(1, "TRAIN"), (1, "VAL"), (2, "TRAIN"), (2, "VAL"), (3, "TRAIN"), (3, "TEST")] and all(r["rmse"] < 1e-6 for r in got)
    summary = {(r["kind"], r["metric"]): r["folds"] for r in cv.summary().collect()}
    assert summary["VAL", "rmse"] == 2 and summary["TEST", "mae"] == 1
    assert [b["kind"] for b in cv.benchmark(("TEST",))] == ["TEST"] and cv.benchmark()[0]["rows"] > 0
    best = models.grid(lambda regParam: models.pipeline("lr", "y", ["x"], ["c"], regParam=regParam), {"regParam": [5.0, 0.0]}, folds, "y")
    assert [b["regParam"] for b in best] == [0.0, 5.0]


def test_names_of_importances_and_unknown_categories(spark):
    df = _line(spark).withColumn("c", F.when(F.col("c") != "c", F.col("c")))
    from pyspark.ml import Pipeline

    stages = models.feature_stages(["x"], ["c"], scale=False, unknown=True, drop_last=False)
    model = Pipeline(stages=[*stages, models.regressor("rf", "y", numTrees=5, maxDepth=4, seed=1)]).fit(df)
    found = dict(models.importances(model, df))
    assert set(found) >= {"x__n", "c__h_a", "c__h_b", "c__h_UNKNOWN"} and abs(sum(found.values()) - 1) < 1e-9
    assert {n for n, _ in models.importances(model, df, k=2)} == {"x__n", "c__h_b"}
    scaled = models.feature_stages(["x"], ["c"], center=True)
    mean = Pipeline(stages=scaled).fit(df.filter("c is not null")).transform(df.filter("c is not null")).select(F.col("features")).collect()
    assert abs(np.mean([r[0].toArray()[0] for r in mean])) < 1e-9


def test_log_target_pipeline_is_saved_with_both_steps(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(float(i), float(np.sign(i) * (np.exp(abs(i) / 10) - 1))) for i in range(-30, 31)], "x double, y double")
    model = models.log_target_pipeline("lr", "y", ["x"]).fit(df)
    model.write().overwrite().save(f"{tmp_path}/m")
    out = PipelineModel.load(f"{tmp_path}/m").transform(df).collect()
    assert max(abs(r["prediction"] - r["y"]) for r in out) < 0.5


def test_baselines_and_gbt(spark):
    df = _line(spark)
    median = models.ConstantBaseline("y", median=True).fit(df)
    exact = np.median([r["y"] for r in df.collect()])
    assert abs(median.value - exact) < 0.1 and median.transform(df).first()["prediction"] == median.value
    gbt = models.pipeline("gbt", "y", ["x"], ["c"], maxIter=5, maxDepth=3, seed=1).fit(df)
    assert metrics.evaluate(gbt.transform(df), "y", "prediction").first()["r2"] > 0.8


def test_perceptron_learns_and_predicts_by_partition(spark):
    df = _line(spark).select("x", (F.col("x") * F.col("x")).alias("y")).withColumn("z", F.when(F.col("x") > 9, 1.0)).repartition(4)
    net = network.train(df, ["x", "z"], "y", epochs=60, batch=32, chunk=100, hidden=(16,), rate=0.01)
    out = network.predicted(df, net, ["x", "z"])
    assert out.columns == ["x", "y", "z", "prediction"] and metrics.evaluate(out, "y", "prediction").first()["r2"] > 0.8
    assert network.predicted(df.limit(0), net, ["x", "z"]).count() == 0
    with pytest.raises(ValueError):
        network.train(df.withColumn("y", F.lit(None).cast("double")), ["x"], "y")


def test_gradient_of_the_perceptron():
    net = network.Perceptron(3, (4,), seed=1, rate=0.0)
    x, y = np.random.default_rng(0).normal(size=(5, 3)), np.arange(5.0)
    loss = lambda: float(((net.forward(x)[-1][:, 0] - y) ** 2).mean())
    net.learn(x, y)
    got = net.state[0][0][1, 2] / 0.1
    before = loss()
    net.w[0][1, 2] += 1e-6
    assert abs((loss() - before) / 1e-6 - got) < 1e-3


def test_series_statistics():
    rng = np.random.default_rng(5)
    walk, noise = np.cumsum(rng.normal(size=800)), rng.normal(size=800)
    assert statistics.kpss(walk, trend=False, lags=4) > 0.463 > statistics.kpss(noise, trend=False, lags=4)
    assert statistics.cointegration(2 * walk + noise, walk)[1] < -3.34 and abs(statistics.cointegration(2 * walk + noise, walk)[0] - 2) < 0.1
    t = np.arange(800)
    trend, season, rest = statistics.seasonal_split(0.01 * t + np.sin(2 * np.pi * t / 20), 20)
    assert np.abs(rest[40:-40]).max() < 0.1 and np.abs(season[:20] - np.sin(2 * np.pi * t[:20] / 20)).max() < 0.1 and trend[-60] > trend[60]
    ar = np.zeros(5000)
    for i in range(1, 5000):
        ar[i] = 0.6 * ar[i - 1] + rng.normal()
    d = ar - ar.mean()
    acf = np.array([(d[k:] @ d[:-k]) / (d @ d) for k in range(1, 5)])
    pacf = statistics.partial_autocorrelation(acf)
    assert abs(pacf[0] - 0.6) < 0.05 and np.abs(pacf[1:]).max() < 0.05 and statistics.ljung_box(acf, 5000)[0] > 100


def test_hash_samples_of_two_tables_hold_the_same_keys(spark):
    a, b = spark.range(10_000), spark.range(5000, 15_000)
    x, y = ({r["id"] for r in metrics.hash_sample(d, ("id",), 0.1).collect()} for d in (a, b))
    assert 800 < len(x) < 1200 and {i for i in x if i >= 5000} == {i for i in y if i < 10_000}
