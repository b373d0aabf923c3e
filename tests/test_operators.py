from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import graph, joins, lineage, metrics, series
from tidemark.sources import tables


def test_pagerank_golden_values(spark):
    e = spark.createDataFrame([tuple(x) for x in ("AB", "AD", "BC", "BE", "CD", "DE", "EA", "EB", "EC")], "src string, dst string").withColumn("weight", F.lit(1))
    got = {r["id"]: r["rank"] for r in graph.pagerank(e, reset=0.0, iterations=24).collect()}
    want = {"A": 0.10526316, "B": 0.15789474, "C": 0.18421053, "D": 0.23684211, "E": 0.31578947}
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_pagerank_with_dangling_node_keeps_its_mass(spark):
    e = spark.createDataFrame([tuple(x) for x in ("AB", "AC", "AD", "BD", "BE", "CA", "CE", "DB")], "src string, dst string").withColumn("weight", F.lit(1))
    got = {r["id"]: r["rank"] for r in graph.pagerank(e, iterations=10).collect()}
    want = {"A": 0.1159082, "B": 0.30221353, "C": 0.10437523, "D": 0.23298503, "E": 0.244518}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want) and abs(sum(got.values()) - 1) < 1e-9
    assert [r["id"] for r in graph.dangling(e).collect()] == ["E"]


def test_clock_casts_and_holidays(spark):
    df = spark.createDataFrame([("M", "0.02s", "2015-01-19", 2350, 110), (".", "1.5", "2015-11-26", 100, 2400), (" 7 ", "", "2015-01-20", 0, 30)], "a string, b string, d string, s int, e int")
    day = F.to_date("d")
    rows = df.select(C.safe_double(F.col("a")), C.stripped_double(F.col("b")), C.us_holiday(day), C.elapsed_minutes(F.col("s"), F.col("e")), C.clock_timestamp(day, F.col("e"))).collect()
    assert [tuple(r)[:4] for r in rows] == [(None, 0.02, 1, 80), (None, 1.5, 1, 1380), (7.0, None, 0, 30)]
    assert rows[1][4] == datetime(2015, 11, 27)


def test_lineage_jump_and_unknown_entities(spark):
    df = spark.createDataFrame([("t", 1, "A", "B"), ("t", 2, "B", "C"), ("t", 3, "D", "E"), (None, 1, "A", "B"), (None, 2, "X", "B")], "tail string, ts int, o string, d string")
    out = lineage.previous_event(df, "tail", ("ts",), ("d",)).withColumn("j", lineage.jump(F.col("lineage_rank"), F.col("prev_d"), F.col("o")))
    assert sorted((r["tail"] or "", r["ts"], r["lineage_rank"], r["j"]) for r in out.collect()) == [("", 1, 1, False), ("", 2, 1, False), ("t", 1, 1, False), ("t", 2, 2, False), ("t", 3, 3, True)]


def test_safe_delay_never_looks_past_the_cutoff(spark):
    t = datetime(2020, 1, 1, 12)
    df = spark.createDataFrame([(5.0, t - timedelta(hours=1), t - timedelta(hours=2)), (9.0, t + timedelta(hours=1), t - timedelta(minutes=30)), (9.0, t + timedelta(hours=1), t + timedelta(minutes=30))], "delay double, left timestamp, sched timestamp").withColumn("cut", F.lit(t))
    assert [r[0] for r in df.select(lineage.safe_delay(F.col("delay"), F.col("left") > F.col("cut"), F.col("sched"), F.col("cut"))).collect()] == [5.0, 30.0, 0.0]


def test_asof_keeps_rows_whose_bucket_has_only_later_matches(spark):
    t = datetime(2020, 1, 1, 10, 5)
    left = spark.createDataFrame([(1, "k", t), (2, "k", t + timedelta(hours=3)), (3, None, t)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("k", t + timedelta(minutes=5), 1.0), ("k", t + timedelta(hours=2, minutes=40), 2.0)], "k string, ts timestamp, v double")
    out = {r["id"]: r["matched_v"] for r in joins.asof_join(left, right, "k", "ts", "ts", 1800, ("v",), ("id",)).collect()}
    assert out == {1: None, 2: 2.0, 3: None}


def test_folds_are_ordered_and_complete(spark):
    df = spark.createDataFrame([(f"2020-01-{d:02d}",) for d in range(1, 11)], "d string")
    folds = series.temporal_folds(df, "d", 3)
    assert [(f.train.count(), f.held.count(), f.kind) for f in folds] == [(2, 2, "VAL"), (2, 2, "VAL"), (6, 4, "TEST")]
    assert [f.train.count() for f in series.temporal_folds(df, "d", 3, "expanding")] == [2, 4, 6]
    with pytest.raises(ValueError):
        series.temporal_folds(df.limit(2), "d", 3)


def test_fold_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"2020-01-{d:02d}", d) for d in range(1, 11)], "d string, x int")
    store = tables.FoldStore(spark, str(tmp_path))
    store.save("1", series.temporal_folds(df, "d"))
    back = store.load("1")
    assert [(f.train.count(), f.kind) for f in back] == [(2, "VAL"), (2, "VAL"), (6, "TEST")]
    assert tables.is_complete(spark, store.path("1", 1, "TRAIN"), ("x",))
    with pytest.raises(KeyError):
        store.load("2")


def test_metrics_of_empty_classes_are_zero(spark):
    r = metrics.evaluate(spark.createDataFrame([(1.0, 2.0), (3.0, 1.0), (None, 1.0)], "y double, p double"), "y", "p").first()
    assert (r["n"], r["otpa_accuracy"], r["otpa_f1"]) == (2, 1.0, 0.0) and abs(r["mae"] - 1.5) < 1e-12


def test_adjacency_lines(spark, tmp_path):
    (tmp_path / "g.txt").write_text("2\t{'3': 1}\n3\t{'2': 2, '4': 1}\n")
    assert sorted(map(tuple, tables.read_adjacency(spark, str(tmp_path)).collect())) == [("2", "3", 1), ("3", "2", 2), ("3", "4", 1)]


def test_strong_components_and_sizes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    got = {r["id"]: r["component"] for r in graph.strongly_connected(e).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7}
    sizes = graph.component_sizes(graph.components(e)).collect()
    assert [(r["component"], r["n"]) for r in sizes] == [(1, 6), (6, 1)]
    assert [r["src"] for r in graph.self_loops(e).collect()] == [6]


def test_power_iteration_meets_pagerank(spark):
    import numpy as np

    e = spark.createDataFrame([tuple(x) for x in ("AB", "AD", "BC", "BE", "CD", "DE", "EA", "EB", "EC")], "src string, dst string").withColumn("weight", F.lit(1))
    nodes, m = graph.transition_matrix(e)
    slow, fast = graph.power_iteration(m, np.full(5, 0.2), 60), graph.power_iteration(m, np.full(5, 0.2), 7, squaring=True)
    assert nodes == list("ABCDE") and np.abs(slow - [0.10526316, 0.15789474, 0.18421053, 0.23684211, 0.31578947]).max() < 1e-6 and np.abs(slow - fast).max() < 1e-6
    top, mean, _ = graph.degree_report(e, 2)
    assert [(r["id"], r["out_degree"]) for r in top] == [("E", 3), ("A", 2)] and mean == 9 / 5


def test_unknown_entities_have_no_history(spark):
    t = datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, None, t, 5.0), (2, None, t + timedelta(hours=3), 7.0), (3, "a", t, 1.0), (4, "a", t + timedelta(hours=3), 2.0), (5, "a", t + timedelta(hours=6), None), (6, "a", None, 3.0)], "id int, e string, ts timestamp, v double")
    got = {r["id"]: r for r in lineage.cumulative(df, "e", ("ts",), "v", skip=1).collect()}
    assert [(got[i]["cum_sum"], got[i]["cum_count"]) for i in (1, 2, 4)] == [(None, 0), (None, 0), (1.0, 1)]
    means = {r["id"]: r["m"] for r in lineage.rolling_mean(df, "e", "ts", F.col("ts") - F.expr("interval 2 hours"), "v", 86_400, "m").collect()}
    assert means == {1: None, 2: None, 3: None, 4: 1.0, 5: 1.5, 6: None}


def test_nearest_in_band_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "k", 5.0), (2, "k", 50.0), (3, None, 5.0), (4, "k", None)], "id int, k string, v double")
    right = spark.createDataFrame([(9, "k", 4.0), (8, "k", 6.0), (7, "k", 4.0), (6, None, 5.0)], "rid int, k string, v double").toDF("rid", "rk", "rv")
    out = joins.nearest_in_band(left, right, "k", "rk", "v", "rv", 10.0, "id", "rid").collect()
    assert [(r["id"], r["rid"], r["distance"]) for r in out] == [(1, 7, 1.0)]


def test_engine_handles_empty_and_unknown_tables(spark):
    from tidemark.operators import flights
    from tidemark.plans.flights import flights_table

    e = spark.createDataFrame([(1, datetime(2024, 1, 1, 10), 7, "x", 5.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    out = flights.add_lineage_features(flights_table(lambda t: e), rolling=True)
    row = out.first()
    assert row["tail_num"] is None and row["lineage_rank"] == 1 and row["safe_prev_departure_delay"] == -10.0 and row["tail_mean_delay_24h"] is None
    assert flights.add_lineage_features(flights_table(lambda t: e.limit(0))).count() == 0
