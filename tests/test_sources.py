from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import series
from tidemark.sources import files, mapping, tables


def test_files_and_sizes(spark, tmp_path):
    root = f"{tmp_path}/a"
    files.make_folder(spark, root)
    spark.range(1000).write.parquet(f"{root}/t.parquet")
    assert [e["name"] for e in files.entries(spark, root)] == ["t.parquet"] and files.entries(spark, root)[0]["folder"]
    files.copy(spark, f"{root}/t.parquet", f"{root}/u.parquet")
    assert spark.read.parquet(f"{root}/u.parquet").count() == 1000
    assert files.remove(spark, f"{root}/u.parquet") and not files.exists(spark, f"{root}/u.parquet") and not files.remove(spark, f"{root}/u.parquet")
    with pytest.raises(FileNotFoundError):
        files.entries(spark, f"{root}/none")
    size = tables.table_size(spark.range(1000))
    assert size["rows"] == 1000 and size["columns"] == 1 and size["bytes"] > 1000


def test_guarded_scan_views_and_bounded_collect(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/t.parquet")
    with pytest.warns(UserWarning, match="20 rows, fewer than 100"):
        df, n = tables.read_guarded(spark, f"{tmp_path}/t.parquet", few=(100, 1000))
    assert n == 20 and len(tables.collected(df, 20)) == 20
    with pytest.raises(ValueError):
        tables.collected(df, 19)
    df.createOrReplaceTempView("seen_here")
    assert "seen_here" in tables.temporary_views(spark)


def test_partition_counts_of_writers(spark, tmp_path):
    assert tables.write_adaptive(spark.range(100, numPartitions=3), f"{tmp_path}/a", least=10, up=12) == 12
    assert tables.write_adaptive(spark.range(100, numPartitions=30), f"{tmp_path}/b", most=20, to=5) == 5
    assert tables.write_adaptive(spark.range(100, numPartitions=15), f"{tmp_path}/c") == 15
    assert tables.write_shards(spark.range(100), f"{tmp_path}/d", each=10, least=4, most=8) == 8
    assert spark.read.parquet(f"{tmp_path}/d").count() == 100
    assert [tables.parts_for(n) for n in (1000, 2_000_000, 20_000_000, 10**9)] == [10, 50, 200, 500]
    with pytest.raises(ValueError):
        tables.write_verified(spark.range(5), f"{tmp_path}/e", ("absent",))


def test_names_and_defaults(spark):
    df = spark.createDataFrame([(1, 2, None)], "A int, b int, Keep string")
    assert tables.lower_names(df, ("Keep",)).columns == ["a", "b", "Keep"]
    assert tables.renamed(df, {"A": "b2", "gone": "x"}).columns == ["b2", "b", "keep"]
    assert tables.with_defaults(df, {"c": 0.0, "b": 9}).first()["c"] == 0.0
    assert tables.resolve_column(df, ("x", "B")) == "b" and tables.resolve_column(df, ("x",), "eep") == "Keep"
    with pytest.raises(ValueError):
        tables.resolve_column(df, ("x",))
    assert tables.without(df, "A", "none").columns == ["b", "Keep"]
    assert dict(tables.as_strings(df, "A", "none").dtypes)["A"] == "string"
    assert tables.filled_columns(df) == ["A", "b"]
    assert tables.filled_columns(df.limit(0)) == []


def test_derived_dates_carriers_and_delays(spark):
    df = spark.createDataFrame([("2015-02-03", 1, 2, 3, "AA", "1.5"), ("02/04/2015", 1, 2, 3, None, "x"), (None, 2016, 5, 6, None, None), ("junk", None, 5, 6, None, "2")], "flight_date string, year int, month int, day_of_month int, op_unique_carrier string, DEP_DELAY string")
    out = mapping.standardised(df.withColumn("op_carrier", F.lit(None).cast("string")), {}, {"extra": 1}).collect()
    assert [r["fl_date"] for r in out] == [date(2015, 2, 3), date(2015, 2, 4), date(2016, 5, 6), date(2015, 1, 1)]
    assert [(r["op_carrier"], r["dep_delay"], r["extra"]) for r in out] == [("AA", 1.5, 1), (None, None, 1), (None, None, 1), (None, 2.0, 1)]
    both = spark.createDataFrame([(None, 4.0, 9.0), (1.0, 2.0, 9.0)], "a double, b double, c double").toDF("DEP_DELAY", "dep_delay", "dep_delay_new")
    assert [r["dep_delay"] for r in mapping.with_delay(both).collect()] == [4.0, 2.0]
    assert tables.duplicate_names(both) == {"dep_delay": ["DEP_DELAY", "dep_delay"]}
    with pytest.raises(ValueError):
        mapping.with_delay(spark.range(1))
    assert spark.range(1).select(mapping.is_iso_date(F.lit("2015-01-02")), mapping.is_iso_date(F.lit("2015-1-2")), mapping.is_iso_date(F.lit(None))).first()[:] == (True, False, False)


def test_fold_store_holes_versions_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(f"2020-01-{d:02d}", d) for d in range(1, 13)], "d string, x int")
    store = tables.FoldStore(spark, str(tmp_path))
    store.save("7", series.temporal_folds(df, "d"))
    files.remove(spark, store.path("7", 2, "TRAIN"))
    assert store.versions() == {"7": [1, 3]} and [f.kind for f in store.load("7")] == ["VAL", "TEST"]
    with pytest.warns(UserWarning):
        assert list(store.load_all(["7", "8"])) == ["7"]
    made = tables.augment(store, "7", "_WITH", lambda train: lambda d, m=train.agg(F.max("x")).first()[0]: d.withColumn("m", F.lit(m)), ("m",))
    assert made == [1, 3]
    assert tables.augment(store, "7", "_WITH", lambda train: 1 / 0, ("m",)) == []
    assert {r["m"] for r in tables.FoldStore(spark, str(tmp_path), suffix="_WITH").fold("7", 1).held.collect()} == {2}
    assert store.versions() == {"7": [1, 3]}


def test_retries_only_passing_faults():
    calls, waits = [], []

    def job():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("Connection reset by peer")
        return 5

    assert tables.retried(job, 3, 1.0, sleep=waits.append) == 5 and waits == [1.0, 2.0]
    with pytest.raises(KeyError):
        tables.retried(lambda: {}["x"], sleep=waits.append)


def test_clocks_zones_and_coordinates(spark):
    df = spark.createDataFrame([("-97.5, 32.9", 930.0, "2020-07-01 12:00:00", "America/New_York"), ("none", None, None, None)], "c string, t double, at string, z string")
    lat, lon = C.coordinates(F.col("c"))
    rows = df.select(lat, lon, C.clock_text(F.col("t")), F.date_format(C.local_to_utc(F.col("at"), F.col("z")), "HH:mm")).collect()
    assert tuple(rows[0]) == (32.9, -97.5, "0930", "16:00") and tuple(rows[1]) == (None, None, None, None)
    assert spark.range(1).select(C.minutes_hhmm(F.lit(125)), C.delay_bucket(F.lit(15.0)), C.delay_bucket(F.lit(None).cast("double"))).first()[:] == (205, "delayed", None)
