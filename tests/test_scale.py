from pyspark.sql import functions as F

from tidemark.operators import joins, lineage
from tidemark.plans import catalog  # noqa: F401
from tidemark.plans.registry import QUERIES


def test_least_partner_by_either_key_makes_no_pairs(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, None), (None, 6), (9, 8)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, 5), (4, 5), (None, 5), (3, 9), (2, 6), (None, 6)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["or_join_dedup"](spark, str(tmp_path))
    assert {r["c_custkey"]: r["s_suppkey"] for r in out.collect()} == {1: 2, 2: 2, 3: 3, None: 2}
    many = spark.range(50_000).select("id", F.lit(1).alias("n"))
    out = joins.either_key_least(many, many.select(F.col("id").alias("o"), "n"), (("n", "n"),), "id", "o")
    assert out.agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("o")).first() == (50_000, 0)


def test_rolling_means_match_plain_python_and_keep_far_values_out(spark):
    rows = [("a", 100 * i, float(i % 7)) for i in range(400)] + [("a", 0, 1e300), ("a", 50, float("nan")), (None, 0, 1.0), ("b", 5, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, e string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    out = lineage.rolling_means(df, "e", "t", F.col("t") - F.expr("interval 200 seconds"), "v", {"m": 1000, "n": 3000})
    assert out.columns == [*df.columns, "m", "n"]
    for r in out.collect():
        for name, span in (("m", 1000), ("n", 3000)):
            want = [v for k, (e, s, v) in enumerate(rows) if e == r["e"] and e is not None and v is not None and k != r["id"] and r["s"] - 200 - span <= s <= r["s"] - 200]
            got = r[name]
            if not want:
                assert got is None
            elif any(v != v for v in want):
                assert got != got
            else:
                assert abs(got - sum(want) / len(want)) <= 1e-9 * max(1, abs(got)), r
    frames = out._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in frames and "RangeFrame, -" not in frames  # no frame is added up anew
