"""One-pass regression and classification metrics, stratified and binned reports, and table comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def regression(y: Column, p: Column) -> list[Column]:
    e = p - y
    mse = F.avg(e * e)
    return [
        F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - mse / F.var_pop(F.when(p.isNotNull(), y))).alias("r2"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1.0)) * 100).alias("mape"),
    ]


def classification(y: Column, p: Column, threshold: float, name: str) -> list[Column]:
    """Accuracy, precision, recall and F1 of p >= threshold against y >= threshold; empty denominators give 0."""
    yes, said = y >= threshold, p >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tp, fp, fn, tn = n(yes & said), n(~yes & said), n(yes & ~said), n(~yes & ~said)
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [_ratio(tp + tn, tp + fp + fn + tn).alias(f"{name}_accuracy"), prec.alias(f"{name}_precision"), rec.alias(f"{name}_recall"), _ratio(2 * prec * rec, prec + rec).alias(f"{name}_f1")]


def evaluate(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rmse, mae, r2, mape, and the classifications at 15 and 60, of rows where both sides are known."""
    a, b = F.col(y), F.col(p)
    ok = df.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *regression(a, b), *classification(a, b, 15, "otpa"), *classification(a, b, 60, "sddr"))


def mape(y: Column, p: Column, least: float | None = 1.0, of_zero: float = 999.0) -> Column:
    """Mean absolute error in percent of |y|, or of `least` if that is more; without `least` rows where y is 0 count as of_zero."""
    e = F.abs(p - y)
    return F.avg(e / F.greatest(F.abs(y), F.lit(least)) * 100) if least is not None else F.avg(F.when(y == 0, F.lit(of_zero)).otherwise(e / F.abs(y) * 100))


def duration_bucket(minutes: Column, short: float = 90, long: float = 240) -> Column:
    return F.when(minutes < short, "short").when(minutes <= long, "medium").when(minutes > long, "long")


def by_duration(df: DataFrame, y: str, p: str, minutes: str, long: float = 240) -> DataFrame:
    """The metrics of short, medium and long rows, in one pass; rows without a duration are left out."""
    return evaluate(df.withColumn("bucket", duration_bucket(F.col(minutes), long=long)).filter("bucket is not null"), y, p, ("bucket",))


def fold_summary(results: DataFrame, by: tuple[str, ...] = ("kind",), skip: tuple[str, ...] = ("fold", "n")) -> DataFrame:
    """(by, metric, mean, sd, folds) of each metric over the folds; sd is the sample's."""
    names = [c for c in results.columns if c not in (*by, *skip)]
    long = results.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])))
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("folds"))


def hash_sample(df: DataFrame, keys: tuple[str, ...], fraction: float, seed: int = 7) -> DataFrame:
    """The rows of a share of all keys: the same keys from any table, however it is partitioned, so that samples can be joined."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(fraction * 1_000_000))


def reconciled(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str, fraction: float = 1.0) -> DataFrame:
    """One row: rows on either side and in both, how many agree, and the least, greatest, mean and median difference of the value."""
    side = lambda df, name: (hash_sample(df, keys, fraction) if fraction < 1 else df).select(*keys, F.col(value).cast("double").alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(a, "a").join(side(b, "b"), list(keys), "outer").withColumn("d", F.col("a") - F.col("b"))
    return both.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_left"), F.count_if(F.col("in_a").isNull()).alias("only_right"), F.count_if(F.col("in_a") & F.col("in_b")).alias("both"),
        F.count_if(F.col("d") == 0).alias("equal"), F.min("d").alias("least"), F.max("d").alias("greatest"), F.avg("d").alias("mean"), F.percentile_approx("d", 0.5, 10_000).alias("median"),
    )


def described(df: DataFrame, columns: tuple[str, ...], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """(column, n, n_null, mean, sd, low, high, q..) in one pass; quantiles are within 1 / accuracy of their rank, in bounded memory."""
    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        q = F.percentile_approx(v, list(quantiles), accuracy)
        return F.struct(F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("n_null"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), q.alias("q")).alias(c)

    row = df.agg(*[one(c) for c in columns])
    flat = lambda c: F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`.{k}").alias(k) for k in ("n", "n_null", "mean", "sd", "low", "high")], *[F.col(f"`{c}`.q")[i].alias(f"q{round(q * 100)}") for i, q in enumerate(quantiles)])
    return row.select(F.inline(F.array(*[flat(c) for c in columns])))


def binned(df: DataFrame, y: str, p: str, width: float, most: float) -> DataFrame:
    k = F.least(F.floor(F.col(y) / width), F.lit(int(most // width)))
    return df.groupBy(k.cast("long").alias("bin")).agg(F.avg(y).alias("actual"), F.avg(p).alias("predicted"), F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, n_zero, n_rows) of all columns in one pass."""
    zero = lambda c: F.sum(F.when(F.col(c).try_cast("double") == 0, 1).otherwise(0)) if df.schema[c].dataType.typeName() in ("integer", "long", "double", "float", "short") else F.lit(0).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.struct((F.count(F.lit(1)) - F.count(c)).alias("a"), zero(c).alias("b")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.a").alias("n_null"), F.col(f"`{c}`.b").alias("n_zero"), F.col("__n").alias("n_rows")) for c in df.columns])
    return one.select(F.inline(rows))


def compare(a: DataFrame, b: DataFrame) -> dict:
    """Rows, columns on either side only, types that differ, and null counts of two tables."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    nulls = lambda df: {r["column"]: r["n_null"] for r in null_profile(df).collect()}  # noqa: E731  one row a column
    return {
        "rows": (a.count(), b.count()), "only_left": sorted(ta.keys() - tb.keys()), "only_right": sorted(tb.keys() - ta.keys()),
        "types": {c: (ta[c], tb[c]) for c in sorted(ta.keys() & tb.keys()) if ta[c] != tb[c]}, "nulls": (nulls(a), nulls(b)),
    }
