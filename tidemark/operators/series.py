"""Daily series: trend, weekly and yearly seasonality, forecast; conditional means with fallbacks; temporal folds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import us_holiday
from tidemark.operators.joins import lookup, with_support
from tidemark.sources.tables import Fold, staged


def daily(df: DataFrame, day: Column, value: str, groups: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*groups, day.alias("date")).agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("n"))


def decompose(series: DataFrame, groups: tuple[str, ...] = (), window: int = 30, exclude_current: bool = False) -> DataFrame:
    """trend (moving mean of window + 1 days), weekly and yearly seasonality, forecast and holiday by day."""
    g = list(groups) or [F.lit(0)]
    over = lambda *k: Window.partitionBy(*g, *k)
    trend = F.avg("avg_value").over(over().orderBy("date").rowsBetween(-window, -1 if exclude_current else 0))
    mean = F.avg("avg_value").over(over())
    out = series.withColumns({"trend": trend, "weekly": F.avg("avg_value").over(over(F.dayofweek("date"))) - mean, "yearly": F.avg("avg_value").over(over(F.month("date"))) - mean})
    return out.withColumns({"forecast": F.col("trend") + F.col("weekly") + F.coalesce("yearly", F.lit(0.0)), "is_holiday": us_holiday(F.col("date"))})


class SeriesModel:
    """Seasonal features learned on training rows; days it hasn't seen get the largest trend and mean seasonalities."""

    PARTS = ("trend", "weekly", "yearly")

    def __init__(self, day: str, value: str, window: int = 30, least_days: int = 14, prefix: str = "ts_", top: int | None = None, exclude_current: bool = False):
        self.day, self.value, self.window, self.least, self.prefix, self.top, self.exclude = day, value, window, least_days, prefix, top, exclude_current

    def fit(self, train: DataFrame, groups: tuple[str, ...] = ()) -> SeriesModel:
        """With groups only those with enough days are learned, and of them the `top` with the most days, if given."""
        s = daily(train.filter(F.col(self.day).isNotNull()), F.to_date(self.day), self.value, groups)
        self.groups = groups
        if groups:
            s = staged(s)  # read for the support of the groups and for the series
            s = with_support(s, groups, self.least)
        if groups and self.top:
            best = s.groupBy(*groups).count().orderBy(F.desc("count"), *groups).limit(self.top)
            s = s.join(F.broadcast(best.select(*groups)), list(groups), "left_semi")  # `top` rows
        self.table = staged(decompose(s, groups, self.window, self.exclude))  # read for the fallback and at each transform
        self.fallback = self.table.agg(F.max("trend"), F.avg("weekly"), F.avg("yearly")).first()
        return self

    def _join(self, df: DataFrame) -> DataFrame:
        keys = {"__day": "date"} | {g: g for g in self.groups}
        return lookup(df.withColumn("__day", F.to_date(self.day)), self.table, keys, {c: f"{self.prefix}{c}" for c in self.PARTS}).drop("__day")

    def _forecast(self, df: DataFrame) -> DataFrame:
        p = self.prefix
        return df.withColumn(f"{p}forecast", F.col(f"{p}trend") + F.col(f"{p}weekly") + F.col(f"{p}yearly"))

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {f"{self.prefix}{c}": v if v is not None else 0.0 for c, v in zip(self.PARTS, self.fallback, strict=True)}
        return self._forecast(self._join(df).fillna(fill))


class TimeSeriesFeatures:
    """The seasonal features of all rows, of their carrier and of their origin: what a group lacks is the global value."""

    def __init__(self, day: str = "fl_date", value: str = "dep_delay", carrier: str = "op_carrier", origin: str = "origin", window: int = 30, least_days: int = 14, top_origins: int = 100, exclude_current: bool = False):
        made = lambda prefix, top=None: SeriesModel(day, value, window, least_days, prefix, top, exclude_current)
        self.day = day
        self.models = [(made("global_"), ()), (made("carrier_"), (carrier,)), (made("origin_", top_origins), (origin,))]

    def fit(self, train: DataFrame) -> TimeSeriesFeatures:
        for model, groups in self.models:
            model.fit(train, groups)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        first = self.models[0][0]
        out = first.transform(df)
        for model, _ in self.models[1:]:
            out = model._join(out)
            out = model._forecast(out.withColumns({f"{model.prefix}{c}": F.coalesce(f"{model.prefix}{c}", f"{first.prefix}{c}", F.lit(0.0)) for c in model.PARTS}))
        return out.withColumn("is_holiday", us_holiday(F.to_date(self.day)))


def conditional_means(df: DataFrame, keys: tuple[str, ...], value: str, name: str, least: int = 10) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name), F.count(value).alias("__n")).filter(F.col("__n") >= least).drop("__n")


def expected_value(df: DataFrame, train: DataFrame, levels: tuple[tuple[str, ...], ...], value: str, name: str, least: int = 10, default: float = 0.0) -> DataFrame:
    """The mean of the finest level of keys with enough rows in training, level by level, then the default."""
    for i, keys in enumerate(levels):
        df = lookup(df, conditional_means(train, keys, value, f"__e{i}", least), {k: k for k in keys}, {f"__e{i}": f"__e{i}"})
    names = [f"__e{i}" for i in range(len(levels))]
    return df.withColumn(name, F.coalesce(*names, F.lit(default))).drop(*names)


def group_stats(df: DataFrame, keys: tuple[str, ...], value: str, least: int = 10) -> DataFrame:
    """avg, sd, least, greatest and count of the value by keys, for groups of at least `least` values."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.avg(v).alias("avg_value"), F.stddev_samp(v).alias("sd_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count(v).alias("n"))
    return out.filter(F.col("n") >= least)


def group_count(df: DataFrame, keys: tuple[str, ...]) -> int:
    return df.select(*keys).distinct().count()


#: The expected minutes by their name, what they are the mean of, and the levels of keys, finest first.
EXPECTED = {
    "expected_air_time": ("air_time", (("origin", "dest", "month"), ("origin", "dest"))),
    "expected_scheduled_time": ("crs_elapsed_time", (("origin", "dest", "month"), ("origin", "dest"))),
    "expected_turnover_time": ("lineage_actual_turnover_time_minutes", (("op_carrier", "origin", "month"), ("op_carrier", "origin"), ("origin", "month"), ("origin",))),
}


class ExpectedValues:
    """Conditional means learned on training rows at each level of keys; a row takes the finest level with enough rows, then the default.

    With fill_first each level's gaps are filled with the default before the next is asked, which leaves the coarser
    levels unread, as some tables made that way have it.
    """

    def __init__(self, wanted: dict = EXPECTED, day: str = "fl_date", least: int = 10, default: float = 0.0, fill_first: bool = False):
        self.wanted, self.day, self.least, self.default, self.fill_first = wanted, day, least, default, fill_first
        self.tables: dict[str, list[tuple[tuple[str, ...], DataFrame]]] = {}

    def _dated(self, df: DataFrame) -> DataFrame:
        return df if "month" in df.columns else df.withColumn("month", F.month(F.to_date(self.day)))

    def fit(self, train: DataFrame) -> ExpectedValues:
        train = self._dated(train)
        self.tables = {name: [(keys, staged(conditional_means(train, keys, value, name, self.least))) for keys in levels] for name, (value, levels) in self.wanted.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._dated(df)
        for name, levels in self.tables.items():
            found = []
            for i, (keys, table) in enumerate(levels):
                out = lookup(out, table, {k: k for k in keys}, {name: f"__{name}{i}"})
                found.append(F.coalesce(f"__{name}{i}", F.lit(self.default)) if self.fill_first else F.col(f"__{name}{i}"))
            out = out.withColumn(name, F.coalesce(*found, F.lit(self.default))).drop(*[f"__{name}{i}" for i in range(len(levels))])
        return out.select(*df.columns, *self.tables)


def fold_bounds(df: DataFrame, day: str, folds: int = 3, strategy: str = "sliding") -> list[tuple]:
    """(train from, train to, held from, held to, kind): half-open days, the last one closed by a day more."""
    lo, hi = df.agg(F.min(F.to_date(day)), F.max(F.to_date(day))).first()
    length = (hi - lo).days // (folds + 1)
    if length <= 0:
        raise ValueError("the dates span too few days for so many folds")
    at = [lo + timedelta(days=length * i) for i in range(folds + 1)] + [hi + timedelta(days=1)]
    start = {"sliding": lambda i: at[i], "expanding": lambda i: at[0], "overlapping": lambda i: at[max(i - 1, 0)]}[strategy]
    out = [(start(i), at[i + 1], at[i + 1], at[i + 2], "VAL") for i in range(folds - 1)]
    return [*out, (at[0], at[folds], at[folds], at[folds + 1], "TEST")]


def fold_sizes(df: DataFrame, day: str, folds: int = 3, strategy: str = "sliding") -> DataFrame:
    """(fold, n_train, n_held) in one pass over the days."""
    d = F.to_date(day)
    inside = lambda a, b: F.count_if((d >= F.lit(a)) & (d < F.lit(b)))
    bounds = fold_bounds(df, day, folds, strategy)
    one = df.agg(*[F.struct(F.lit(i).cast("long").alias("fold"), inside(a, b).alias("n_train"), inside(c, e).alias("n_held")).alias(f"f{i}") for i, (a, b, c, e, _) in enumerate(bounds, 1)])
    return one.select(F.inline(F.array(*one.columns)))


def temporal_folds(df: DataFrame, day: str, folds: int = 3, strategy: str = "sliding") -> list[Fold]:
    d = F.to_date(day)
    return [Fold(df.filter((d >= a) & (d < b)), df.filter((d >= c) & (d < e)), k) for a, b, c, e, k in fold_bounds(df, day, folds, strategy)]
