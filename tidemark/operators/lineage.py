"""Previous-event features of an entity in time order: ranks, lags, jumps, cumulative figures, leakage and safe values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import staged

CUTOFF_SECONDS = 2 * 3600
#: What stands in for a missing previous event.
DEFAULTS = {"prev_delay": -10.0, "avg_previous_delay": 9.37, "cumulative_delay": 0.0, "max_delay": 0.0, "rotation_minutes": 1440.0, "required_minutes": 120.0}


def lineage_window(df: DataFrame, entity: str, *also: str):
    """(df with a column __alone, the partition of its lineages): each row without an entity is a partition of its own, so they neither mix nor meet in one task."""
    rows = df.withColumn("__alone", F.when(F.col(entity).isNull(), F.monotonically_increasing_id()))
    return rows, Window.partitionBy(entity, "__alone", *also)


def previous_event(df: DataFrame, entity: str, order: tuple[str, ...], lags: tuple[str, ...], prefix: str = "prev_") -> DataFrame:
    """lineage_rank and the previous row's columns.  Rows without an entity are no lineage: each stands alone."""
    rows, w = lineage_window(df, entity)
    w = w.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return rows.withColumns({"lineage_rank": F.row_number().over(w)} | {f"{prefix}{c}": F.lag(c).over(w) for c in lags}).drop("__alone")


def previous_numbers(df: DataFrame, entity: str, order: tuple[str, ...], columns: tuple[str, ...], prefix: str = "prev_") -> DataFrame:
    """The previous row's columns as doubles, null where they aren't numbers; columns that don't exist are passed over."""
    rows, w = lineage_window(df, entity)
    w = w.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return rows.withColumns({f"{prefix}{c}": F.lag(F.col(c).cast("string").try_cast("double")).over(w) for c in columns if c in df.columns}).drop("__alone")


def jump(rank: Column, prev_place: Column, place: Column, unknown: bool = False) -> Column:
    """The entity turned up elsewhere than it was left; false for first events; `unknown` where a place isn't known."""
    return (rank > 1) & F.coalesce(prev_place != place, F.lit(unknown))


def cumulative(df: DataFrame, entity: str, order: tuple[str, ...], value: str, skip: int = 2, also: tuple[str, ...] = ()) -> DataFrame:
    """Sum, count, mean and maximum of the value over all rows up to `skip` before this one, by entity and the columns `also`.

    Rows without an entity have no rows before them: null, and 0 for the count.
    """
    rows, w = lineage_window(df, entity, *also)
    w = w.orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -skip)
    return rows.withColumns({"cum_sum": F.sum(value).over(w), "cum_count": F.count(value).over(w), "cum_avg": F.avg(value).over(w), "cum_max": F.max(value).over(w)}).drop("__alone")


def next_edges(df: DataFrame, entity: tuple[str, ...], order: tuple[str, ...], node: str) -> DataFrame:
    """(src, dst) from each row's node to the next row's of the entity."""
    w = Window.partitionBy(*entity).orderBy(*order)
    known = df.filter(" and ".join(f"`{c}` is not null" for c in entity))
    return known.select(F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).filter("dst is not null")


def leaks(cutoff: Column, times: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Per column whether its time is after the cut-off, and the array of those that are."""
    flags = {k: F.coalesce(t > cutoff, F.lit(False)) for k, t in times.items()}
    return flags, F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in flags.items()]))


def safe_delay(actual: Column, leak: Column, scheduled: Column, cutoff: Column) -> Column:
    """The delay known at the cut-off, in minutes: the actual one, else what has passed since the schedule, else 0."""
    passed = (F.unix_timestamp(cutoff.cast("timestamp")) - F.unix_timestamp(scheduled.cast("timestamp"))) / 60
    return F.when(~leak, F.coalesce(actual, F.lit(0.0))).when(scheduled < cutoff, passed).otherwise(F.lit(0.0))


def imputed(df: DataFrame, defaults: dict[str, float] = DEFAULTS) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def rolling_means(df: DataFrame, entity: str, ts: str, cutoff: Column, value: str, spans: dict[str, int], number: str | None = None) -> DataFrame:
    """For each name of `spans` the mean of the value over the entity's events in (cut-off - seconds .. cut-off), the row itself left out; null if none.

    Time is cut into cells of a span's length, so a frame is the end of one cell and the beginning of the next.  Each row
    gives an event and a probe to both kinds of cells, which are read by running sums from their far ends: no frame is
    added up anew for each row, nothing is subtracted but the row itself, and only numbers are sorted.  The two halves and
    the rows meet by the rows' number: the column `number`, which must be the same whenever df is read; else the rows are
    written with one.  Rows without an entity have null.
    """
    rows = df.withColumn("__row", F.col(number)) if number else staged(df.withColumn("__row", F.monotonically_increasing_id()))
    at, cut = F.unix_micros(F.col(ts).cast("timestamp")), F.unix_micros(cutoff.cast("timestamp"))
    one = rows.select("__row", F.col(entity).alias("__e"), at.alias("__at"), cut.alias("__cut"), F.col(value).cast("double").alias("__v")).filter("__e is not null")
    places = []
    for k, seconds in enumerate(spans.values()):
        span = seconds * 1_000_000
        cell = lambda t, span=span: t - F.pmod(t, F.lit(span))
        for side, sign, since in ((0, 1, F.col("__cut")), (1, -1, F.col("__cut") - span)):
            of = lambda t, row, v, kind=2 * k + side, sign=sign, cell=cell: F.struct(F.lit(kind).alias("kind"), cell(t).alias("cell"), (t * sign).alias("t"), row.alias("probe"), v.alias("v"))
            places += [of(F.col("__at"), F.lit(None).cast("long"), F.col("__v")), of(since, F.col("__row"), F.lit(None).cast("double"))]
    both = one.select("__e", F.inline(F.array(*places))).filter("t is not null and (probe is not null or v is not null)")
    w = Window.partitionBy("__e", "kind", "cell").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    halves = both.withColumns({"n": F.count("v").over(w), "s": F.sum("v").over(w)}).filter("probe is not null and n > 0")
    sums = halves.groupBy("probe").agg(*[F.sum(F.when(F.col("kind").isin(2 * k, 2 * k + 1), F.col(c))).alias(f"__{c}{k}") for k in range(len(spans)) for c in ("n", "s")])
    made = {}
    for k, (name, seconds) in enumerate(spans.items()):
        own = at.between(cut - seconds * 1_000_000, cut) & F.col(value).isNotNull()
        n = F.col(f"__n{k}") - F.when(own, 1).otherwise(0)
        total = F.col(f"__s{k}") - F.when(own, F.col(value).cast("double")).otherwise(0.0)
        made[name] = F.when(n > 0, total / n)
    out = rows.join(sums, F.col("__row") == F.col("probe"), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[m.alias(name) for name, m in made.items()])


def rolling_mean(df: DataFrame, entity: str, ts: str, cutoff: Column, value: str, seconds: int, name: str) -> DataFrame:
    return rolling_means(df, entity, ts, cutoff, value, {name: seconds})


def twice_lagged(df: DataFrame, entity: tuple[str, ...], order: tuple[str, ...], made: Column, name: str) -> DataFrame:
    """`name` of each row, made from its columns (previous ones included), and prev_{name}: what the row before made."""
    w = Window.partitionBy(*entity).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn(name, made).withColumn(f"prev_{name}", F.lag(name).over(w))
