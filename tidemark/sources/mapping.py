"""Bring tables of one subject but other column names to one form: dates, carriers, delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import renamed, with_defaults

ISO = r"^\d{4}-\d{2}-\d{2}$"
#: Layouts of dates, tried in this order.
LAYOUTS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd")


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(ISO), F.lit(False))


def any_date(c: Column, layouts: tuple[str, ...] = LAYOUTS) -> Column:
    """The date in a text of any of the layouts, with or without a time after it; null if none fits."""
    day = F.split(F.trim(c.cast("string")), "[ T]")[0]
    return F.coalesce(*[F.try_to_timestamp(day, F.lit(x)).cast("date") for x in layouts])


def any_timestamp(c: Column, layouts: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(x)) for x in layouts])


def _have(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    low = {c.lower(): c for c in df.columns}
    return [low[n.lower()] for n in names if n.lower() in low]


def with_date(df: DataFrame, name: str = "fl_date", candidates: tuple[str, ...] = ("fl_date", "flight_date", "date"), moments: tuple[str, ...] = ("sched_depart_date_time", "sched_depart_date_time_utc"), parts: tuple[str, str, str] = ("year", "month", "day_of_month"), default: str = "2015-01-01") -> DataFrame:
    """`name` as a date: the first that a row has of the candidates, the moments, the date of its parts, the default."""
    ways = [any_date(F.col(c)) for c in _have(df, candidates)] + [F.to_date(F.col(c)) for c in _have(df, moments)]
    if len(ymd := _have(df, parts)) == 3:
        text = F.concat_ws("-", F.col(ymd[0]).cast("int"), F.lpad(F.col(ymd[1]).cast("int").cast("string"), 2, "0"), F.lpad(F.col(ymd[2]).cast("int").cast("string"), 2, "0"))
        ways.append(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    return df.withColumn(name, F.coalesce(*ways, F.to_date(F.lit(default))))


def with_alternative(df: DataFrame, name: str, others: tuple[str, ...]) -> DataFrame:
    """`name` filled from the first of the other columns that exists where it is missing or null; as it is if none exists."""
    have = _have(df, (name, *others))
    return df.withColumn(name, F.coalesce(*[F.col(c) for c in have])) if have else df


def with_delay(df: DataFrame, name: str = "dep_delay", others: tuple[str, ...] = ("dep_delay_new",)) -> DataFrame:
    """One column `name` of doubles from whichever spelling exists, else from the others; other spellings of it are dropped."""
    same = [c for c in df.columns if c.lower() == name.lower()]
    have = [*sorted(same, key=lambda c: c != name), *_have(df, others)]
    if not have:
        raise ValueError(f"none of {(name, *others)} in {df.columns}")
    at = {c: i for i, c in enumerate(df.columns)}
    plain = df.toDF(*[f"__{i}" for i in range(len(df.columns))])  # spellings that differ in case alone can't be told apart by name
    value = F.coalesce(*[F.col(f"__{at[c]}").try_cast("double") for c in have])
    return plain.select(*[F.col(f"__{i}").alias(c) for c, i in at.items() if c not in same], value.alias(name))


def standardised(df: DataFrame, mapping: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Explicit names, the rest in lower case; date, carrier and delay derived; columns that are absent get defaults."""
    out = with_delay(df) if _have(df, ("dep_delay", "dep_delay_new")) else df
    out = with_alternative(with_date(renamed(out, mapping)), "op_carrier", ("op_unique_carrier", "carrier"))
    return with_defaults(out, defaults or {})
