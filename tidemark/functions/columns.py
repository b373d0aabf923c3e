"""Column helpers: clock arithmetic, calendars, distances, safe casts, buckets and target transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for null in text columns.
NULL_TOKENS = ("", "M", "T", "NA", "N/A", "NULL", "null", "None", "nan", "NaN", "\\N", ".", "-")
EARTH_KM = 6371.0


def hhmm_minutes(c: Column) -> Column:
    """Minutes since midnight of a clock written as HHMM."""
    return F.floor(c.cast("int") / 100) * 60 + c.cast("int") % 100


def minutes_hhmm(c: Column) -> Column:
    return (F.floor(c / 60) * 100 + c % 60).cast("int")


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes from one HHMM clock to another, over midnight if the end is before the start."""
    a, b = hhmm_minutes(start), hhmm_minutes(end)
    return F.when(b < a, b - a + 1440).otherwise(b - a)


def clock_timestamp(day: Column, hhmm: Column) -> Column:
    """Timestamp of a date and an HHMM clock; 2400 is the next midnight, impossible clocks are null."""
    t = hhmm.cast("int")
    ok = (t >= 0) & (t <= 2400) & (t % 100 < 60)
    return F.when(ok, F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + hhmm_minutes(t) * 60))


def safe_double(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """A double, or null where the text is a null token or no number."""
    text = F.trim(c.cast("string"))
    return F.when(~text.isin(*tokens), text.try_cast("double"))


def stripped_double(c: Column) -> Column:
    """The number left when all but digits, signs and dots is dropped."""
    text = F.regexp_replace(c.cast("string"), "[^0-9+\\-.]", "")
    return F.when(F.length(text) > 0, text.try_cast("double"))


def us_holiday(day: Column) -> Column:
    """1 on the ten US federal holidays by their month, day and week of the month, else 0."""
    m, d, dow = F.month(day), F.dayofmonth(day), F.dayofweek(day)  # 1 is Sunday
    nth = F.floor((d - 1) / 7) + 1
    fixed = [(1, 1), (7, 4), (11, 11), (12, 25)]
    floating = [(1, 2, 3), (2, 2, 3), (9, 2, 1), (10, 2, 2), (11, 5, 4)]
    out = (m == 5) & (dow == 2) & (d >= 25)
    for month, dayno in fixed:
        out = out | ((m == month) & (d == dayno))
    for month, weekday, week in floating:
        out = out | ((m == month) & (dow == weekday) & (nth == week))
    return out.cast("int")


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    cos = F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(a) * F.sin(b)
    return EARTH_KM * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def hour_bucket(hour: Column) -> Column:
    return F.when(hour.between(0, 5), "night").when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").otherwise("evening")


def delay_bucket(delay: Column) -> Column:
    return F.when(delay < 15, "on_time").when(delay < 60, "delayed").when(delay >= 60, "severe")


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    import math

    angle = c * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def signed_log(c: Column) -> Column:
    return F.sign(c) * F.log(F.abs(c) + 1)


def signed_exp(c: Column) -> Column:
    return F.sign(c) * (F.exp(F.abs(c)) - 1)


def natural_key(*cols: Column, hashed: bool = False) -> Column:
    key = F.concat_ws("_", *cols)
    return F.sha2(key, 256) if hashed else key


def weather_interactions(df, month: str = "month", dow: str = "day_of_week", products: tuple[tuple[str, str], ...] = (("distance", "hourlywindspeed"), ("distance", "hourlyvisibility"), ("hourlysealevelpressure", "hourlyrelativehumidity"))):
    """df with sines and cosines of month and weekday, and the products of column pairs that exist."""
    made = {}
    for c, period in ((month, 12), (dow, 7)):
        if c in df.columns:
            made[f"{c}_sin"], made[f"{c}_cos"] = cyclic(F.col(c), period)
    made |= {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in products if a in df.columns and b in df.columns}
    return df.withColumns(made)


def in_days(day: Column, first, last, closed: bool = False) -> Column:
    """first <= day < last, or <= last."""
    d = F.to_date(day)
    return (d >= F.lit(first).cast("date")) & ((d <= F.lit(last).cast("date")) if closed else (d < F.lit(last).cast("date")))


def equals(**values) -> Column:
    """All columns equal their values; null equals null."""
    out = F.lit(True)
    for c, v in values.items():
        out = out & F.col(c).eqNullSafe(F.lit(v))
    return out


def coordinates(c: Column) -> tuple[Column, Column]:
    """(latitude, longitude) as doubles from a text "longitude, latitude"; null where it is none."""
    parts = F.split(c, ",")
    number = lambda i: F.trim(F.try_element_at(parts, F.lit(i))).try_cast("double")
    return number(2), number(1)


def local_to_utc(at: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(at.cast("timestamp"), zone)


def clock_text(hhmm: Column) -> Column:
    """A clock as four digits: 930 is 0930, also where it came as 930.0."""
    return F.lpad(hhmm.cast("double").cast("int").cast("string"), 4, "0")
