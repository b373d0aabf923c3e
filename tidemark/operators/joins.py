"""Joins beyond equality: as-of, nearest in range or on the sphere, either-key, semi with support."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import great_circle_km


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, bucket_seconds: int, right_cols: tuple[str, ...], row_key: tuple[str, ...], tie: tuple[str, ...] = (), drop_unmatched_buckets: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key at or before it, no older than the bucket before its own.

    Both sides are united and read by one window over (key, time), so the cost is a sort, however many right rows a
    bucket has.  Of right rows at the same time the one with the greatest `tie` values is taken.  Left rows without a
    key or a time, and those without a match, stay with nulls; `row_key` is not needed any more for telling rows apart.
    With drop_unmatched_buckets left rows go whose buckets hold only later right rows, as a filter after the join has it.
    """
    lf = left.withColumns({f"__l{i}": F.col(c) for i, c in enumerate(left.columns)})
    l_ = lf.select(F.col(key).alias("__k"), _micros(F.col(left_ts)).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(tie)], *[f"__l{i}" for i in range(len(left.columns))])
    r = right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
    match = F.struct(F.col(right_ts).alias("ts"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(right_cols)])
    r = r.select(F.col(key).alias("__k"), _micros(F.col(right_ts)).alias("__t"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(tie)], match.alias("__m"))
    known = l_.filter(F.col("__k").isNotNull() & F.col("__t").isNotNull())
    order = ["__t", "__side", *[F.col(f"__o{i}").asc_nulls_first() for i in range(len(tie))]]
    w = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(r, allowMissingColumns=True)
    bucket = lambda t: F.floor(t / (bucket_seconds * 1_000_000))
    both = both.withColumn("__m", F.last("__m", ignorenulls=True).over(w))
    if drop_unmatched_buckets:
        ahead = Window.partitionBy("__k").orderBy(F.col("__t").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("__next", F.last(F.when(F.col("__side") == 0, F.col("__t")), ignorenulls=True).over(ahead))
    out = both.filter("__side = 1")
    fresh = bucket(_micros(F.col("__m.ts"))) >= bucket(F.col("__t")) - 1
    if drop_unmatched_buckets:
        out = out.filter(F.coalesce(fresh, F.lit(False)) | F.coalesce(bucket(F.col("__next")) != bucket(F.col("__t")), F.lit(True)))
    out = out.withColumn("__m", F.when(fresh, F.col("__m")))
    alone = l_.filter(F.col("__k").isNull() | F.col("__t").isNull()).withColumn("__m", F.lit(None).cast(both.schema["__m"].dataType))
    names = [F.col(f"__l{i}").alias(c) for i, c in enumerate(left.columns)]
    fields = [F.col("__m.ts").alias(f"matched_{right_ts}"), *[F.col(f"__m.c{i}").alias(f"matched_{c}") for i, c in enumerate(right_cols)]]
    return out.select(*names, *fields).unionByName(alone.select(*names, *fields))


def nearest_in_band(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_val: str, right_val: str, band: float, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of the same key whose value is nearest, within the band; ties by the smaller id.

    Both sides are united and sorted by (key, value) once: the nearest are the last right value before a left row and
    the first one after it, so nothing is paired.  Left rows without a partner in the band are left out.
    """
    r = right.filter(F.col(right_key).isNotNull() & F.col(right_val).isNotNull()).groupBy(F.col(right_key).alias("__k"), F.col(right_val).alias("__v")).agg(F.min(right_id).alias("__r"))
    lf = left.filter(F.col(left_key).isNotNull() & F.col(left_val).isNotNull()).select(F.col(left_key).alias("__k"), F.col(left_val).alias("__v"), F.col(left_id).alias("__id"))
    both = lf.unionByName(r, allowMissingColumns=True).withColumn("__p", F.when(F.col("__r").isNotNull(), F.struct(F.col("__v").alias("v"), F.col("__r").alias("r"))))
    near = lambda order: F.last("__p", ignorenulls=True).over(Window.partitionBy("__k").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumns({"__a": near(F.col("__v")), "__b": near(F.col("__v").desc())}).filter("__id is not null")
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("__v") - F.col(f"{c}.v")).alias("distance"), F.col(f"{c}.r").alias("id")))
    best = both.withColumn("__best", F.least(side("__a"), side("__b"))).filter(F.col("__best.distance") <= band)
    return best.groupBy(F.col("__id").alias(left_id)).agg(F.min("__best").alias("b")).select(left_id, F.col("b.id").alias(right_id), F.col("b.distance").alias("distance"))


def nearest_on_sphere(left: DataFrame, right: DataFrame, left_id: str, right_id: str, degrees: float = 0.5, km: float = 50.0, lat: str = "lat", lon: str = "lon", right_lat: str | None = None, right_lon: str | None = None) -> DataFrame:
    """(left_id, right_id, distance_km): for each left place the nearest right one in a box of +- `degrees` and within `km`.

    Places are dealt into cells of the box's size; a right place stands in its cell and the eight around it, so the box
    is an equi-join.  Boxes don't reach across the date line.  Ties go to the smaller id; places without a partner are left out.
    """
    rlat, rlon = right_lat or lat, right_lon or lon
    cell = lambda c: F.floor(F.col(c) / degrees)
    around = F.array(*[F.struct((cell("__rlat") + i).alias("i"), (cell("__rlon") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r = right.select(F.col(right_id).alias("__rid"), F.col(rlat).alias("__rlat"), F.col(rlon).alias("__rlon")).dropna().select("*", F.inline(around))
    lf = left.select(F.col(left_id).alias("__id"), F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).dropna().withColumns({"__i": cell("__lat"), "__j": cell("__lon")})
    inside = (F.abs(F.col("__lat") - F.col("__rlat")) <= degrees) & (F.abs(F.col("__lon") - F.col("__rlon")) <= degrees)
    near = lf.join(r, (F.col("__i") == F.col("i")) & (F.col("__j") == F.col("j")) & inside)
    near = near.withColumn("distance_km", great_circle_km(F.col("__lat"), F.col("__lon"), F.col("__rlat"), F.col("__rlon"))).filter(F.col("distance_km") < km)
    best = near.groupBy("__id").agg(F.min(F.struct("distance_km", "__rid")).alias("b"))
    return best.select(F.col("__id").alias(left_id), F.col("b.__rid").alias(right_id), F.col("b.distance_km").alias("distance_km"))


def with_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keep_unmatched: bool = True, **kw) -> DataFrame:
    """The left rows with their nearest right place and its distance; null where there is none, or left out."""
    near = nearest_on_sphere(left, right, left_id, right_id, **kw).withColumnRenamed(left_id, "__nid")
    return left.join(near, left[left_id] == F.col("__nid"), "left" if keep_unmatched else "inner").drop("__nid")


def either_key_join(left: DataFrame, right: DataFrame, pairs: tuple[tuple[str, str], ...], left_id: str, right_id: str, how: str = "inner") -> DataFrame:
    """Pairs of rows that agree in any of the column pairs, each once: one equi-join for each, united; left: all left ids."""
    out = None
    for a, b in pairs:
        part = left.join(right, F.col(a) == F.col(b)).select(left_id, right_id)
        out = part if out is None else out.unionByName(part)
    out = out.distinct()
    if how == "left":
        out = left.select(F.col(left_id).alias("__id")).distinct().join(out, F.col("__id") == F.col(left_id), "left").select(F.col("__id").alias(left_id), right_id)
    return out


def either_key_best(left: DataFrame, right: DataFrame, pairs: tuple[tuple[str, str], ...], order: tuple[str, ...], cols: tuple[str, ...]) -> DataFrame:
    """The left rows, all of them, with `cols` of the right row that is least by `order` among those that agree in any pair.

    The best right row of each key is found before the join, so a key with many rows on both sides makes no pairs.
    """
    out, names = left, []
    for i, (a, b) in enumerate(pairs):
        row = F.struct(*[F.col(c).alias(f"o{j}") for j, c in enumerate(order)], *[F.col(c).alias(f"c{j}") for j, c in enumerate(cols)])
        best = right.filter(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"__k{i}")).agg(F.min(row).alias(f"__b{i}"))
        out = out.join(best, F.col(a) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        names.append(f"__b{i}")
    out = out.withColumn("__best", F.least(*names) if len(names) > 1 else F.col(names[0]))
    return out.select(*left.columns, *[F.col(f"__best.c{j}").alias(c) for j, c in enumerate(cols)])


def either_key_least(left: DataFrame, right: DataFrame, pairs: tuple[tuple[str, str], ...], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): of the right ids that agree in any pair the least, once for each left id that has a partner; null comes last.

    The least right id of each key is found before the join, so a key with many rows on both sides makes no pairs.
    """
    out, names = left.select(F.col(left_id).alias("__id"), *[F.col(a).alias(f"__a{i}") for i, (a, _) in enumerate(pairs)]), []
    for i, (_, b) in enumerate(pairs):
        least = right.filter(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"__k{i}")).agg(F.min(right_id).alias(f"__r{i}"), F.lit(True).alias(f"__b{i}"))
        out = out.join(least, F.col(f"__a{i}") == F.col(f"__k{i}"), "left")
        names.append(f"__b{i}")
    found = out.filter(F.coalesce(*names, F.lit(False)))
    least = F.array_min(F.array(*[F.col(f"__r{i}") for i in range(len(pairs))]))  # nulls are passed over
    return found.groupBy(F.col("__id").alias(left_id)).agg(F.min(least).alias(right_id))


def plan_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(df: DataFrame, table: DataFrame, keys: dict[str, str], cols: dict[str, str], limit: int = 10 << 20) -> DataFrame:
    """Left join of a dimension under new names; it is broadcast only if the optimizer's size is below `limit`."""
    t = table.select(*[F.col(b).alias(f"__k_{b}") for b in keys.values()], *[F.col(a).alias(b) for a, b in cols.items()])
    on = [F.col(a) == F.col(f"__k_{b}") for a, b in keys.items()]
    return df.join(F.broadcast(t) if plan_bytes(table) <= limit else t, on, "left").drop(*[f"__k_{b}" for b in keys.values()])


def lookups(df: DataFrame, table: DataFrame, key: str, at: dict[str, str], cols: tuple[str, ...], default: object = None) -> DataFrame:
    """The dimension looked up once for each column of `at` (column: prefix of the new names); what is missing gets the default."""
    for column, prefix in at.items():
        if column in df.columns:
            df = lookup(df, table, {column: key}, {c: f"{prefix}{c}" for c in cols})
            if default is not None:
                df = df.fillna({f"{prefix}{c}": default for c in cols})
    return df


def with_support(df: DataFrame, keys: tuple[str, ...], least: int) -> DataFrame:
    """The rows whose group has at least `least` rows."""
    return df.join(df.groupBy(*keys).count().filter(F.col("count") >= least).select(*keys), list(keys), "left_semi")


def best_row(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, cols: tuple[str, ...], cell_seconds: int = 86_400) -> DataFrame:
    """The points, all of them, once for each span of their key that holds them: begin <= at < end.

    A span stands in each cell of time that it touches, so the join is by (key, cell).
    """
    cell = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / cell_seconds)
    s = spans.filter(F.col(begin) < F.col(end)).select(F.col(key).alias("__k"), F.col(begin).alias("__b"), F.col(end).alias("__e"), *[F.col(c).alias(f"span_{c}") for c in cols])
    s = s.withColumn("__c", F.explode(F.sequence(cell(F.col("__b")), cell(F.col("__e")))))
    on = (F.col(key) == F.col("__k")) & (F.col("__p") == F.col("__c")) & (F.col(at) >= F.col("__b")) & (F.col(at) < F.col("__e"))
    return points.withColumn("__p", cell(F.col(at))).join(s, on, "left").drop("__k", "__b", "__e", "__c", "__p")


def earth_cells(km: float) -> float:
    """Degrees of latitude that `km` spans: the least box for nearest_on_sphere at the equator."""
    return km / (math.pi * 6371.0 / 180)
