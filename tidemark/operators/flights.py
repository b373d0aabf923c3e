"""The lineage engine: what an aircraft's previous flights tell about the next one, as known two hours before departure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clock_timestamp, elapsed_minutes, hhmm_minutes
from tidemark.operators.lineage import CUTOFF_SECONDS, jump, leaks, lineage_window, rolling_means, safe_delay, twice_lagged
from tidemark.sources.tables import FoldStore, is_complete, resolve_column, staged, write_sized

#: Columns that may hold the aircraft, in this order.
TAILS = ("tail_num", "tail_number", "tailnum", "tail", "aircraft")
#: Columns of the previous flight that are carried.
CARRIED = (
    "fl_date", "op_carrier", "op_carrier_fl_num", "origin", "dest", "crs_dep_time", "dep_time", "crs_arr_time", "arr_time", "dep_delay", "arr_delay", "taxi_out", "taxi_in",
    "wheels_off", "wheels_on", "crs_elapsed_time", "actual_elapsed_time", "air_time", "distance", "cancelled", "diverted",
)
#: What stands in for features that a first flight or a gap leaves null.
FILL = {
    "prev_flight_dep_delay": -10.0, "prev_flight_arr_delay": -10.0, "safe_prev_departure_delay": -10.0, "safe_prev_arrival_delay": -10.0, "prev_flight_taxi_in": 10.0, "prev_flight_taxi_out": 15.0,
    "prev_flight_distance": 0.0, "prev_flight_cancelled": 0.0, "prev_flight_diverted": 0.0, "lineage_rotation_time_minutes": 1440.0, "safe_lineage_rotation_time_minutes": 1440.0,
    "scheduled_lineage_rotation_time_minutes": 1440.0, "lineage_actual_turnover_time_minutes": 1440.0, "scheduled_lineage_turnover_time_minutes": 1440.0, "lineage_avg_previous_delay": 9.37,
    "lineage_cumulative_delay": 0.0, "lineage_max_delay": 0.0, "safe_required_time_prev_flight_minutes": 120.0,
}
#: Expected minutes in the air and on the ground, the most specific first; those that exist are used.
EXPECTED_AIR = ("expected_air_time_route_temporal_minutes", "expected_air_time_route_minutes", "expected_air_time_aircraft_minutes")
EXPECTED_TURN = ("expected_turnover_time_temporal_minutes", "expected_turnover_time_carrier_airport_minutes", "expected_turnover_time_aircraft_minutes")
SPANS = {"24h": 86_400, "7d": 604_800, "30d": 2_592_000}


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def _next_day(at: Column, clock: Column, after: Column) -> Column:
    """The timestamp a day later where its clock is before that of what it follows."""
    return F.when(hhmm_minutes(clock) < hhmm_minutes(after), F.timestamp_seconds(_seconds(at) + 86_400)).otherwise(at)


def with_previous(df: DataFrame, tail: str, delay: str = "dep_delay") -> DataFrame:
    """Rank, previous flight's columns and cumulative delays (without the last flight, which may still fly), over one sort by arrival."""
    df = df.withColumn("arrival_timestamp", clock_timestamp(F.col("fl_date"), F.coalesce(F.col("arr_time"), F.col("crs_arr_time"))))
    keys = [F.col("arrival_timestamp").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("fl_date", "crs_dep_time", "op_carrier_fl_num") if c in df.columns]]
    rows, w = lineage_window(df, tail)
    w = w.orderBy(*keys)
    past = w.rowsBetween(Window.unboundedPreceding, -2)
    d = F.col(delay).cast("double")
    made = {f"prev_flight_{c}": F.lag(c).over(w) for c in CARRIED if c in df.columns} | {
        "lineage_rank": F.row_number().over(w), "lineage_cumulative_delay": F.sum(d).over(past), "lineage_num_previous_flights": F.count(d).over(past),
        "lineage_avg_previous_delay": F.avg(d).over(past), "lineage_max_delay": F.max(d).over(past),
    }
    return rows.withColumns(made).drop("__alone")


def with_times(df: DataFrame) -> DataFrame:
    """Turnover and rotation, scheduled and actual, in minutes over midnight, and whether the aircraft turned up elsewhere."""
    p = lambda c: F.col(f"prev_flight_{c}")
    dep = F.col("crs_dep_time")
    return df.withColumns({
        "crs_dep_time_minutes": hhmm_minutes(dep).cast("double"),
        "lineage_actual_turnover_time_minutes": elapsed_minutes(p("arr_time"), F.col("dep_time")).cast("double"),
        "prev_flight_scheduled_flight_time_minutes": elapsed_minutes(p("crs_dep_time"), p("crs_arr_time")).cast("double"),
        "scheduled_lineage_rotation_time_minutes": elapsed_minutes(p("crs_dep_time"), dep).cast("double"),
        "scheduled_lineage_turnover_time_minutes": elapsed_minutes(p("crs_arr_time"), dep).cast("double"),
        "lineage_expected_flight_time_minutes": p("crs_elapsed_time").cast("double"),
        "lineage_rotation_time_minutes": elapsed_minutes(p("dep_time"), dep).cast("double"),
        "lineage_is_jump": jump(F.col("lineage_rank"), p("dest"), F.col("origin")),
    })


def with_leaks(df: DataFrame) -> DataFrame:
    """The cut-off, the previous flight's moments, which of them are not known at the cut-off, and the columns that hang on them."""
    p = lambda c: F.col(f"prev_flight_{c}")
    day = p("fl_date")
    df = df.withColumn("scheduled_departure", clock_timestamp(F.col("fl_date"), F.col("crs_dep_time")))
    df = df.withColumn("prediction_cutoff", F.timestamp_seconds(_seconds(F.col("scheduled_departure")) - CUTOFF_SECONDS))
    sched, left = clock_timestamp(day, p("crs_dep_time")), clock_timestamp(day, p("dep_time"))
    df = df.withColumns({
        "prev_scheduled_departure": sched, "prev_scheduled_arrival": _next_day(clock_timestamp(day, p("crs_arr_time")), p("crs_arr_time"), p("crs_dep_time")),
        "prev_departure": left, "prev_arrival": _next_day(clock_timestamp(day, p("arr_time")), p("arr_time"), p("dep_time")),
        "prev_wheels_off": _next_day(clock_timestamp(day, p("wheels_off")), p("wheels_off"), p("dep_time")), "prev_wheels_on": _next_day(clock_timestamp(day, p("wheels_on")), p("wheels_on"), p("dep_time")),
    })
    times = {"prev_flight_dep_time": F.col("prev_departure"), "prev_flight_arr_time": F.col("prev_arrival"), "prev_flight_wheels_off": F.col("prev_wheels_off"), "prev_flight_wheels_on": F.col("prev_wheels_on")}
    hang = {
        "prev_flight_dep_delay": "prev_departure", "lineage_rotation_time_minutes": "prev_departure", "prev_flight_taxi_out": "prev_wheels_off", "prev_flight_arr_delay": "prev_arrival",
        "prev_flight_taxi_in": "prev_arrival", "prev_flight_air_time": "prev_wheels_on", "prev_flight_actual_elapsed_time": "prev_arrival", "lineage_actual_turnover_time_minutes": "prev_arrival",
    }
    flags, names = leaks(F.col("prediction_cutoff"), times | {k: F.col(v) for k, v in hang.items()})
    df = df.withColumns({f"has_leakage_{k}": v for k, v in flags.items()} | {"columns_with_data_leakage": names})
    return df.withColumns({"prev_flight_dep_time_safe_to_use": ~F.col("has_leakage_prev_flight_dep_time"), "prev_flight_arr_time_safe_to_use": ~F.col("has_leakage_prev_flight_arr_time")})


def with_safe(df: DataFrame) -> DataFrame:
    """What may be used at the cut-off: the previous departure (no earlier than the cut-off if still unknown), rotation and delays."""
    cut, sched = F.col("prediction_cutoff"), F.col("prev_scheduled_departure")
    left = F.when(F.col("prev_departure").isNotNull() & ~F.col("has_leakage_prev_flight_dep_time"), F.col("prev_departure")).when(sched.isNotNull(), F.greatest(sched, cut))
    arr = safe_delay(F.col("prev_flight_arr_delay").cast("double"), F.col("has_leakage_prev_flight_arr_time"), F.col("prev_scheduled_arrival"), cut)
    dep = safe_delay(F.col("prev_flight_dep_delay").cast("double"), F.col("has_leakage_prev_flight_dep_time"), sched, cut)
    first = F.col("lineage_rank") == 1
    df = df.withColumn("safe_prev_flight_dep_timestamp", left)
    rotation = (_seconds(F.col("scheduled_departure")) - _seconds(F.col("safe_prev_flight_dep_timestamp"))) / 60
    return df.withColumns({"safe_lineage_rotation_time_minutes": rotation, "safe_prev_departure_delay": F.when(~first, dep), "safe_prev_arrival_delay": F.when(~first, arr)})


def with_required(df: DataFrame) -> DataFrame:
    """Minutes the aircraft needs from its previous departure to this one, and whether they are more than there are."""
    air = [F.col(c) for c in EXPECTED_AIR if c in df.columns] + [F.col("prev_flight_crs_elapsed_time")]
    turn = [F.col(c) for c in EXPECTED_TURN if c in df.columns] + [F.col("scheduled_lineage_turnover_time_minutes")]
    need = F.coalesce(*[c.cast("double") for c in air]) + F.coalesce(*[c.cast("double") for c in turn])
    df = df.withColumn("safe_required_time_prev_flight_minutes", need)
    return df.withColumn("safe_impossible_on_time_flag", F.coalesce(need > F.col("safe_lineage_rotation_time_minutes"), F.lit(False)))


def with_fill(df: DataFrame) -> DataFrame:
    """Time since the previous arrival as known at the cut-off, then stand-ins for what is null.

    The first is read before any stand-in is put, so a filled arrival never passes for an actual one.
    """
    cut, sched = _seconds(F.col("prediction_cutoff")), _seconds(F.col("prev_scheduled_arrival"))
    known = F.col("prev_arrival").isNotNull() & ~F.col("has_leakage_prev_flight_arr_time")
    since = F.when(known, (cut - _seconds(F.col("prev_arrival"))) / 60).when(sched < cut, F.lit(0.0)).otherwise((cut - sched) / 60)
    first = (F.col("lineage_rank") == 1) | F.col("lineage_is_jump")
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in FILL.items() if c in df.columns}
    fill["prev_flight_crs_dep_minutes"] = F.coalesce(hhmm_minutes(F.col("prev_flight_crs_dep_time")).cast("double"), F.pmod(F.col("crs_dep_time_minutes") - 240, F.lit(1440)))
    fill["prev_flight_scheduled_flight_time_minutes"] = F.when(first, F.lit(0.0)).otherwise(F.col("prev_flight_scheduled_flight_time_minutes"))
    return df.withColumn("safe_time_since_prev_arrival", since).withColumns(fill)


def add_lineage_features(df: DataFrame, rolling: bool = False, tail: str | None = None) -> DataFrame:
    """All features in one call; with `rolling` also the mean delays of the aircraft and the origin over three spans."""
    tail = tail or resolve_column(df, TAILS, "tail")
    if rolling:  # flights are numbered as they come, so that the means are found from a few columns and the features computed once
        df = staged(df.withColumn("__flight", F.monotonically_increasing_id()))
    out = with_fill(with_required(with_safe(with_leaks(with_times(with_previous(df, tail))))))
    if rolling:
        for entity, name in ((tail, "tail"), ("origin", "origin")):
            out = rolling_means(out, entity, "scheduled_departure", F.col("prediction_cutoff"), "dep_delay", {f"{name}_mean_delay_{k}": s for k, s in SPANS.items()}, "__flight")
        out = out.drop("__flight")
    return out


def training_rows(df: DataFrame) -> DataFrame:
    """Rows whose previous flight is known and ended where this one starts."""
    return df.filter((F.col("lineage_rank") > 1) & ~F.col("lineage_is_jump"))


def patch_safe_delays(store: FoldStore, version: str, suffix: str = "_SAFE") -> list[int]:
    """Recompute the safe features of stored folds from their columns; folds that are done are passed over."""
    to, made = FoldStore(store.spark, store.root, store.source, store.suffix + suffix), []
    for i in store.versions().get(version, []):
        f = store.fold(version, i)
        for kind, part in (("TRAIN", f.train), (f.kind, f.held)):
            if not is_complete(store.spark, to.path(version, i, kind), ("safe_prev_departure_delay", "safe_prev_arrival_delay"), 0.0):
                write_sized(with_fill(with_required(with_safe(part))), to.path(version, i, kind))
                made.append(i)
    return sorted(set(made))


def day_lineage(df: DataFrame, tail: str, route: DataFrame, turn: DataFrame) -> DataFrame:
    """The day's own lineage: an aircraft's flights of one day by scheduled departure, expected times chained from flight to flight.

    `route` has (origin, dest, expected_air_minutes), `turn` (op_carrier, origin, expected_turn_minutes).  Unlike in the
    engine a flight after one of unknown destination counts as a jump.  All times are minutes of the day.
    """
    day, order = (tail, "fl_date"), ("crs_dep_time", "op_carrier_fl_num")
    w = Window.partitionBy(*day).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.filter(F.col(tail).isNotNull()).withColumns({"day_rank": F.row_number().over(w), "prev_dest": F.lag("dest").over(w), "prev_dep_time": F.lag("dep_time").over(w), "prev_origin": F.lag("origin").over(w), "day_delay_sum": F.sum("dep_delay").over(past), "day_delay_avg": F.avg("dep_delay").over(past)})
    out = out.withColumn("is_jump", jump(F.col("day_rank"), F.col("prev_dest"), F.col("origin"), unknown=True))
    r = route.select(F.col("origin").alias("__o"), F.col("dest").alias("__d"), "expected_air_minutes")
    t = turn.select(F.col("op_carrier").alias("__c"), F.col("origin").alias("__a"), "expected_turn_minutes")
    out = out.join(r, (F.col("prev_origin") == F.col("__o")) & (F.col("prev_dest") == F.col("__d")), "left").join(t, (F.col("op_carrier") == F.col("__c")) & (F.col("origin") == F.col("__a")), "left")
    out = twice_lagged(out.drop("__o", "__d", "__c", "__a"), day, order, hhmm_minutes(F.col("prev_dep_time")) + F.col("expected_air_minutes"), "expected_arrival")
    buffer = hhmm_minutes(F.col("crs_dep_time")) - (F.col("prev_expected_arrival") + F.col("expected_turn_minutes"))
    return out.withColumn("time_buffer", buffer).withColumn("impossible_on_time_flag", (F.col("time_buffer") < 0).cast("int"))
