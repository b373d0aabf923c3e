"""Queries of the lineage engine over a table of flights made from the events, with aircraft that are not known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import flights, graph, lineage, series, statistics
from tidemark.plans.registry import query, rounded

#: A flight for each event: its clock times in HHMM, some over midnight, every fiftieth cancelled, every seventh user unknown.
FLIGHTS = """m as (select *, cast(hour(ts) * 60 + minute(ts) as bigint) as m, cast(floor(value) as bigint) % 90 - 20 as d, 30 + event_id % 200 as el, event_id % 50 = 0 as gone from events),
 c as (select *, (m + d + 1440) % 1440 as dm, (m + el) % 1440 as sm, (m + d + el + event_id % 11 - 5 + 2880) % 1440 as am from m),
 f as (select event_id, ts, case when user_id % 7 = 0 then null else 'N' || user_id end as tail_num, cast(ts as date) as fl_date, event_type as op_carrier, event_id as op_carrier_fl_num,
  'A' || (event_id % 5) as origin, 'A' || ((event_id * 3 + 1) % 5) as dest, m // 60 * 100 + m % 60 as crs_dep_time, case when not gone then dm // 60 * 100 + dm % 60 end as dep_time,
  sm // 60 * 100 + sm % 60 as crs_arr_time, case when not gone then am // 60 * 100 + am % 60 end as arr_time, case when not gone then cast(d as double) end as dep_delay,
  case when not gone then cast(d + event_id % 11 - 5 as double) end as arr_delay, cast(10 + event_id % 7 as double) as taxi_out, cast(5 + event_id % 5 as double) as taxi_in,
  case when not gone then (dm + 10 + event_id % 7) % 1440 // 60 * 100 + (dm + 10 + event_id % 7) % 1440 % 60 end as wheels_off, case when not gone then (am + 1435 - event_id % 5) % 1440 // 60 * 100 + (am + 1435 - event_id % 5) % 1440 % 60 end as wheels_on,
  cast(el as double) as crs_elapsed_time, cast(el + event_id % 11 - 5 as double) as actual_elapsed_time, cast(el - 20 as double) as air_time, el * 8.0 as distance, cast(gone as double) as cancelled, 0.0 as diverted from c)"""


def flights_table(t) -> DataFrame:
    e = t("events")
    clock = lambda c: F.floor(c / 60) * 100 + c % 60
    k, gone = F.col("event_id"), F.col("event_id") % 50 == 0
    m = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    d, el = F.floor("value") % 90 - 20, 30 + k % 200
    dm, am = (m + d + 1440) % 1440, (m + d + el + k % 11 - 5 + 2880) % 1440
    flown = lambda c: F.when(~gone, c)
    num = lambda c: c.cast("double")
    return e.select(
        "event_id", "ts", F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("N"), F.col("user_id").cast("string"))).alias("tail_num"), F.to_date("ts").alias("fl_date"), F.col("event_type").alias("op_carrier"),
        k.alias("op_carrier_fl_num"), F.concat(F.lit("A"), (k % 5).cast("string")).alias("origin"), F.concat(F.lit("A"), ((k * 3 + 1) % 5).cast("string")).alias("dest"), clock(m).alias("crs_dep_time"),
        flown(clock(dm)).alias("dep_time"), clock((m + el) % 1440).alias("crs_arr_time"), flown(clock(am)).alias("arr_time"), flown(num(d)).alias("dep_delay"), flown(num(d + k % 11 - 5)).alias("arr_delay"),
        num(10 + k % 7).alias("taxi_out"), num(5 + k % 5).alias("taxi_in"), flown(clock((dm + 10 + k % 7) % 1440)).alias("wheels_off"), flown(clock((am + 1435 - k % 5) % 1440)).alias("wheels_on"),
        num(el).alias("crs_elapsed_time"), num(el + k % 11 - 5).alias("actual_elapsed_time"), num(el - 20).alias("air_time"), (el * 8.0).alias("distance"), num(gone).alias("cancelled"), F.lit(0.0).alias("diverted"),
    )


def _mm(c: str) -> str:
    return f"({c} // 100 * 60 + {c} % 100)"


def _elapsed(a: str, b: str) -> str:
    return f"cast(case when {_mm(b)} < {_mm(a)} then {_mm(b)} - {_mm(a)} + 1440 else {_mm(b)} - {_mm(a)} end as double)"


def _at(day: str, c: str, after: str | None = None) -> str:
    """Minutes since 1970 of a clock, a day later if it is before the clock it follows."""
    base = f"(date_diff('day', date '1970-01-01', {day}) * 1440 + {_mm(c)})"
    return f"({base} + case when {_mm(c)} < {_mm(after)} then 1440 else 0 end)" if after else base


PREV = ("fl_date", "origin", "dest", "crs_dep_time", "dep_time", "crs_arr_time", "arr_time", "dep_delay", "arr_delay", "taxi_out", "taxi_in", "wheels_off", "wheels_on", "crs_elapsed_time", "actual_elapsed_time", "air_time", "distance", "cancelled", "diverted")
LINEAGE = f"""{FLIGHTS}, k as (select *, {_at('fl_date', 'coalesce(arr_time, crs_arr_time)')} as arrived, tail_num is not null as known from f),
 w as (select *, case when known then row_number() over w else 1 end as lineage_rank, {', '.join(f'case when known then lag({c}) over w end as p_{c}' for c in PREV)},
  case when known then sum(dep_delay) over p end as cum, case when known then count(dep_delay) over p else 0 end as num, case when known then avg(dep_delay) over p end as mean, case when known then max(dep_delay) over p end as most
  from k window w as (partition by tail_num order by arrived nulls last, fl_date, crs_dep_time, op_carrier_fl_num), p as (partition by tail_num order by arrived nulls last, fl_date, crs_dep_time, op_carrier_fl_num rows between unbounded preceding and 2 preceding)),
 x as (select *, lineage_rank > 1 and coalesce(p_dest <> origin, false) as is_jump, {_at('fl_date', 'crs_dep_time')} as sched, {_at('fl_date', 'crs_dep_time')} - 120 as cut, {_at('p_fl_date', 'p_crs_dep_time')} as ps, {_at('p_fl_date', 'p_crs_arr_time', 'p_crs_dep_time')} as pa,
  {_at('p_fl_date', 'p_dep_time')} as dep, {_at('p_fl_date', 'p_arr_time', 'p_dep_time')} as arr, {_at('p_fl_date', 'p_wheels_off', 'p_dep_time')} as off, {_at('p_fl_date', 'p_wheels_on', 'p_dep_time')} as wheels from w),
 y as (select *, coalesce(dep > cut, false) as ld, coalesce(arr > cut, false) as la, coalesce(off > cut, false) as lo, coalesce(wheels > cut, false) as lw from x),
 z as (select *, case when dep is not null and not ld then dep when ps is not null then greatest(ps, cut) end as safe_dep, p_crs_elapsed_time + {_elapsed('p_crs_arr_time', 'crs_dep_time')} as need,
  case when lineage_rank > 1 then case when not ld then coalesce(p_dep_delay, 0) when ps < cut then cut - ps else 0 end end as sd, case when lineage_rank > 1 then case when not la then coalesce(p_arr_delay, 0) when pa < cut then cut - pa else 0 end end as sa from y)"""

LEAKS = (("prev_flight_dep_time", "ld"), ("prev_flight_arr_time", "la"), ("prev_flight_wheels_off", "lo"), ("prev_flight_wheels_on", "lw"), ("prev_flight_dep_delay", "ld"), ("lineage_rotation_time_minutes", "ld"), ("prev_flight_taxi_out", "lo"), ("prev_flight_arr_delay", "la"), ("prev_flight_taxi_in", "la"), ("prev_flight_air_time", "lw"), ("prev_flight_actual_elapsed_time", "la"), ("lineage_actual_turnover_time_minutes", "la"))


@query(f"with {LINEAGE} select event_id, cast(lineage_rank as int) as lineage_rank, p_origin as prev_flight_origin, is_jump as lineage_is_jump, num as lineage_num_previous_flights, coalesce(cum, 0) as lineage_cumulative_delay, round(coalesce(mean, 9.37), 6) as lineage_avg_previous_delay, coalesce(most, 0) as lineage_max_delay, coalesce(p_taxi_out, 15) as prev_flight_taxi_out, coalesce(p_distance, 0) as prev_flight_distance from w0".replace("from w0", "from x"))
def lineage_previous(t):
    out = flights.add_lineage_features(flights_table(t))
    return rounded(out.select("event_id", "lineage_rank", "prev_flight_origin", "lineage_is_jump", "lineage_num_previous_flights", "lineage_cumulative_delay", "lineage_avg_previous_delay", "lineage_max_delay", "prev_flight_taxi_out", "prev_flight_distance"))


@query(f"with {LINEAGE} select event_id, coalesce({_elapsed('p_arr_time', 'dep_time')}, 1440) as turnover, case when lineage_rank = 1 or is_jump then 0 else {_elapsed('p_crs_dep_time', 'p_crs_arr_time')} end as flight_time, coalesce({_elapsed('p_crs_dep_time', 'crs_dep_time')}, 1440) as scheduled_rotation, coalesce({_elapsed('p_crs_arr_time', 'crs_dep_time')}, 1440) as scheduled_turnover, coalesce({_elapsed('p_dep_time', 'crs_dep_time')}, 1440) as rotation, coalesce(cast({_mm('p_crs_dep_time')} as double), ({_mm('crs_dep_time')} - 240 + 1440) % 1440) as previous_departure from x")
def lineage_times(t):
    out = flights.add_lineage_features(flights_table(t))
    names = {"lineage_actual_turnover_time_minutes": "turnover", "prev_flight_scheduled_flight_time_minutes": "flight_time", "scheduled_lineage_rotation_time_minutes": "scheduled_rotation", "scheduled_lineage_turnover_time_minutes": "scheduled_turnover", "lineage_rotation_time_minutes": "rotation", "prev_flight_crs_dep_minutes": "previous_departure"}
    return out.select("event_id", *[F.col(a).alias(b) for a, b in names.items()])


@query(f"with {LINEAGE} select event_id, concat_ws(',', {', '.join(f'''case when {f} then '{n}' end''' for n, f in LEAKS)}) as leaking, not ld as dep_safe, not la as arr_safe, coalesce(sd, -10) as safe_departure_delay, coalesce(sa, -10) as safe_arrival_delay, coalesce(cast(sched - safe_dep as double), 1440) as safe_rotation from z")
def lineage_safe(t):
    out = flights.add_lineage_features(flights_table(t))
    return out.select("event_id", F.array_join("columns_with_data_leakage", ",").alias("leaking"), F.col("prev_flight_dep_time_safe_to_use").alias("dep_safe"), F.col("prev_flight_arr_time_safe_to_use").alias("arr_safe"), F.col("safe_prev_departure_delay").alias("safe_departure_delay"), F.col("safe_prev_arrival_delay").alias("safe_arrival_delay"), F.col("safe_lineage_rotation_time_minutes").alias("safe_rotation"))


@query(f"with {LINEAGE} select event_id, coalesce(need, 120) as required, coalesce(need > sched - safe_dep, false) as impossible, cast(case when arr is not null and not la then cut - arr when pa < cut then 0 else cut - pa end as double) as since_arrival from z")
def lineage_required(t):
    out = flights.add_lineage_features(flights_table(t))
    return out.select("event_id", F.col("safe_required_time_prev_flight_minutes").alias("required"), F.col("safe_impossible_on_time_flag").alias("impossible"), F.col("safe_time_since_prev_arrival").alias("since_arrival"))


@query(f"with {LINEAGE} select count(*) as n, round(avg(lineage_rank), 6) as mean_rank from z where lineage_rank > 1 and not is_jump")
def lineage_training_rows(t):
    return rounded(flights.training_rows(flights.add_lineage_features(flights_table(t))).agg(F.count(F.lit(1)).alias("n"), F.avg("lineage_rank").alias("mean_rank")))


def _mean_sql(key: str, minutes: int) -> str:
    return f"(select a.event_id, avg(b.dep_delay) as m from g a join g b on a.{key} = b.{key} and b.sched <= a.cut and b.sched >= a.cut - {minutes} and b.event_id <> a.event_id group by 1)"


@query(f"with {FLIGHTS}, g as (select *, {_at('fl_date', 'crs_dep_time')} as sched, {_at('fl_date', 'crs_dep_time')} - 120 as cut from f) select g.event_id, " + ", ".join(f"round({k}{n}.m, 6) as {name}_{n}" for k, name in (("t", "tail"), ("o", "origin")) for n in ("24h", "7d", "30d")) + " from g " + " ".join(f"left join {_mean_sql(key, m)} {k}{n} on {k}{n}.event_id = g.event_id" for k, key in (("t", "tail_num"), ("o", "origin")) for n, m in (("24h", 1440), ("7d", 10_080), ("30d", 43_200))))
def lineage_rolling_means(t):
    out = flights.add_lineage_features(flights_table(t), rolling=True)
    return out.select("event_id", *[F.round(f"{e}_mean_delay_{s}", 6).alias(f"{e}_{s}") for e in ("tail", "origin") for s in flights.SPANS])


@query(f"""with {FLIGHTS}, r as (select origin, dest, avg(air_time) as air from f group by all), u as (select op_carrier, origin, 30.0 + count(*) % 7 as turn from f group by all),
 d as (select *, row_number() over w as day_rank, lag(dest) over w as pd, lag(origin) over w as po, lag(dep_time) over w as pt, avg(dep_delay) over (partition by tail_num, fl_date order by crs_dep_time, op_carrier_fl_num rows between unbounded preceding and 1 preceding) as mean from f where tail_num is not null window w as (partition by tail_num, fl_date order by crs_dep_time, op_carrier_fl_num)),
 e as (select d.*, {_mm('pt')} + r.air as arrival, u.turn from d left join r on r.origin = d.po and r.dest = d.pd left join u on u.op_carrier = d.op_carrier and u.origin = d.origin),
 l as (select *, lag(arrival) over (partition by tail_num, fl_date order by crs_dep_time, op_carrier_fl_num) as pa from e)
 select event_id, cast(day_rank as int) as day_rank, day_rank > 1 and coalesce(pd <> origin, true) as is_jump, round(mean, 6) as day_delay_avg, round(arrival, 6) as expected_arrival, round({_mm('crs_dep_time')} - (pa + turn), 6) as time_buffer, cast({_mm('crs_dep_time')} - (pa + turn) < 0 as int) as impossible from l""")
def day_lineage(t):
    f = flights_table(t)
    route = f.groupBy("origin", "dest").agg(F.avg("air_time").alias("expected_air_minutes"))
    turn = f.groupBy("op_carrier", "origin").agg((F.lit(30.0) + F.count(F.lit(1)) % 7).alias("expected_turn_minutes"))
    out = flights.day_lineage(f, "tail_num", route, turn)
    return rounded(out.select("event_id", "day_rank", "is_jump", "day_delay_avg", "expected_arrival", "time_buffer", F.col("impossible_on_time_flag").alias("impossible")))


@query("select event_id, case when u is null then 1 else row_number() over (partition by u order by ts, event_id) end as lineage_rank, round(case when u is not null then sum(value) over w end, 6) as cum_sum, case when u is null then 0 else count(value) over w end as cum_count, case when u is not null then max(value) over w end as cum_max from (select *, nullif(user_id, 8) as u from events) window w as (partition by u order by ts, event_id rows between unbounded preceding and 2 preceding)")
def lineage_without_entity(t):
    e = t("events").withColumn("u", F.expr("nullif(user_id, 8)"))
    out = lineage.cumulative(lineage.previous_event(e, "u", ("ts", "event_id"), ()), "u", ("ts", "event_id"), "value")
    return rounded(out.select("event_id", "lineage_rank", "cum_sum", "cum_count", "cum_max"))


@query("select event_id, round(avg(b_value), 6) as mean from (select a.event_id, b.value as b_value from (select *, nullif(user_id, 8) as u from events) a left join (select *, nullif(user_id, 8) as u from events) b on b.u = a.u and b.ts <= a.ts - interval 2 hour and b.ts >= a.ts - interval 170 hour and b.event_id <> a.event_id) group by event_id")
def rolling_mean_without_entity(t):
    e = t("events").withColumn("u", F.expr("nullif(user_id, 8)"))
    out = lineage.rolling_mean(e, "u", "ts", F.col("ts") - F.expr("interval 2 hours"), "value", 604_800, "mean")
    return rounded(out.select("event_id", "mean"))


@query("with p as (select event_id, user_id, try_cast(case when event_id % 4 = 0 then 'M' when event_id % 4 = 1 then value || 's' else cast(value as varchar) end as double) as v, ts from events) select event_id, lag(v) over (partition by user_id order by ts, event_id) as prev_reading from p")
def previous_numbers(t):
    text = F.when(F.col("event_id") % 4 == 0, "M").when(F.col("event_id") % 4 == 1, F.concat(F.col("value").cast("string"), F.lit("s"))).otherwise(F.col("value").cast("string"))
    out = lineage.previous_numbers(t("events").withColumn("reading", text), "user_id", ("ts", "event_id"), ("reading", "absent"))
    return out.select("event_id", "prev_reading")


@query(f"with {LINEAGE}, q as (select p_crs_elapsed_time as a, safe_dep, sched from z) select count(*) as n, count(*) filter (a <> sched - safe_dep) as differ, round(count(*) filter (a <> sched - safe_dep) / count(*), 6) as share, round(avg(abs(a - (sched - safe_dep))), 6) as mean_difference from q where a is not null")
def flag_agreement(t):
    out = flights.with_safe(flights.with_leaks(flights.with_times(flights.with_previous(flights_table(t), "tail_num"))))
    return rounded(statistics.flag_agreement(out, "prev_flight_crs_elapsed_time", "safe_lineage_rotation_time_minutes"))


@query(f"with {LINEAGE} select cast(lineage_rank as int) as lineage_rank, count(*) as n from z group by 1 order by n desc, lineage_rank limit 20")
def rank_distribution(t):
    return statistics.rank_distribution(flights.with_previous(flights_table(t), "tail_num"))


EXPECTED = {"expected_air_time": ("air_time", (("origin", "dest", "month"), ("origin", "dest"))), "expected_turnover_time": ("taxi_in", (("op_carrier", "origin", "month"), ("op_carrier", "origin"), ("origin",)))}


def _expected_sql(least: int) -> str:
    parts, joins = [], []
    for name, (value, levels) in EXPECTED.items():
        for i, keys in enumerate(levels):
            on = " and ".join(f"h.{k} = {name}{i}.{k}" for k in keys)
            joins.append(f"left join (select {', '.join(keys)}, avg({value}) as v from h where fl_date < date '2024-01-15' group by all having count({value}) >= {least}) {name}{i} on {on}")
        parts.append(f"round(coalesce({', '.join(f'{name}{i}.v' for i in range(len(levels)))}, 0), 6) as {name}")
    return f"with {FLIGHTS}, h as (select *, month(fl_date) as month from f) select h.event_id, {', '.join(parts)} from h {' '.join(joins)}"


@query(_expected_sql(40))
def expected_values(t):
    f = flights_table(t)
    out = series.ExpectedValues(EXPECTED, least=40).fit(f.filter("fl_date < date'2024-01-15'")).transform(f)
    return rounded(out.select("event_id", *EXPECTED))


def _seasonal_sql() -> str:
    train = "(select * from f where fl_date < date '2024-01-20')"

    def made(name: str, group: str | None) -> str:
        g = f"{group}, " if group else ""
        p = f"partition by {group}" if group else ""
        and_ = "and" if group else ""
        by = f"{group}, " if group else ""
        s = f"(select {g}fl_date as date, avg(dep_delay) as v from {train} group by all)"
        s = f"(select * from {s} q where {group} in (select {group} from {s} group by 1 having count(*) >= 14))" if group else s
        return (f"{name} as (select {g}date, avg(v) over ({p} order by date rows between 30 preceding and current row) as trend, avg(v) over (partition by {by}dayofweek(date)) - avg(v) over ({p}) as weekly,"
                f" avg(v) over (partition by {by}month(date)) - avg(v) over ({p}) as yearly from {s})")  # fmt: skip

    cols = ("trend", "weekly", "yearly")
    back = "b as (select max(trend) as trend, avg(weekly) as weekly, avg(yearly) as yearly from gl)"
    g = {c: f"coalesce(gl.{c}, b.{c})" for c in cols}
    line = lambda p, x: ", ".join([f"round({x[c]}, 6) as {p}_{c}" for c in cols] + [f"round({' + '.join(x[c] for c in cols)}, 6) as {p}_forecast"])
    ca, og = ({c: f"coalesce({a}.{c}, {g[c]})" for c in cols} for a in ("ca", "og"))
    return f"with {FLIGHTS}, {made('gl', None)}, {made('ca', 'op_carrier')}, {made('og', 'origin')}, {back} select event_id, {line('global', g)}, {line('carrier', ca)}, {line('origin', og)} from f cross join b left join gl on gl.date = fl_date left join ca on ca.date = fl_date and ca.op_carrier = f.op_carrier left join og on og.date = fl_date and og.origin = f.origin"


@query(_seasonal_sql())
def time_series_features(t):
    f = flights_table(t)
    out = series.TimeSeriesFeatures().fit(f.filter("fl_date < date'2024-01-20'")).transform(f)
    return rounded(out.select("event_id", *[f"{p}_{c}" for p in ("global", "carrier", "origin") for c in ("trend", "weekly", "yearly", "forecast")]))


def _scores_sql(rounds: int = 5) -> str:
    def ranks(p: str, weight: str) -> str:
        out = [f"{p}0 as (select id, 1.0 / (select count(*) from n) as rank from n)"]
        for i in range(rounds):
            out.append(f"{p}{i + 1} as (select n.id, 0.15 / c.n + 0.85 * coalesce(g.given, 0) as rank from n cross join (select count(*) as n from n) c left join (select dst, sum(rank * {weight} / total) as given from e join {p}{i} on src = {p}{i}.id join (select src, sum({weight}) as total from e group by 1) using (src) group by dst) g on g.dst = n.id)")
        return ", ".join(out)

    return (f"with {FLIGHTS}, e as (select origin as src, dest as dst, count(*) as weight from f where fl_date < date '2024-01-15' group by 1, 2), n as (select src as id from e union select dst from e), {ranks('u', '1')}, {ranks('v', 'weight')}"
            f" select event_id, " + ", ".join(f"round(coalesce({c}u.rank * (select count(*) from n), 0), 6) as {c}_pagerank_unweighted, round(coalesce({c}v.rank * (select count(*) from n), 0), 6) as {c}_pagerank_weighted" for c in ("origin", "dest"))
            + " from f " + " ".join(f"left join u{rounds} {c}u on {c}u.id = f.{c} left join v{rounds} {c}v on {c}v.id = f.{c}" for c in ("origin", "dest")))


@query(_scores_sql())
def graph_features(t):
    f = flights_table(t)
    model = graph.GraphFeatures(iterations=5).fit(f.filter("fl_date < date'2024-01-15'"))
    out = model.transform(f)
    return rounded(model.transform(out).select("event_id", *[f"{c}_{s}" for c in ("origin", "dest") for s in graph.GraphFeatures.SCORES]))
