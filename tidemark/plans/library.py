"""Queries of joins, sources and sinks, column helpers, statistics and models over the driver's tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import graph, joins, metrics, network, series, statistics
from tidemark.plans.catalog import DAILY, EDGES, HEAVY, PREDICTED, _heavy, _nation_pairs, _predicted
from tidemark.plans.registry import query, rounded
from tidemark.sources import mapping, tables

# ---------------------------------------------------------------- joins


@query("""with a as (select c_custkey as id, c_acctbal / 250 as lat, c_nationkey * 0.4 + (c_custkey % 7) * 0.1 as lon from customer), s as (select s_suppkey as sid, s_acctbal / 250 as lat, s_nationkey * 0.4 as lon from supplier),
 d as (select id, sid, 6371.0 * acos(greatest(-1, least(1, cos(radians(a.lat)) * cos(radians(s.lat)) * cos(radians(s.lon) - radians(a.lon)) + sin(radians(a.lat)) * sin(radians(s.lat))))) as km from a join s on abs(a.lat - s.lat) <= 0.5 and abs(a.lon - s.lon) <= 0.5),
 b as (select id, sid, km, row_number() over (partition by id order by km, sid) as rn from d where km < 50) select a.id, b.sid, round(b.km, 4) as km from a left join b on a.id = b.id and rn = 1""")
def nearest_station(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 250).alias("lat"), (F.col("c_nationkey") * 0.4 + (F.col("c_custkey") % 7) * 0.1).alias("lon"))
    s = t("supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_acctbal") / 250).alias("lat"), (F.col("s_nationkey") * 0.4).alias("lon"))
    return joins.with_nearest(a, s, "id", "sid").select("id", "sid", F.round("distance_km", 4).alias("km"))


@query("select c_custkey, s_suppkey, s_name from (select c_custkey, s_suppkey, s_name, row_number() over (partition by c_custkey order by s_suppkey) as rn from customer left join (select * from supplier where s_acctbal > 5000) on c_custkey = s_suppkey or c_nationkey = s_nationkey) where rn = 1")
def either_key_best(t):
    out = joins.either_key_best(t("customer"), t("supplier").filter("s_acctbal > 5000"), (("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")), ("s_suppkey",), ("s_suppkey", "s_name"))
    return out.select("c_custkey", "s_suppkey", "s_name")


@query("select distinct c_custkey, s_suppkey from customer left join (select * from supplier where s_acctbal > 9000) on c_custkey = s_suppkey or c_nationkey = s_nationkey")
def either_key_left(t):
    return joins.either_key_join(t("customer"), t("supplier").filter("s_acctbal > 9000"), (("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")), "c_custkey", "s_suppkey", "left")


@query("with s as (select event_id as span, user_id as u, ts as b, ts + interval 90 minute as e from events where event_type = 'error') select event_id, span from events left join s on u = user_id and ts >= b and ts < e")
def interval_join(t):
    s = t("events").filter("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("b"), (F.col("ts") + F.expr("interval 90 minutes")).alias("e"))
    return joins.interval_join(t("events"), s, "user_id", "ts", "b", "e", ("id",)).select("event_id", F.col("span_id").alias("span"))


@query("""with l as (select event_id, nullif(user_id, 8) as u, ts from events where event_type = 'click'), r as (select user_id as u, ts, max(event_id) as id from events where event_type = 'error' group by all)
select l.event_id, case when floor(epoch(r.ts) / 1800) >= floor(epoch(l.ts) / 1800) - 1 then r.id end as matched from l asof left join r on l.u = r.u and l.ts >= r.ts""")
def asof_unknown_keys(t):
    e = t("events").withColumn("u", F.expr("nullif(user_id, 8)"))
    out = joins.asof_join(e.filter("event_type = 'click'"), t("events").filter("event_type = 'error'").withColumnRenamed("user_id", "u"), "u", "ts", "ts", 1800, ("event_id",), (), ("event_id",))
    return out.select("event_id", F.col("matched_event_id").alias("matched"))


@query("""with l as (select event_id, user_id as u, ts, floor(epoch(ts) / 1800) as k from events where event_type = 'click'), r as (select event_id as id, user_id as u, ts, floor(epoch(ts) / 1800) as k from events where event_type = 'error'),
 p as (select l.event_id, count(r.id) as near, max(case when r.ts <= l.ts then r.ts end) as best from l left join r on r.u = l.u and r.k in (l.k, l.k - 1) group by 1)
select event_id, best is not null as matched from p where near = 0 or best is not null""")
def asof_dropping_later_only(t):
    e = t("events")
    out = joins.asof_join(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), "user_id", "ts", "ts", 1800, ("event_id",), (), ("event_id",), drop_unmatched_buckets=True)
    return out.select("event_id", F.col("matched_event_id").isNotNull().alias("matched"))


@query("select e.event_id, coalesce(a.n_name, 'none') as a_name, coalesce(b.n_name, 'none') as b_name from events e left join nation a on a.n_nationkey = e.user_id left join nation b on b.n_nationkey = e.event_id % 30")
def dimension_lookups(t):
    e = t("events").withColumns({"a": F.col("user_id"), "b": F.col("event_id") % 30})
    return joins.lookups(e, t("nation").select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey", {"a": "a_", "b": "b_", "absent": "c_"}, ("name",), "none").select("event_id", "a_name", "b_name")


# ---------------------------------------------------------------- sources and sinks: what was written is read again


def _at(df: DataFrame, name: str) -> str:
    return f"{tables.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_round_trip(t):
    df = t("nation")
    path = _at(df, "csv")
    df.write.option("header", True).csv(path)
    return tables.read_csv(df.sparkSession, path, df.schema)


@query("select s_suppkey, s_name, s_acctbal from supplier")
def caret_csv_columns(t):
    df = t("supplier")
    path = _at(df, "csv")
    df.write.option("header", True).option("sep", "^").csv(path)
    out = tables.read_csv(df.sparkSession, path, sep="^", columns=("s_suppkey", "s_name", "s_acctbal"), infer=True)
    return out.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_acctbal")


@query("select c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1")
def partitioned_round_trip(t):
    df = t("customer")
    path = _at(df, "parted")
    tables.write_sized(df, path, partition_by=("c_nationkey",))
    back, _ = tables.read_guarded(df.sparkSession, path, few=(0,))
    return back.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select o_orderkey as id, o_totalprice as price, cast(null as varchar) as note from orders union all select l_orderkey, null, l_returnflag from lineitem")
def merged_schemas(t):
    a, b = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("note"))
    root = _at(a, "merge")
    tables.write_adaptive(a, f"{root}/a")
    tables.write_verified(b, f"{root}/b", ("note",))
    return tables.read_table(a.sparkSession, f"{root}/a", f"{root}/b", merge=True).select("id", "price", "note")


@query(f"with {EDGES} select cast(src as varchar) as src, cast(dst as varchar) as dst, weight from e")
def adjacency_round_trip(t):
    e = graph.edge_weights(_nation_pairs(t), "s_nationkey", "c_nationkey")
    pair = F.concat(F.lit("'"), F.col("dst").cast("string"), F.lit("': "), F.col("weight").cast("string"))
    lines = e.groupBy("src").agg(F.array_join(F.collect_list(pair), ", ").alias("x")).select(F.concat(F.col("src").cast("string"), F.lit("\t{"), F.col("x"), F.lit("}")))  # a line a node, as the format has it
    path = _at(e, "lines")
    lines.write.text(path)
    return tables.read_adjacency(e.sparkSession, path)


@query("with b as (select min(cast(o_orderdate as date)) as lo, (max(cast(o_orderdate as date)) - min(cast(o_orderdate as date))) // 4 as len from orders), d as (select least((cast(o_orderdate as date) - lo) // len, 3) as p from orders, b) select f as fold, case f when 3 then 'TEST' else 'VAL' end as kind, count(*) filter (case when f = 3 then p < 3 else p = f - 1 end) as n_train, count(*) filter (p = f) as n_held from d, range(1, 4) as r(f) group by f")
def stored_folds(t):
    o = t("orders").select("o_orderkey", "o_orderdate")
    store = tables.FoldStore(o.sparkSession, _at(o, "folds"))
    store.save("v1", series.temporal_folds(o, "o_orderdate"))
    tables.augment(store, "v1", "_PLUS", lambda train: lambda df: df.withColumn("plus", F.lit(1)), ("plus",))
    out = None
    for i, f in enumerate(tables.FoldStore(o.sparkSession, store.root, suffix="_PLUS").load("v1"), 1):
        row = f.train.agg(F.sum("plus").alias("n_train")).crossJoin(f.held.agg(F.sum("plus").alias("n_held"))).select(F.lit(i).cast("long").alias("fold"), F.lit(f.kind).alias("kind"), "n_train", "n_held")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("select event_id, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')::date as fl_date, coalesce(case when event_id % 5 <> 0 then event_type end, 'x' || user_id) as op_carrier, try_cast(case when event_id % 3 = 0 then null else value end as double) as dep_delay, 0 as extra from events where event_id % 11 <> 0 union all select event_id, date '2015-01-01', coalesce(case when event_id % 5 <> 0 then event_type end, 'x' || user_id), case when event_id % 3 = 0 then null else value end, 0 from events where event_id % 11 = 0")
def standardised_columns(t):
    k, day = F.col("event_id") % 11, F.col("ts")
    text = F.when(k == 0, F.lit("no date")).when(k < 3, F.date_format(day, "yyyy-MM-dd HH:mm")).when(k < 5, F.date_format(day, "MM/dd/yyyy")).when(k < 7, F.date_format(day, "yyyyMMdd")).when(k < 9, F.date_format(day, "yyyy/MM/dd"))
    later = lambda f: F.when((k >= 9) | k.isNull(), f("ts"))
    raw = t("events").select(F.col("event_id").alias("Event_Id"), text.alias("FLIGHT_DATE"), later(F.year).alias("Year"), later(F.month).alias("Month"), later(F.dayofmonth).alias("DAY_OF_MONTH"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("OP_CARRIER"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("OP_UNIQUE_CARRIER"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("DEP_DELAY_NEW"))
    return mapping.standardised(raw, {"Event_Id": "event_id"}, {"extra": 0}).select("event_id", "fl_date", "op_carrier", "dep_delay", "extra")


@query("select unnest(['o_custkey', 'o_orderkey', 'some']) as name")
def filled_columns(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("none"), F.when(F.col("o_totalprice") > 400_000, 1).alias("some"))
    names = tables.filled_columns(tables.without(o, "absent"))
    return tables.from_values(o.sparkSession, sorted(names), "name string")


# ---------------------------------------------------------------- columns, filters, metrics


@query("select o_orderkey, round(sin(month(o_orderdate) * 2 * pi() / 12), 8) as month_sin, round(cos(month(o_orderdate) * 2 * pi() / 12), 8) as month_cos, round(o_totalprice * o_custkey, 2) as distance_x_hourlywindspeed from orders")
def interactions(t):
    o = t("orders").select("o_orderkey", F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("distance"), F.col("o_custkey").alias("hourlywindspeed"))
    out = C.weather_interactions(o)
    return out.select("o_orderkey", F.round("month_sin", 8).alias("month_sin"), F.round("month_cos", 8).alias("month_cos"), F.round("distance_x_hourlywindspeed", 2).alias("distance_x_hourlywindspeed"))


@query("select c_custkey, round(sign(c_acctbal) * ln(abs(c_acctbal) + 1), 8) as y, round(sign(c_acctbal) * (exp(ln(abs(c_acctbal) + 1)) - 1), 4) as back, case when c_acctbal < 15 then 'on_time' when c_acctbal < 60 then 'delayed' else 'severe' end as bucket from customer")
def signed_log_both_ways(t):
    y = C.signed_log(F.col("c_acctbal"))
    return t("customer").select("c_custkey", F.round(y, 8).alias("y"), F.round(C.signed_exp(y), 4).alias("back"), C.delay_bucket(F.col("c_acctbal")).alias("bucket"))


@query("select event_id, sha256(concat_ws('_', user_id, event_type, event_id)) as key, lpad(cast(cast(hour(ts) * 100 + minute(ts) as int) as varchar), 4, '0') as clock, cast(((hour(ts) * 60 + minute(ts)) // 60) * 100 + (hour(ts) * 60 + minute(ts)) % 60 as int) as back from events")
def keys_and_clocks(t):
    m = F.hour("ts") * 60 + F.minute("ts")
    return t("events").select("event_id", C.natural_key(F.col("user_id"), F.col("event_type"), F.col("event_id"), hashed=True).alias("key"), C.clock_text((F.hour("ts") * 100 + F.minute("ts")).cast("double")).alias("clock"), C.minutes_hhmm(m).alias("back"))


@query("select s_suppkey, s_acctbal as lat, cast(s_nationkey as double) as lon from supplier")
def parsed_coordinates(t):
    lat, lon = C.coordinates(F.concat(F.col("s_nationkey").cast("string"), F.lit(" , "), F.col("s_acctbal").cast("string")))
    return t("supplier").select("s_suppkey", lat.alias("lat"), lon.alias("lon"))


@query("select count(*) filter (d >= date '1996-01-01' and d < date '1996-12-31') as half_open, count(*) filter (d >= date '1996-01-01' and d <= date '1996-12-31') as closed, count(*) filter (o_custkey = 7 and o_orderstatus = 'O') as looked_up from (select *, cast(o_orderdate as date) as d from orders)")
def day_ranges_and_lookups(t):
    d = F.col("o_orderdate")
    return t("orders").agg(F.count_if(C.in_days(d, "1996-01-01", "1996-12-31")).alias("half_open"), F.count_if(C.in_days(d, "1996-01-01", "1996-12-31", True)).alias("closed"), F.count_if(C.equals(o_custkey=7, o_orderstatus="O")).alias("looked_up"))


@query(f"with {EDGES} select src, weight from e where src = dst")
def self_loops(t):
    return graph.self_loops(graph.edge_weights(_nation_pairs(t), "s_nationkey", "c_nationkey")).select("src", "weight")


@query(f"""with recursive {HEAVY}, r as (select src as a, dst as b from h union select r.a, h.dst from r join h on r.b = h.src), n as (select src as id from h union select dst from h)
select id, greatest(id, coalesce((select max(x.b) from r x join r y on y.a = x.b and y.b = x.a where x.a = id), id)) as component from n""")
def strong_components(t):
    return graph.strongly_connected(_heavy(t))


@query(f"with {PREDICTED} select round(avg(abs(p - y) / greatest(abs(y), 1) * 100), 6) as bounded, round(avg(case when floor(y / 50) = 0 then 999 else abs(p - floor(y / 50)) / abs(floor(y / 50)) * 100 end), 6) as sentinel from d")
def mape_variants(t):
    y, p = F.col("y"), F.col("p")
    return rounded(_predicted(t).agg(metrics.mape(y, p).alias("bounded"), metrics.mape(F.floor(y / 50).cast("double"), p, None).alias("sentinel")))


@query(f"with {PREDICTED}, b as (select case when y < 90 then 'short' when y <= 100 then 'medium' else 'long' end as bucket, y, p from d) select bucket, count(*) as n, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(avg(abs(p - y)), 6) as mae from b group by 1")
def metrics_by_duration(t):
    return rounded(metrics.by_duration(_predicted(t), "y", "p", "y", 100).select("bucket", "n", "rmse", "mae"))


@query("with a as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 10 <> 0), b as (select o_orderkey as k, case when o_orderkey % 4 = 0 then o_totalprice + 1.0 else o_totalprice end as v from orders where o_orderkey % 10 <> 1), j as (select a.k as ak, b.k as bk, round(a.v - b.v, 6) as d from a full join b on a.k = b.k) select count(*) filter (bk is null) as only_left, count(*) filter (ak is null) as only_right, count(*) filter (ak is not null and bk is not null) as both, count(*) filter (d = 0) as equal, round(min(d), 4) as least, round(max(d), 4) as greatest, round(avg(d), 4) as mean, 0.0 as median from j")
def reconciled_tables(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    a, b = o.filter("k % 10 <> 0"), o.filter("k % 10 <> 1").withColumn("v", F.when(F.col("k") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")))
    out = metrics.reconciled(a, b, ("k",), "v")
    return out.select("only_left", "only_right", "both", "equal", *[F.round(c, 4).alias(c) for c in ("least", "greatest", "mean", "median")])


@query(" union all ".join(f"select '{c}' as \"column\", count({c}) as n, count(*) - count({c}) as n_null, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd, cast(min({c}) as double) as low, cast(max({c}) as double) as high from lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def described(t):
    return rounded(metrics.described(t("lineitem"), ("l_quantity", "l_extendedprice", "l_tax")).drop("q25", "q50", "q75"))


@query("select o_custkey, o_orderpriority, round(avg(o_totalprice), 4) as avg_value, round(stddev_samp(o_totalprice), 4) as sd_value, min(o_totalprice) as min_value, max(o_totalprice) as max_value, count(*) as n from orders group by 1, 2 having count(*) >= 4")
def group_stats(t):
    g = series.group_stats(t("orders"), ("o_custkey", "o_orderpriority"), "o_totalprice", 4)
    return rounded(g, 4)


@query("select count(*) as n from (select distinct user_id, event_type from events)")
def distinct_groups(t):
    e = t("events")
    return tables.from_values(e.sparkSession, [series.group_count(e, ("user_id", "event_type"))], "n long")


@query(f"with {HEAVY}, d as (select id, sum(o) as n from (select src as id, 1 as o from h union all select dst, 0 from h) group by 1) select id, n::bigint as out_degree, round((select avg(n) from d), 6) as mean from d order by n desc, id limit 10")
def degree_report(t):
    e = _heavy(t)
    top, mean, _ = graph.degree_report(e)
    return tables.from_values(e.sparkSession, [(r["id"], r["out_degree"], round(mean, 6)) for r in top], "id int, out_degree long, mean double")


# ---------------------------------------------------------------- statistics and models

_DEV = f"{DAILY}, d as (select *, avg_value - avg(avg_value) over () as v from s), p as (select v, lag(v, 1) over w as v1, lag(v, 2) over w as v2 from d window w as (order by date)), a as (select sum(v * v1) / sum(v * v) as a1, sum(v * v2) / sum(v * v) as a2, count(*) as n from p)"


@query(f"with {_DEV} select 1 as lag, round(a1, 6) as pacf, round(n * (n + 2) * a1 * a1 / (n - 1), 4) as ljung_box from a union all select 2, round((a2 - a1 * a1) / (1 - a1 * a1), 6), round(n * (n + 2) * (a1 * a1 / (n - 1) + a2 * a2 / (n - 2)), 4) from a")
def partial_autocorrelation(t):
    s = series.daily(t("orders"), F.to_date("o_orderdate"), "o_totalprice")
    acf = np.array([r["acf"] for r in statistics.autocorrelation(s, "date", "avg_value", 2).orderBy("lag").collect()])  # two rows
    rows = zip((1, 2), statistics.partial_autocorrelation(acf).round(6).tolist(), statistics.ljung_box(acf, s.count()).round(4).tolist(), strict=True)
    return tables.from_values(s.sparkSession, rows, "lag int, pacf double, ljung_box double")


@query(f"""with {DAILY}, e as (select date, avg_value - avg(avg_value) over () as v from s), p as (select v, lag(v, 1) over w as v1, lag(v, 2) over w as v2, sum(v) over w as c, count(*) over () as n from e window w as (order by date))
select round(sum(c * c) / (max(n) * max(n)) / ((sum(v * v) + 2 * (2.0 / 3 * sum(v * v1) + 1.0 / 3 * sum(v * v2))) / max(n)), 6) as statistic from p""")
def stationarity(t):
    s = series.daily(t("orders"), F.to_date("o_orderdate"), "o_totalprice")
    x = statistics.collected_series(s, "date", "avg_value")
    return tables.from_values(s.sparkSession, [round(statistics.kpss(x, trend=False, lags=2), 6)], "statistic double")


@query(f"""with {DAILY}, b as (select regr_slope(avg_value, n) as a, regr_intercept(avg_value, n) as c from s), e as (select date, avg_value - a * n - c as v from s, b), p as (select lag(v) over (order by date) as x, v - lag(v) over (order by date) as y from e),
 g as (select sum(x * y) / sum(x * x) as k, sum(x * x) as xx, count(*) as n from p where x is not null), r as (select sum((y - k * x) * (y - k * x)) as ss from p, g where x is not null) select round(a, 6) as slope, round(k / sqrt(ss / (n - 1) / xx), 6) as statistic from b, g, r""")
def cointegration(t):
    s = series.daily(t("orders"), F.to_date("o_orderdate"), "o_totalprice")
    y, x = (statistics.collected_series(s, "date", c) for c in ("avg_value", "n"))
    slope, stat = statistics.cointegration(y, x)
    return tables.from_values(s.sparkSession, [(round(slope, 6), round(stat, 6))], "slope double, statistic double")


@query("select l_orderkey, l_linenumber, round((greatest(l_quantity / 10, 0) - 2 * greatest(l_discount * 10 - l_quantity / 10, 0) + 0.5) * 3 + 7, 6) as prediction from lineitem")
def network_inference(t):
    net = network.Perceptron(2, (2,))
    net.w = [np.array([[1.0, -1.0], [0.0, 1.0]]), np.array([[1.0], [-2.0]])]
    net.b = [np.zeros(2), np.array([0.5])]
    net.scale = (np.zeros(2), np.array([10.0, 0.1]), 7.0, 3.0)
    return network.predicted(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), net, ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))


@query("select column_name as name, a, b from (values ('o_orderkey', 'bigint', 'string'), ('o_totalprice', 'double', 'double')) v(column_name, a, b)")
def compared_types(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    got = metrics.compare(o, tables.as_strings(o, "o_orderkey", "absent"))
    kinds = dict(o.dtypes)
    rows = [(c, *got["types"].get(c, (kinds[c], kinds[c]))) for c in o.columns]
    return tables.from_values(o.sparkSession, rows, "name string, a string, b string")
