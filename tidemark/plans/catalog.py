"""The queries of the library's own operators over the driver's tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import graph, joins, lineage, metrics, models, series, statistics
from tidemark.plans.registry import query
from tidemark.plans.registry import rounded as _rounded

def _events(t) -> DataFrame:
    return lineage.previous_event(t("events"), "user_id", ("ts", "event_id"), ("event_type", "value", "ts"))


PREV = """e as (select *, row_number() over w as lineage_rank, lag(event_type) over w as pt, lag(value) over w as pv, lag(ts) over w as pts
 from events window w as (partition by user_id order by ts, event_id))"""


@query(f"with {PREV} select event_id, lineage_rank, pt as prev_event_type, pv as prev_value, lineage_rank > 1 and coalesce(pt <> event_type, false) as is_jump from e")
def lineage_prev_event(t):
    return _events(t).select("event_id", "lineage_rank", "prev_event_type", "prev_value", lineage.jump(F.col("lineage_rank"), F.col("prev_event_type"), F.col("event_type")).alias("is_jump"))


@query(f"with {PREV} select lineage_rank > 1 and coalesce(pt <> event_type, false) as is_jump, count(*) as n, round(avg(value), 6) as avg_value, round(avg(pv), 6) as avg_prev from e group by 1")
def lineage_jump_stats(t):
    e = _events(t).withColumn("is_jump", lineage.jump(F.col("lineage_rank"), F.col("prev_event_type"), F.col("event_type")))
    return e.groupBy("is_jump").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.avg("prev_value"), 6).alias("avg_prev"))


@query("select event_id, round(sum(value) over w, 9) as cum_sum, count(value) over w as cum_count, round(avg(value) over w, 9) as cum_avg, max(value) over w as cum_max from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 2 preceding)")
def lineage_cumulative(t):
    c = lineage.cumulative(t("events"), "user_id", ("ts", "event_id"), "value")
    return c.select("event_id", F.round("cum_sum", 9).alias("cum_sum"), "cum_count", F.round("cum_avg", 9).alias("cum_avg"), "cum_max")


@query("select src, dst, count(*) as n from (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) where dst is not null group by all")
def sequence_edges(t):
    return lineage.next_edges(t("events"), ("user_id",), ("ts", "event_id"), "event_type").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _shipped(t) -> DataFrame:
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("cutoff", F.col("o_orderdate") + F.expr("interval 60 days"))


@query("select l_orderkey, l_linenumber, l_shipdate > o_orderdate + interval 60 day as leak_ship, concat_ws(',', case when l_shipdate > o_orderdate + interval 60 day then 'ship' end, case when o_orderdate > o_orderdate + interval 60 day then 'order' end) as leaking from lineitem join orders on l_orderkey = o_orderkey")
def leakage_flags(t):
    flags, names = lineage.leaks(F.col("cutoff"), {"ship": F.col("l_shipdate"), "order": F.col("o_orderdate")})
    return _shipped(t).select("l_orderkey", "l_linenumber", flags["ship"].alias("leak_ship"), F.array_join(names, ",").alias("leaking"))


@query("select l_orderkey, l_linenumber, round(case when l_shipdate <= o_orderdate + interval 60 day then l_quantity when o_orderdate < o_orderdate + interval 60 day then 86400.0 else 0 end, 6) as safe_delay from lineitem join orders on l_orderkey = o_orderkey")
def safe_delay(t):
    s = lineage.safe_delay(F.col("l_quantity"), F.col("l_shipdate") > F.col("cutoff"), F.col("o_orderdate"), F.col("cutoff"))
    return _shipped(t).select("l_orderkey", "l_linenumber", F.round(s, 6).alias("safe_delay"))


@query("select a.event_id, round(avg(b.value), 6) as mean_24h from events a left join events b on b.user_id = a.user_id and b.ts <= a.ts - interval 2 hour and b.ts >= a.ts - interval 26 hour and b.event_id <> a.event_id group by a.event_id")
def rolling_cutoff_mean(t):
    r = lineage.rolling_mean(t("events"), "user_id", "ts", F.col("ts") - F.expr("interval 2 hours"), "value", 86400, "m")
    return r.select("event_id", F.round("m", 6).alias("mean_24h"))


@query("""with p as (select *, floor(epoch(ts) / 86400) * 86400 - 86400 as since from events where event_type = 'purchase'), e as (select * from events where event_type = 'error')
select p.event_id, case when epoch(e.ts) >= since then e.event_id end as matched_event_id, case when epoch(e.ts) >= since then e.value end as matched_value
from p asof left join e on p.user_id = e.user_id and p.ts >= e.ts""")
def asof_bucketed(t):
    e = t("events")
    out = joins.asof_join(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), "user_id", "ts", "ts", 86400, ("event_id", "value"), ("event_id",), ("event_id",))
    return out.select("event_id", "matched_event_id", "matched_value")


@query("select c_custkey, s_suppkey, round(d, 6) as distance from (select c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) as d, row_number() over (partition by c_custkey order by abs(c_acctbal - s_acctbal), s_suppkey) as rn from customer join supplier on c_nationkey = s_nationkey where abs(c_acctbal - s_acctbal) <= 500) where rn = 1")
def nearest_by_range(t):
    n = joins.nearest_in_band(t("customer"), t("supplier"), "c_nationkey", "s_nationkey", "c_acctbal", "s_acctbal", 500.0, "c_custkey", "s_suppkey")
    return n.select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@query("select c_custkey, s_suppkey from (select c_custkey, s_suppkey, row_number() over (partition by c_custkey order by s_suppkey) as rn from customer join supplier on c_custkey = s_suppkey or c_nationkey = s_nationkey) where rn = 1")
def or_join_dedup(t):
    return joins.either_key_least(t("customer"), t("supplier"), (("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")), "c_custkey", "s_suppkey")


@query("select cn.n_name as customer_nation, sn.n_name as supplier_nation, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey left join nation cn on cn.n_nationkey = c_nationkey left join nation sn on sn.n_nationkey = s_nationkey group by all")
def dimension_lookup_twice(t):
    e = _nation_pairs(t)
    e = joins.lookup(e, t("nation"), {"c_nationkey": "n_nationkey"}, {"n_name": "customer_nation"})
    e = joins.lookup(e, t("nation"), {"s_nationkey": "n_nationkey"}, {"n_name": "supplier_nation"})
    return e.groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("n"))


def _nation_pairs(t) -> DataFrame:
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    e = li.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return e.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 12)")
def semi_min_support(t):
    return joins.with_support(t("orders").select("o_orderkey", "o_custkey"), ("o_custkey",), 12)


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def anti_dangling(t):
    return t("customer").select("c_custkey").join(t("orders").filter("o_totalprice > 250000").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


DAILY = "s as (select cast(o_orderdate as date) as date, avg(o_totalprice) as avg_value, count(*) as n from orders group by 1)"
DECOMPOSED = f"""with {DAILY}, d as (select *, avg(avg_value) over (order by date rows between 30 preceding and current row) as trend,
 avg(avg_value) over (partition by dayofweek(date)) - avg(avg_value) over () as weekly, avg(avg_value) over (partition by month(date)) - avg(avg_value) over () as yearly from s)"""


@query(f"with {DAILY} select date, round(avg_value, 8) as avg_value, n from s")
def daily_series(t):
    s = series.daily(t("orders"), F.to_date("o_orderdate"), "o_totalprice")
    return s.select("date", F.round("avg_value", 8).alias("avg_value"), "n")


@query(f"{DECOMPOSED} select date, round(trend, 4) as trend, round(weekly, 4) as weekly, round(yearly, 4) as yearly, round(trend + weekly + yearly, 4) as forecast from d")
def seasonal_forecast(t):
    d = series.decompose(series.daily(t("orders"), F.to_date("o_orderdate"), "o_totalprice"))
    return d.select("date", *[F.round(c, 4).alias(c) for c in ("trend", "weekly", "yearly", "forecast")])


@query(f"""with {DAILY}, d as (select *, avg_value - avg(avg_value) over () as v from s), p as (select v, lag(v, 1) over w as v1, lag(v, 2) over w as v2, lag(v, 3) over w as v3 from d window w as (order by date)),
 a as (select sum(v * v1) / sum(v * v) as a1, sum(v * v2) / sum(v * v) as a2, sum(v * v3) / sum(v * v) as a3 from p)
select 1 as lag, round(a1, 6) as acf from a union all select 2, round(a2, 6) from a union all select 3, round(a3, 6) from a""")
def daily_autocorrelation(t):
    a = statistics.autocorrelation(series.daily(t("orders"), F.to_date("o_orderdate"), "o_totalprice"), "date", "avg_value", 3)
    return a.select("lag", F.round("acf", 6).alias("acf"))


@query(f"""with {DAILY}, p as (select lag(avg_value) over (order by date) as x, avg_value - lag(avg_value) over (order by date) as y from s),
 a as (select count(*) as n, covar_pop(x, y) as xy, var_pop(x) as xx, var_pop(y) as yy from p where x is not null)
select n, round(xy / xx, 6) as slope, round(xy / xx / sqrt((yy - xy / xx * xy) / ((n - 2) * xx)), 4) as statistic from a""")
def daily_unit_root(t):
    u = statistics.unit_root(series.daily(t("orders"), F.to_date("o_orderdate"), "o_totalprice"), "date", "avg_value")
    return u.select("n", F.round("slope", 6).alias("slope"), F.round("statistic", 4).alias("statistic"))


AUDITED = ("l_quantity", "l_discount", "l_tax")


@query(" union all ".join(f"select '{c}' as feature, count({c}) as n, count(*) - count({c}) as n_null, round(avg({c}), 6) as mean, round(stddev({c}), 6) as sd, cast(min({c}) as double) as low, cast(max({c}) as double) as high, round(corr({c}, l_extendedprice), 6) as corr from lineitem" for c in AUDITED))
def feature_audit(t):
    a = statistics.feature_audit(t("lineitem"), AUDITED, "l_extendedprice")
    return a.select("feature", "n", "n_null", *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "low", "high", F.round("corr", 6).alias("corr"))


@query("""select distinct cast(o_orderdate as date) as date, cast((month(o_orderdate) = 5 and dayofweek(o_orderdate) = 1 and day(o_orderdate) >= 25)
 or (month(o_orderdate), day(o_orderdate)) in ((1, 1), (7, 4), (11, 11), (12, 25))
 or (month(o_orderdate), dayofweek(o_orderdate), (day(o_orderdate) - 1) // 7 + 1) in ((1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) as int) as is_holiday from orders""")
def holiday_flag(t):
    d = t("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select("date", C.us_holiday(F.col("date")).alias("is_holiday"))


@query("""with j as (select l_orderkey, l_linenumber, l_suppkey, month(l_shipdate) as m, s_nationkey, l_quantity from lineitem join supplier on l_suppkey = s_suppkey),
a as (select l_suppkey, m, avg(l_quantity) as v from j group by 1, 2 having count(l_quantity) >= 60), b as (select s_nationkey, avg(l_quantity) as v from j group by 1 having count(l_quantity) >= 60)
select l_orderkey, l_linenumber, round(coalesce(a.v, b.v, 0), 6) as expected from j left join a using (l_suppkey, m) left join b using (s_nationkey)""")
def conditional_means_fallback(t):
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("m", F.month("l_shipdate"))
    e = series.expected_value(j, j, (("l_suppkey", "m"), ("s_nationkey",)), "l_quantity", "expected", 60)
    return e.select("l_orderkey", "l_linenumber", F.round("expected", 6).alias("expected"))


EDGES = "e as (select s_nationkey as src, c_nationkey as dst, count(*) as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)"


@query(f"with {EDGES} select * from e")
def edge_weights(t):
    return graph.edge_weights(_nation_pairs(t), "s_nationkey", "c_nationkey")


def _heavy(t) -> DataFrame:
    e = graph.edge_weights(_nation_pairs(t), "s_nationkey", "c_nationkey")
    return e.join(F.broadcast(e.agg(F.avg("weight").alias("mean"))), F.col("weight") > F.col("mean")).drop("mean")  # one row


HEAVY = f"{EDGES}, h as (select * from e where weight > (select avg(weight) from e))"


@query(f"with {HEAVY} select id, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select src as id, 1 as o, 0 as i from h union all select dst, 0, 1 from h) group by id")
def degrees(t):
    return graph.degrees(_heavy(t))


def _rank_sql(weight: str) -> str:
    rounds = ", ".join(
        f"r{k + 1} as (select n.id, 0.15 / c.n + 0.85 * (coalesce(g.given, 0) + l.lost / c.n) as rank from n cross join (select count(*) as n from n) c cross join (select coalesce(sum(rank), 0) as lost from r{k} where id not in (select src from h)) l"
        f" left join (select dst, sum(rank * {weight} / total) as given from h join r{k} on src = r{k}.id join (select src, sum({weight}) as total from h group by 1) using (src) group by dst) g on g.dst = n.id)"
        for k in range(10)
    )
    return f"with {HEAVY}, n as (select src as id from h union select dst from h), r0 as (select id, 1.0 / (select count(*) from n) as rank from n), {rounds} select id, round(rank, 8) as rank from r10"


@query(_rank_sql("weight"))
def pagerank_weighted(t):
    return graph.pagerank(_heavy(t)).select("id", F.round("rank", 8).alias("rank"))


@query(_rank_sql("1"))
def pagerank_unweighted(t):
    return graph.pagerank(_heavy(t), weighted=False).select("id", F.round("rank", 8).alias("rank"))


# orders hang on customers, suppliers and the customers of one segment on nations: hubs, stars and chains over whole tables
COMPONENT_EDGES = "u as (select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer where c_mktsegment = 'BUILDING' union all select 'o' || o_orderkey, 'c' || o_custkey from orders union all select 's' || s_suppkey, 'n' || s_nationkey from supplier)"
LABELS = f"with recursive {COMPONENT_EDGES}, v as (select src, dst from u union select dst, src from u), r as (select src as id, src as root from v union select v.dst, r.root from r join v on v.src = r.id), l as (select id, min(root) as component from r group by id)"


def _labels(t) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("customer").filter("c_mktsegment = 'BUILDING'").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    e = e.union(t("orders").select(name("o", "o_orderkey"), name("c", "o_custkey"))).union(t("supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey")))
    return graph.components(e)


@query(f"{LABELS} select id, component from l")
def graph_components(t):
    return _labels(t)


@query(f"{LABELS} select component, count(*) as n from l group by component")
def component_sizes(t):
    return graph.component_sizes(_labels(t))


@query("select k as map_key, count(*) as n from events, unnest(json_keys(props)) as u(k) group by k")
def adjacency_explode(t):
    keys = t("events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("map_key"))
    return keys.groupBy("map_key").agg(F.count(F.lit(1)).alias("n"))


FOLDS = "b as (select min(cast(o_orderdate as date)) as lo, max(cast(o_orderdate as date)) as hi, (max(cast(o_orderdate as date)) - min(cast(o_orderdate as date))) // 4 as len from orders)"


@query(f"with {FOLDS}, d as (select o_totalprice, least((cast(o_orderdate as date) - lo) // len, 3) as p from orders, b) select f as fold, count(*) filter (case when f = 3 then p < 3 else p = f - 1 end) as n_train, count(*) filter (p = f) as n_held from d, range(1, 4) as r(f) group by f")
def fold_counts(t):
    return series.fold_sizes(t("orders"), "o_orderdate")


def _predicted(t) -> DataFrame:
    li = t("lineitem")
    means = li.groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg((F.avg("l_extendedprice") / 1000).alias("p"))
    return li.join(means, ["l_linestatus", "l_returnflag", "l_linenumber"]).select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("p") + F.col("l_quantity") - 25).alias("p"))


PREDICTED = "d as (select l_returnflag, l_extendedprice / 1000 as y, avg(l_extendedprice) over (partition by l_linestatus, l_returnflag, l_linenumber) / 1000 + l_quantity - 25 as p from lineitem)"


def _metric_sql(by: str) -> str:
    def cls(t, name):
        c = lambda a, b: f"count(*) filter (({a} y >= {t}) and ({b} p >= {t}))"
        tp, fp, fn, tn = c("", ""), c("not", ""), c("", "not"), c("not", "not")
        prec, rec = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
        return f"round(({tp} + {tn}) / count(*), 6) as {name}_accuracy, round({prec}, 6) as {name}_precision, round({rec}, 6) as {name}_recall, round(coalesce(2 * {prec} * {rec} / nullif({prec} + {rec}, 0), 0), 6) as {name}_f1"

    return f"with {PREDICTED} select {by} count(*) as n, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(avg(abs(p - y)), 6) as mae, round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) as r2, round(avg(abs(p - y) / greatest(abs(y), 1) * 100), 6) as mape, {cls(15, 'otpa')}, {cls(60, 'sddr')} from d" + (" group by l_returnflag" if by else "")


@query(_metric_sql(""))
def regression_and_confusion_metrics(t):
    return _rounded(metrics.evaluate(_predicted(t), "y", "p"))


@query(_metric_sql("l_returnflag,"))
def stratified_metrics(t):
    return _rounded(metrics.evaluate(_predicted(t), "y", "p", ("l_returnflag",)))


@query(f"with {PREDICTED} select cast(least(floor(y / 15), 12) as bigint) as bin, round(avg(y), 6) as actual, round(avg(p), 6) as predicted, count(*) as n from d group by 1")
def binned_means(t):
    return _rounded(metrics.binned(_predicted(t), "y", "p", 15, 180))


@query("select column_name as \"column\", n_null, n_zero, n_rows from (select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as column_name, unnest([count(*) - count(o_orderkey), count(*) - count(o_custkey), count(*) - count(o_orderstatus), count(*) - count(o_totalprice), count(*) - count(o_orderdate), count(*) - count(o_orderpriority)]) as n_null, unnest([count(*) filter (o_orderkey = 0), count(*) filter (o_custkey = 0), 0, count(*) filter (o_totalprice = 0), 0, 0]) as n_zero, count(*) as n_rows from orders)")
def null_profile(t):
    return metrics.null_profile(t("orders"))


@query("select count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as sd, min(o_totalprice) as lo, max(o_totalprice) as hi, round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(quantile_cont(o_totalprice, 0.5), 4) as q50, round(quantile_cont(o_totalprice, 0.75), 4) as q75 from orders")
def numeric_summary(t):
    p = F.col("o_totalprice")
    return t("orders").agg(F.count(p).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("sd"), F.min(p).alias("lo"), F.max(p).alias("hi"), *[F.round(F.percentile(p, q), 4).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


@query("select round(corr(l_quantity, l_extendedprice), 8) as r from lineitem")
def pearson(t):
    return t("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


@query("select p_partkey, try_cast(regexp_replace(p_brand, '[^0-9+\\-.]', '', 'g') as double) as brand_no, try_cast(trim(p_type) as double) as type_no, try_cast(cast(p_size as varchar) as double) as size from part")
def null_safe_cast(t):
    return t("part").select("p_partkey", C.stripped_double(F.col("p_brand")).alias("brand_no"), C.safe_double(F.col("p_type")).alias("type_no"), C.safe_double(F.col("p_size")).alias("size"))


@query("select case when hour(ts) between 0 and 5 then 'night' when hour(ts) between 6 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' else 'evening' end as bucket, event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, count(*) as n from events group by 1, 2")
def hour_bucket_stats(t):
    return t("events").groupBy(C.hour_bucket(F.hour("ts")).alias("bucket"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


@query("select distinct user_id, event_type from events")
def dedup_full_row(t):
    return t("events").select("user_id", "event_type").dropDuplicates()


@query("select c_custkey as id from customer except select o_custkey from orders where o_totalprice > 250000")
def set_subtract(t):
    return t("customer").select(F.col("c_custkey").alias("id")).subtract(t("orders").filter("o_totalprice > 250000").select("o_custkey"))


@query("select user_id, floor(epoch(ts))::bigint // 1800 + s as bucket, count(*) as n from events, (values (0), (1)) v(s) group by 1, 2")
def union_shifted(t):
    b = t("events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).alias("bucket"))
    return b.unionByName(b.withColumn("bucket", F.col("bucket") + 1)).groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, round(ln(abs(o_totalprice) + 1), 8) as y_log, round(exp(ln(abs(o_totalprice) + 1)) - 1, 4) as y_back from orders")
def log_target_roundtrip(t):
    y = C.signed_log(F.col("o_totalprice"))
    return t("orders").select("o_orderkey", F.round(y, 8).alias("y_log"), F.round(C.signed_exp(y), 4).alias("y_back"))


@query("select l_orderkey, l_linenumber, h // 100 * 60 + h % 100 as minutes, case when e < s then e - s + 1440 else e - s end as elapsed from (select *, (l_orderkey % 24) * 100 + l_linenumber as h, (l_orderkey % 24) * 60 + l_linenumber as s, (l_suppkey % 24) * 60 + 30 as e from lineitem)")
def clock_arithmetic(t):
    a, b = (F.col("l_orderkey") % 24) * 100 + F.col("l_linenumber"), (F.col("l_suppkey") % 24) * 100 + 30
    return t("lineitem").select("l_orderkey", "l_linenumber", C.hhmm_minutes(a).alias("minutes"), C.elapsed_minutes(a, b).alias("elapsed"))


@query("select c_custkey, round(6371.0 * acos(greatest(-1, least(1, cos(radians(c_acctbal / 120)) * cos(radians(10)) * cos(radians(20) - radians(c_nationkey * 10)) + sin(radians(c_acctbal / 120)) * sin(radians(10))))), 3) as km from customer")
def great_circle(t):
    return t("customer").select("c_custkey", F.round(C.great_circle_km(F.col("c_acctbal") / 120, F.col("c_nationkey") * 10, F.lit(10), F.lit(20)), 3).alias("km"))


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20")
def top_k(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("select count(*) as n from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'")
def date_range_filter(t):
    return t("orders").filter("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1998-01-01'").agg(F.count(F.lit(1)).alias("n"))


FOLD_LINES = f"""{FOLDS}, d as (select o_totalprice / 1000 as y, cast(o_custkey as double) as x, least((cast(o_orderdate as date) - lo) // len, 3) as p from orders, b),
 l as (select f, regr_slope(y, x) as a, regr_intercept(y, x) as c from d, range(1, 4) as r(f) where case when f = 3 then p < 3 else p = f - 1 end group by f),
 e as (select f, y, a * x + c as q from d join l on d.p = l.f)"""


@query(f"with {FOLD_LINES} select cast(f as int) as fold, case f when 3 then 'TEST' else 'VAL' end as kind, count(*) as n, round(sqrt(avg((q - y) * (q - y))), 4) as rmse, round(avg(abs(q - y)), 4) as mae, round(avg(abs(q - y) / greatest(abs(y), 1) * 100), 4) as mape from e group by f")
def lr_cross_validation(t):
    df = t("orders").select((F.col("o_totalprice") / 1000).alias("y"), F.col("o_custkey").cast("double").alias("x"), "o_orderdate")
    cv = models.CrossValidation(lambda: models.pipeline("lr", "y", ["x"]), series.temporal_folds(df, "o_orderdate"), "y").fit()
    return cv.results().select("fold", "kind", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "mape")])


@query(f"with {FOLD_LINES}, m as (select f, sqrt(avg((q - y) * (q - y))) as rmse, avg(abs(q - y)) as mae from e group by f) select metric, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd, count(*) as folds from (select case f when 3 then 'TEST' else 'VAL' end as k, unnest(['rmse', 'mae']) as metric, unnest([rmse, mae]) as v from m) group by metric")
def fold_summary(t):
    df = t("orders").select((F.col("o_totalprice") / 1000).alias("y"), F.col("o_custkey").cast("double").alias("x"), "o_orderdate")
    cv = models.CrossValidation(lambda: models.pipeline("lr", "y", ["x"]), series.temporal_folds(df, "o_orderdate"), "y")
    s = metrics.fold_summary(cv.results().select("fold", "n", "rmse", "mae"), by=())
    return s.select("metric", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "folds")


@query("""with h as (select l_extendedprice / 1000 as y, l_quantity as a, l_discount as b, cast(l_shipdate as date) < date '1998-01-01' as train from lineitem),
 m as (select regr_slope(y, a) as sa, regr_intercept(y, a) as ia, regr_slope(y, b) as sb, regr_intercept(y, b) as ib from h where train)
 select count(*) as n, round(sqrt(avg((q - y) * (q - y))), 4) as rmse, round(avg(abs(q - y)), 4) as mae from (select y, (sa * a + ia + sb * b + ib) / 2 as q from h, m where not train)""")
def voting_ensemble(t):
    df = t("lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_quantity", "l_discount", F.col("l_shipdate").cast("date").alias("day"))
    made = models.VotingEnsemble(lambda: models.pipeline("lr", "y", ["l_quantity"]), lambda: models.pipeline("lr", "y", ["l_discount"])).fit(df.filter("day < date'1998-01-01'"))
    return metrics.evaluate(made.transform(df.filter("day >= date'1998-01-01'")), "y", "prediction").select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query()
def forest_ensemble(t):
    df = t("lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    train, held = df.filter("l_orderkey % 5 <> 0"), df.filter("l_orderkey % 5 = 0")  # a split into learning and judging, not a cut of the table
    made = [models.pipeline("rf", "y", cols, numTrees=5, maxDepth=4, seed=1).fit(train) for cols in (["l_quantity", "l_discount"], ["l_quantity", "l_tax"])]
    return metrics.evaluate(models.ensemble(held, made), "y", "prediction")
