"""Balance of sites and times. Roles: an event is a recording, its site user_id % 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import relational as R
from .base import Tables, query

_E = "(select *, user_id % 4 as site, cast(ts as date) as day, hour(ts) as h from events)"


def recordings(t: Tables):
    return t.events.select("*", (F.col("user_id") % 4).alias("site"), F.to_date("ts").alias("day"), F.hour("ts").alias("h"))


@query("site_balance", f"select site, min(n) as least, max(n) as most, median(n)::double as middle, count(*) as days, sum(n)::bigint as n from (select site, day, count(*) as n from {_E} group by 1, 2) group by 1")
def site_balance(t: Tables):
    days = recordings(t).groupBy("site", "day").agg(F.count("*").alias("n"))
    return days.groupBy("site").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.median("n").alias("middle"), F.count("*").alias("days"), F.sum("n").alias("n"))


@query("year_site_summary", "select extract(year from o_orderdate)::bigint as year, o_custkey % 5 as site, count(*) as n, count(*) filter (o_orderstatus = 'F') as finished, round(sum(o_totalprice), 2) as total, count(distinct o_custkey) as customers, min(o_totalprice) as least, max(o_totalprice) as most from orders group by 1, 2")
def year_site_summary(t: Tables):
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year"), (F.col("o_custkey") % 5).alias("site")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("balance_cv", f"select site, round(stddev_pop(n) / avg(n), 9) as cv, round(max(n) / min(n), 9) as ratio from (select site, day, count(*) as n from {_E} group by 1, 2) group by 1")
def balance_cv(t: Tables):
    days = recordings(t).groupBy("site", "day").agg(F.count("*").alias("n"))
    return days.groupBy("site").agg(F.round(F.stddev_pop("n") / F.avg("n"), 9).alias("cv"), F.round(F.max("n") / F.min("n"), 9).alias("ratio"))


@query("period_balance", f"select site, case when h between 5 and 8 then 'dawn' when h between 9 and 16 then 'day' when h between 17 and 19 then 'dusk' else 'night' end as period, count(*) as n from {_E} group by 1, 2")
def period_balance(t: Tables):
    return recordings(t).groupBy("site", X.period(F.col("h")).alias("period")).agg(F.count("*").alias("n"))


@query("week_hour_cells", f"select printf('%d-W%02d', isoyear(ts), weekofyear(ts)) as week, h::bigint as hour, count(*) as n, count(distinct site) as sites from {_E} group by 1, 2")
def week_hour_cells(t: Tables):
    return recordings(t).groupBy(X.iso_week(F.col("ts")).alias("week"), F.col("h").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"))


_CELLS = f"select day, h, min(n) as least, sum(n)::bigint as total from (select day, h, site, count(*) as n from {_E} group by 1, 2, 3) group by 1, 2 having count(*) = (select count(distinct user_id % 4) from events)"


def _common(t: Tables):
    cells = recordings(t).groupBy("day", "h", "site").agg(F.count("*").alias("n")).groupBy("day", "h").agg(F.count("*").alias("s"), F.min("n").alias("least"), F.sum("n").alias("total"))
    sites = recordings(t).agg(F.count_distinct("site").alias("sites"))
    return cells.crossJoin(sites).where("s = sites").select("day", "h", "least", "total")


@query("common_cells", f"select cast(day as varchar) as day, h::bigint as hour, least, total from ({_CELLS})")
def common_cells(t: Tables):
    return _common(t).select(F.col("day").cast("string").alias("day"), F.col("h").cast("long").alias("hour"), "least", "total")


@query("matched_capacity", f"select count(*) as cells, coalesce(sum(least * (select count(distinct user_id % 4) from events)), 0)::bigint as capacity from ({_CELLS})")
def matched_capacity(t: Tables):
    sites = recordings(t).agg(F.count_distinct("site").alias("sites"))
    return _common(t).crossJoin(sites).agg(F.count("*").alias("cells"), F.coalesce(F.sum(F.col("least") * F.col("sites")), F.lit(0)).cast("long").alias("capacity"))


@query("common_dates", f"select cast(day as varchar) as day, count(distinct site) as sites, count(distinct site) = (select count(distinct user_id % 4) from events) as everywhere from {_E} group by 1")
def common_dates(t: Tables):
    sites = recordings(t).agg(F.count_distinct("site").alias("all"))
    days = recordings(t).groupBy(F.col("day").cast("string").alias("day")).agg(F.count_distinct("site").alias("sites"))
    return days.crossJoin(sites).select("day", "sites", (F.col("sites") == F.col("all")).alias("everywhere"))


@query("pairwise_jaccard", f"""with i as (select distinct site, cast(day as varchar) || ':' || h as item from {_E}), n as (select site, count(*) as n from i group by 1)
select a.site as a, b.site as b, count(*) as both, (any_value(na.n) + any_value(nb.n) - count(*))::bigint as either, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 9) as jaccard from i a join i b on a.item = b.item and a.site < b.site join n na on na.site = a.site join n nb on nb.site = b.site group by 1, 2""")
def pairwise_jaccard(t: Tables):
    items = recordings(t).select("site", F.concat_ws(":", F.col("day").cast("string"), "h").alias("item"))
    return R.jaccard_by_pairs(items, "site", "item").withColumn("jaccard", F.round("jaccard", 9))
