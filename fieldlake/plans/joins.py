"""Joins, set operations and merges with their checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .base import Tables, query


def _on(a: str, b: str):
    return F.col(a) == F.col(b)


@query("join_one_to_one", "select d.doc_id, n_chars, quality from documents d join labels l using (doc_id) where (select count(*) - count(distinct doc_id) from labels) = 0")
def join_one_to_one(t: Tables):
    """An inner join, empty if a side has a key twice."""
    repeated = t.labels.groupBy("doc_id").count().where("count > 1").unionByName(t.documents.groupBy("doc_id").count().where("count > 1")).agg(F.count("*").alias("bad"))
    return t.documents.join(t.labels, "doc_id").crossJoin(repeated).where("bad = 0").select("doc_id", "n_chars", "quality")


@query("join_left_complete", "select count(*) as n, count(*) filter (c_custkey is null) as unmatched, count(*) filter (o_custkey <> c_custkey) as differing from orders left join customer on o_custkey = c_custkey")
def join_left_complete(t: Tables):
    return t.orders.join(t.customer, _on("o_custkey", "c_custkey"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("unmatched"), F.count_if(F.col("o_custkey") != F.col("c_custkey")).alias("differing"))


@query("feature_assembly", "select c_custkey, coalesce(n, 0) as n, coalesce(best, -1) as best from customer left join (select o_custkey, count(*) as n, max(o_totalprice) as best from orders group by 1) on c_custkey = o_custkey")
def feature_assembly(t: Tables):
    own = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    return t.customer.join(own, _on("c_custkey", "o_custkey"), "left").select("c_custkey", "n", "best").fillna({"n": 0, "best": -1.0})


@query("membership_flags", "select doc_id, doc_id in (select doc_id from labels) as labelled, doc_id in (select doc_id from labels where toxic = 1) as toxic from documents")
def membership_flags(t: Tables):
    labelled, toxic = t.labels.select("doc_id", F.lit(True).alias("l")).distinct(), t.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("x")).distinct()
    return t.documents.join(labelled, "doc_id", "left").join(toxic, "doc_id", "left").select("doc_id", F.col("l").isNotNull().alias("labelled"), F.col("x").isNotNull().alias("toxic"))


@query("orphans", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def orphans(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query("resume_antijoin", "select event_id, user_id from events where event_id not in (select event_id from events where event_id % 3 = 0)")
def resume_antijoin(t: Tables):
    done = t.events.where("event_id % 3 = 0").select("event_id")
    return t.events.join(done, "event_id", "left_anti").select("event_id", "user_id")


@query("inventory_diff", "select coalesce(a.k, b.k) as k, case when a.k is null then 'new' when b.k is null then 'missing' when a.v is distinct from b.v then 'changed' else 'same' end as status from (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 5 <> 0) a full join (select o_orderkey as k, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 6 <> 0) b on a.k = b.k")
def inventory_diff(t: Tables):
    k, v = F.col("o_orderkey").alias("k"), F.col("o_totalprice")
    old, new = t.orders.where("o_orderkey % 5 <> 0").select(k, v.alias("v")), t.orders.where("o_orderkey % 6 <> 0").select(k, F.when(F.col("o_orderkey") % 7 == 0, v + 1).otherwise(v).alias("v"))
    return R.full_diff(old, new, "k", "v")


@query("version_diff", "select o_orderkey, array_to_string(list_filter([case when o_totalprice is distinct from p then 'price' end, case when o_orderstatus is distinct from s then 'status' end], lambda x: x is not null), ';') as changes from orders left join (select o_orderkey as k, case when o_orderkey % 4 = 0 then null else o_totalprice end as p, case when o_orderkey % 9 = 0 then 'X' else o_orderstatus end as s from orders) on o_orderkey = k")
def version_diff(t: Tables):
    old = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("p"), F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    both = t.orders.join(old, _on("o_orderkey", "k"), "left")
    return both.select("o_orderkey", F.concat_ws(";", F.when(~F.col("o_totalprice").eqNullSafe(F.col("p")), F.lit("price")), F.when(~F.col("o_orderstatus").eqNullSafe(F.col("s")), F.lit("status"))).alias("changes"))


@query("crosswalk", "select page_id, k, case when d.doc_id is null then 'unmatched' else 'filename' end as basis from (select page_id, try_cast(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) as bigint) as k from pages) left join documents d on d.doc_id = k")
def crosswalk(t: Tables):
    k = F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1).try_cast("bigint").alias("k")
    return t.pages.select("page_id", k).join(t.documents.select("doc_id"), _on("k", "doc_id"), "left").select("page_id", "k", F.when(F.col("doc_id").isNull(), "unmatched").otherwise("filename").alias("basis"))


@query("rownumber_join", "with n as (select l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as r from lineitem) select a.l_orderkey, a.r, a.l_linenumber, a.l_quantity = b.l_quantity as verified from n a join n b on a.l_orderkey = b.l_orderkey and a.r = b.r")
def rownumber_join(t: Tables):
    n = R.occurrence(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "r").withColumn("r", F.col("r").cast("long"))
    a, b = n.select("l_orderkey", "r", "l_linenumber", "l_quantity"), n.select("l_orderkey", "r", F.col("l_quantity").alias("q"))
    return a.join(b, ["l_orderkey", "r"]).select("l_orderkey", "r", "l_linenumber", _on("l_quantity", "q").alias("verified"))


@query("bijection_check", "select count(*) as n, count(*) filter (a.o_orderkey is distinct from b.o_orderkey) as broken from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r, o_custkey from orders) a full join (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r, o_custkey from orders) b on a.o_custkey = b.o_custkey and a.r = b.r")
def bijection_check(t: Tables):
    a = R.occurrence(t.orders, ["o_custkey"], ["o_orderkey"], "r").select("o_custkey", "r", F.col("o_orderkey").alias("x"))
    b = R.occurrence(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "r").select("o_custkey", "r", F.col("o_orderkey").alias("y"))
    return a.join(b, ["o_custkey", "r"], "full_outer").agg(F.count("*").alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("broken"))


@query("fk_chain", "select l_orderkey, l_linenumber, n_name, r_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_shipdate < o_orderdate or l_extendedprice > o_totalprice")
def fk_chain(t: Tables):
    joined = t.lineitem.join(t.orders, _on("l_orderkey", "o_orderkey")).where("l_shipdate < o_orderdate or l_extendedprice > o_totalprice").join(t.customer, _on("o_custkey", "c_custkey")).join(t.nation, _on("c_nationkey", "n_nationkey")).join(t.region, _on("n_regionkey", "r_regionkey"))
    return joined.select("l_orderkey", "l_linenumber", "n_name", "r_name")


@query("inclusion_check", "select 'labels in documents' as rule, (select count(*) from labels where doc_id not in (select doc_id from documents)) as missing union all select 'orders in lineitem', (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem))")
def inclusion_check(t: Tables):
    a = R.broken_references(t.labels, "doc_id", t.documents, "doc_id").agg(F.count("*").alias("missing")).select(F.lit("labels in documents").alias("rule"), "missing")
    return a.union(R.broken_references(t.orders, "o_orderkey", t.lineitem, "l_orderkey").agg(F.count("*")).select(F.lit("orders in lineitem"), "*"))


@query("route_priority", "select doc_id, case when b.doc_id is not null then 'seed' when l.quality = 1 then 'reviewed' when n_chars > 3000 then 'rule' else 'none' end as route from documents d left join (select doc_id from labels where toxic = 1) b using (doc_id) left join labels l using (doc_id)")
def route_priority(t: Tables):
    seed = t.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("seed"))
    return t.documents.join(seed, "doc_id", "left").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(F.col("seed"), "seed").when(F.col("quality") == 1, "reviewed").when(F.col("n_chars") > 3000, "rule").otherwise("none").alias("route"))


@query("route_counts", "select case when quality is null then 'unreviewed' when toxic = 1 then 'toxic' else 'clean' end as route, count(*) as documents, sum(n_chars)::bigint as chars from documents left join labels using (doc_id) group by 1")
def route_counts(t: Tables):
    route = F.when(F.col("quality").isNull(), "unreviewed").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return t.documents.join(t.labels, "doc_id", "left").groupBy(route.alias("route")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("review_reconcile", "select conv_id, arg_max(role, turn) as last_action, sum(case role when 'user' then 1 when 'assistant' then -1 else 0 end)::bigint as delta, bool_or(role = 'system') as has_system from conversations group by 1")
def review_reconcile(t: Tables):
    delta = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    return t.conversations.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_action"), F.sum(delta).alias("delta"), F.bool_or(F.col("role") == "system").alias("has_system"))


@query("hierarchy_rows", "select r_name, n_name, count(c_custkey) as leaves, row_number() over (partition by r_name order by n_name) as place from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2")
def hierarchy_rows(t: Tables):
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("leaves"))
    rows = t.region.join(t.nation, _on("r_regionkey", "n_regionkey")).join(n, _on("n_nationkey", "c_nationkey"), "left").fillna({"leaves": 0})
    return rows.select("r_name", "n_name", "leaves", F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")).cast("long").alias("place"))


@query("hierarchy_summary", "select r_name, count(*) as customers, count(distinct n_name) as families, count(*) filter (c_acctbal < 0) as variants from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def hierarchy_summary(t: Tables):
    return t.customer.join(t.nation, _on("c_nationkey", "n_nationkey")).join(t.region, _on("n_regionkey", "r_regionkey")).groupBy("r_name").agg(F.count("*").alias("customers"), F.count_distinct("n_name").alias("families"), F.count_if(F.col("c_acctbal") < 0).alias("variants"))


@query("update_by_key", "select doc_id, case when quality is not null then quality * 1.0::double when lang = 'en' then n_chars / 1000.0::double end as score from documents left join labels using (doc_id)")
def update_by_key(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("double"), F.when(F.col("lang") == "en", F.col("n_chars") / 1000)).alias("score"))


@query("reconciliation", "select o_orderkey, c_custkey is not null as current_exists, coalesce(c_mktsegment, '') as segment from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")
def reconciliation(t: Tables):
    return t.orders.join(t.customer.where("c_acctbal > 0"), _on("o_custkey", "c_custkey"), "left").select("o_orderkey", F.col("c_custkey").isNotNull().alias("current_exists"), F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


@query("nonnoise_sensitivity", "select a.event_type, a.m as all_mean, b.m as kept_mean, b.m - a.m as shift from (select event_type, round(avg(value), 6) as m from events group by 1) a join (select event_type, round(avg(value), 6) as m from events where value >= 10 group by 1) b using (event_type)".replace("b.m - a.m as shift", "round(b.m - a.m, 6) as shift"))
def nonnoise_sensitivity(t: Tables):
    mean = lambda df, name: df.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias(name))
    both = mean(t.events, "all_mean").join(mean(t.events.where("value >= 10"), "kept_mean"), "event_type")
    return both.withColumn("shift", F.round(F.col("kept_mean") - F.col("all_mean"), 6))


@query("null_summary", "select event_type, user_id % 4 as fold, count(*) as n, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean from events group by 1, 2")
def null_summary(t: Tables):
    return t.events.groupBy("event_type", (F.col("user_id") % 4).alias("fold")).agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("union_all", "select 'customer' as kind, c_custkey as k, c_name as name from customer union all select 'supplier', s_suppkey, s_name from supplier")
def union_all(t: Tables):
    return t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("union_unique", "select k, count(*) as n from (select c_custkey as k from customer union all select s_suppkey from supplier) group by 1 having count(*) > 1")
def union_unique(t: Tables):
    return R.broken_keys(t.customer.select(F.col("c_custkey").alias("k")).union(t.supplier.select("s_suppkey")), "k")


@query("set_algebra", "select 'both' as part, count(*) as n from (select doc_id from documents intersect select doc_id from labels) union all select 'only', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'either', count(*) from (select doc_id from documents union select doc_id from labels)")
def set_algebra(t: Tables):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    size = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return size("both", a.intersect(b)).union(size("only", a.subtract(b))).union(size("either", a.union(b).distinct()))
