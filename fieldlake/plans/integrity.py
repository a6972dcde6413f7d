"""Constraints as queries of violations; counts by rule, so that a pass has rows too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .base import Tables, query


@query("pk_violations", "select 'orders' as rule, (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1 or o_orderkey is null)) as violations union all select 'documents', (select count(*) from (select doc_id from documents group by 1 having count(*) > 1 or doc_id is null)) union all select 'conversations', (select count(*) from (select conv_id from conversations group by 1 having count(*) > 1 or conv_id is null))")
def pk_violations(t: Tables):
    count = lambda name, df, key: R.broken_keys(df, key).agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return count("orders", t.orders, "o_orderkey").union(count("documents", t.documents, "doc_id")).union(count("conversations", t.conversations, "conv_id"))


@query("fk_violations", "select 'lineitem to orders' as rule, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)) as violations union all select 'orders to customer', (select count(*) from orders where o_custkey not in (select c_custkey from customer)) union all select 'labels to documents', (select count(*) from labels where doc_id not in (select doc_id from documents))")
def fk_violations(t: Tables):
    count = lambda name, child, key, parent, own: R.broken_references(child, key, parent, own).agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return count("lineitem to orders", t.lineitem, "l_orderkey", t.orders, "o_orderkey").union(count("orders to customer", t.orders, "o_custkey", t.customer, "c_custkey")).union(count("labels to documents", t.labels, "doc_id", t.documents, "doc_id"))


@query("type_violations", "select 'status is a letter' as rule, count(*) filter (not regexp_matches(o_orderstatus, '^[A-Z]$')) as violations from orders union all select 'priority begins with a digit', count(*) filter (not regexp_matches(o_orderpriority, '^[0-9]-')) from orders union all select 'price is whole', count(*) filter (o_totalprice <> floor(o_totalprice)) from orders")
def type_violations(t: Tables):
    return R.rule_counts(t.orders, {"status is a letter": F.col("o_orderstatus").rlike("^[A-Z]$"), "priority begins with a digit": F.col("o_orderpriority").rlike("^[0-9]-"), "price is whole": F.col("o_totalprice") == F.floor("o_totalprice")})


@query("check_violations", "select 'quantity from 1 to 50' as rule, count(*) filter (not (l_quantity >= 1 and l_quantity <= 50)) as violations from lineitem union all select 'discount below tax', count(*) filter (not (l_discount < l_tax)) from lineitem")
def check_violations(t: Tables):
    return R.rule_counts(t.lineitem, {"quantity from 1 to 50": F.col("l_quantity").between(1, 50), "discount below tax": F.col("l_discount") < F.col("l_tax")})


@query("declared_counts", "select o_orderkey, coalesce(n, 0) as found, length(o_orderpriority)::bigint as declared from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey where coalesce(n, 0) <> length(o_orderpriority)")
def declared_counts(t: Tables):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("found"))
    both = t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("found", F.lit(0)).alias("found"), F.length("o_orderpriority").cast("long").alias("declared"))
    return both.where("found <> declared")


@query("coverage_once", "select n, count(*) as keys from (select d.doc_id, count(l.doc_id) as n from documents d left join labels l using (doc_id) group by 1) group by 1")
def coverage_once(t: Tables):
    own = t.labels.groupBy("doc_id").agg(F.count("*").alias("n"))
    return t.documents.select("doc_id").join(own, "doc_id", "left").fillna({"n": 0}).groupBy("n").agg(F.count("*").alias("keys"))


@query("hierarchy_check", "select n_name, count(distinct r_name) = 1 as one_parent, any_value(starts_with(n_name, left(r_name, 1))) as same_prefix from nation join region on n_regionkey = r_regionkey group by 1")
def hierarchy_check(t: Tables):
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("n_name").agg((F.count_distinct("r_name") == 1).alias("one_parent"), F.bool_and(F.startswith("n_name", F.substring("r_name", 1, 1))).alias("same_prefix"))


@query("manifest_reconcile", "select coalesce(a.k, b.k) as k, case when a.k is null then 'extra' when b.k is null then 'absent' when a.h <> b.h then 'changed' end as problem from (select doc_id as k, sha256(coalesce(text, '')) as h from documents where doc_id % 8 <> 0) a full join (select doc_id as k, sha256(coalesce(text, '') || case when doc_id % 9 = 0 then '!' else '' end) as h from documents where doc_id % 10 <> 0) b on a.k = b.k where a.k is null or b.k is null or a.h <> b.h")
def manifest_reconcile(t: Tables):
    text = F.coalesce("text", F.lit(""))
    a = t.documents.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("k"), F.sha2(text, 256).alias("h"))
    b = t.documents.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("k"), F.sha2(F.concat(text, F.when(F.col("doc_id") % 9 == 0, "!").otherwise("")), 256).alias("h"))
    found = R.full_diff(a, b, "k", "h").where("status <> 'same'")
    return found.select("k", F.when(F.col("status") == "new", "extra").when(F.col("status") == "missing", "absent").otherwise("changed").alias("problem"))


@query("summary_recompute", "select source, n, stored, n = stored as same from (select source, count(*) as n, sum(case when doc_id % 50 = 0 then 2 else 1 end)::bigint as stored from documents group by 1)")
def summary_recompute(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("doc_id") % 50 == 0, 2).otherwise(1)).alias("stored")).withColumn("same", F.col("n") == F.col("stored"))


@query("count_balance", "select count(*) as candidates, count(*) filter (o_orderstatus = 'P') as held, count(*) filter (o_orderstatus <> 'P') as admitted, count(*) - count(*) filter (o_orderstatus = 'P') = count(*) filter (o_orderstatus <> 'P') as balanced from orders")
def count_balance(t: Tables):
    held = F.col("o_orderstatus") == "P"
    return t.orders.agg(F.count("*").alias("candidates"), F.count_if(held).alias("held"), F.count_if(~held).alias("admitted")).withColumn("balanced", F.col("candidates") - F.col("held") == F.col("admitted"))
