"""Dedup, technical status, duplicate and summary queries.

Roles: an order is a logical recording, its line items are physical files, a
document's text is a payload, and customer, nation and region are the site
hierarchy.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import relational as R
from .base import Tables, query


@query("logical_dedup", "select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey) as files from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1")
def logical_dedup(t: Tables):
    files = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("one"), F.count("*").alias("files"))
    return files.select("l_orderkey", "one.l_linenumber", "one.l_partkey", "files")


@query("representative_pick", """select l_orderkey, l_linenumber, mn <> mx as quantity_differs, n as files from (select *, min(l_quantity) over p as mn, max(l_quantity) over p as mx, count(*) over p as n, row_number() over (partition by l_orderkey order by (l_returnflag = 'N') desc, l_linenumber, l_partkey, l_suppkey) as r from lineitem window p as (partition by l_orderkey)) where r = 1""")
def representative_pick(t: Tables):
    files = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct((F.col("l_returnflag") != "N").alias("late"), "l_linenumber", "l_partkey", "l_suppkey")).alias("one"), (F.min("l_quantity") != F.max("l_quantity")).alias("quantity_differs"), F.count("*").alias("files"))
    return files.select("l_orderkey", "one.l_linenumber", "quantity_differs", "files")


@query("distinct_on", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def distinct_on(t: Tables):
    return t.events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("one")).select("user_id", "one.event_id", "one.event_type")


@query("size_anomalies", """with y as (select l_orderkey, l_linenumber, l_linestatus, l_quantity from lineitem), m as (select l_linestatus, l_quantity as mode from (select l_linestatus, l_quantity, row_number() over (partition by l_linestatus order by count(*) desc, l_quantity) as r from y group by 1, 2) where r = 1)
select y.l_linestatus, l_quantity, count(*) as n from y join m using (l_linestatus) where l_quantity <> mode group by 1, 2""")
def size_anomalies(t: Tables):
    sizes = t.lineitem.groupBy("l_linestatus", "l_quantity").agg(F.count("*").alias("n"))
    mode = sizes.groupBy("l_linestatus").agg(F.max_by("l_quantity", F.struct("n", -F.col("l_quantity"))).alias("mode"))
    return sizes.join(mode, "l_linestatus").where("l_quantity <> mode").drop("mode")


@query("payload_dups", "select sha256(coalesce(text, '')) as payload, count(*) as copies, count(distinct source) as sources, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def payload_dups(t: Tables):
    return t.documents.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload")).agg(F.count("*").alias("copies"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("duplicate_status", "select source, lang, case when count(*) = 1 then 'single' when not bool_and(n_chars > 100) then 'unverified' when count(distinct sha256(text)) = 1 then 'identical' else 'different' end as status, count(*) as n from documents group by 1, 2")
def duplicate_status(t: Tables):
    same = F.min(F.sha2("text", 256)) == F.max(F.sha2("text", 256))
    return t.documents.groupBy("source", "lang").agg(F.when(F.count("*") == 1, "single").when(~F.bool_and(F.col("n_chars") > 100), "unverified").when(same, "identical").otherwise("different").alias("status"), F.count("*").alias("n"))


@query("normalize_annotations", """select l_orderkey, l_linenumber, case when l_quantity is null then 'invalid_numeric' when d > 1 then 'duplicate_view' when l_discount <= 0 then 'nonpositive_duration' when l_quantity > 45 + 1e-4 then 'out_of_bounds' when l_discount > 0.08 then 'duration_outside_limits' end as reason
from (select *, row_number() over (partition by l_orderkey, l_returnflag, l_linestatus order by l_linenumber, l_partkey, l_suppkey) as d from lineitem)""")
def normalize_annotations(t: Tables):
    rows = R.occurrence(t.lineitem, ["l_orderkey", "l_returnflag", "l_linestatus"], ["l_linenumber", "l_partkey", "l_suppkey"], "d")
    c = F.col
    return rows.select("l_orderkey", "l_linenumber", X.first_reason((c("l_quantity").isNull(), "invalid_numeric"), (c("d") > 1, "duplicate_view"), (c("l_discount") <= 0, "nonpositive_duration"), (c("l_quantity") > 45 + 1e-4, "out_of_bounds"), (c("l_discount") > 0.08, "duration_outside_limits")).alias("reason"))


_HOLD = "array_to_string(list_filter([case when o_totalprice < 1000 then 'short' end, case when o_orderstatus = 'P' then 'pending' end, case when o_orderpriority = '1-URGENT' then 'urgent' end, case when c.c_acctbal < 0 then 'clock' end], lambda x: x is not null), ';')"


def _held(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.withColumn("reasons", X.all_reasons((F.col("o_totalprice") < 1000, "short"), (F.col("o_orderstatus") == "P", "pending"), (F.col("o_orderpriority") == "1-URGENT", "urgent"), (F.col("c_acctbal") < 0, "clock")))


@query("hold_reasons", f"select o_orderkey, {_HOLD} as reasons, case when {_HOLD} = '' then 'eligible' else 'held' end as status from orders left join customer c on o_custkey = c_custkey")
def hold_reasons(t: Tables):
    return _held(t).select("o_orderkey", "reasons", F.when(F.col("reasons") == "", "eligible").otherwise("held").alias("status"))


@query("policy_reasons", "select o_orderkey, array_to_string(list_filter([case when o_orderstatus <> 'P' and o_totalprice < 2000 then 'zero' end, case when o_orderstatus <> 'P' and o_totalprice > 200000 then 'non_nominal_duration' end, case when c_acctbal < 0 then 'clock_error' end], lambda x: x is not null), ';') as reasons from orders left join customer on o_custkey = c_custkey")
def policy_reasons(t: Tables):
    joined, open_ = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left"), F.col("o_orderstatus") != "P"
    return joined.select("o_orderkey", X.all_reasons((open_ & (F.col("o_totalprice") < 2000), "zero"), (open_ & (F.col("o_totalprice") > 200000), "non_nominal_duration"), (F.col("c_acctbal") < 0, "clock_error")).alias("reasons"))


@query("clock_flag", "select o_orderkey, case when c_custkey is not null then 'known_clock_error' else 'nominal' end as time_status from orders left join (select * from customer where c_custkey % 10 = 0) on o_custkey = c_custkey")
def clock_flag(t: Tables):
    known = t.customer.where("c_custkey % 10 = 0").select("c_custkey")
    return t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.when(F.col("c_custkey").isNotNull(), "known_clock_error").otherwise("nominal").alias("time_status"))


@query("window_excess", "select event_id, greatest(0.0::double, value - 100) as excess, value > 100 + 1.0 / 48000 as exceeds from events")
def window_excess(t: Tables):
    return t.events.select("event_id", F.greatest(F.lit(0.0), F.col("value") - 100).alias("excess"), (F.col("value") > 100 + 1.0 / 48000).alias("exceeds"))


@query("release_summary", f"select count(*) as archive, count(*) filter (r = '') as eligible, count(*) filter (r <> '') as held, count(*) filter (contains(r, ';')) as several, count(distinct o_custkey) as sites, round(sum(o_totalprice) filter (r = ''), 2) as bytes from (select *, {_HOLD} as r from orders left join customer c on o_custkey = c_custkey)")
def release_summary(t: Tables):
    r = F.col("reasons")
    return _held(t).agg(F.count("*").alias("archive"), F.count_if(r == "").alias("eligible"), F.count_if(r != "").alias("held"), F.count_if(r.contains(";")).alias("several"), F.count_distinct("o_custkey").alias("sites"), F.round(F.sum(F.when(r == "", F.col("o_totalprice"))), 2).alias("bytes"))


@query("sampling_frame", """with f as (select extract(year from o_orderdate)::bigint as year, n_name as site, case when o_totalprice > 100000 then 'upper' else 'lower' end as band, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)
select y.year, s.n_name as site, b.band, coalesce(f.n, 0) as n from (select distinct extract(year from o_orderdate)::bigint as year from orders) y, nation s, (values ('lower'), ('upper')) b(band) left join f on f.year = y.year and f.site = s.n_name and f.band = b.band""")
def sampling_frame(t: Tables):
    year = F.year("o_orderdate").cast("long").alias("year")
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = facts.groupBy(year, F.col("n_name").alias("site"), F.when(F.col("o_totalprice") > 100000, "upper").otherwise("lower").alias("band")).agg(F.count("*").alias("n"))
    bands = t.spark.createDataFrame([("lower",), ("upper",)], "band string")
    return R.dense_grid(facts, [t.orders.select(year).distinct(), t.nation.select(F.col("n_name").alias("site")), bands], ["year", "site", "band"], ["n"])


@query("disposition", "select quality, toxic, count(*) as n, count(*) = count(distinct doc_id) as unique_ids from labels join documents using (doc_id) group by 1, 2")
def disposition(t: Tables):
    return t.labels.join(t.documents, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("doc_id")).alias("unique_ids"))


@query("representative_attach", "select d.doc_id, d.source, d.n_chars, l.quality from (select * from documents qualify row_number() over (partition by sha256(text) order by doc_id) = 1) d join labels l using (doc_id)")
def representative_attach(t: Tables):
    first = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return t.documents.join(first, "doc_id", "left_semi").join(t.labels, "doc_id").select("doc_id", "source", "n_chars", "quality")


@query("stratified_pilot", "select o_orderpriority, o_orderkey from orders qualify row_number() over (partition by o_orderpriority order by sha256(cast(o_orderkey as varchar))) <= 5")
def stratified_pilot(t: Tables):
    return R.smallest_by_hash(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], F.sha2(F.col("o_orderkey").cast("string"), 256), 5)


@query("equidistant_sample", "with n as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders) select o_orderpriority, o_orderkey from n where n <= 7 or i in (select cast(round_even(k * (n - 1) / 6, 0) as bigint) from range(0, 7) r(k))")
def equidistant_sample(t: Tables):
    return R.equidistant(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 7)


@query("custom_order", "select n_name, row_number() over (order by case r_name when 'EUROPE' then 1 when 'ASIA' then 2 else 9 end, n_name) as place from nation join region on n_regionkey = r_regionkey")
def custom_order(t: Tables):
    order = F.array(F.lit("EUROPE"), F.lit("ASIA"))
    place = F.array_position(order, F.col("r_name"))
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.row_number().over(Window.orderBy(F.when(place == 0, 9).otherwise(place), "n_name")).cast("long").alias("place"))
