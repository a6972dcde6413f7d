"""Scalar, path and identity queries, and typed scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from .base import Tables, query

#: Text cells of a scan: some are not numbers.
_CELLS = "case when event_id % 7 = 0 then 'nan' when event_id % 11 = 0 then '' when event_id % 13 = 0 then 'abc' else cast(cast(round(value * 100) as bigint) as {0}) end"


@query("scan_csv_typed", f"select event_id, cell, case when isfinite(x) then x end as number, x is not null and isfinite(x) as ok from (select event_id, {_CELLS.format('varchar')} as cell, try_cast({_CELLS.format('varchar')} as double) as x from events)")
def scan_csv_typed(t: Tables):
    cells = t.events.select("event_id", F.expr(_CELLS.format("string")).alias("cell"))
    number = F.col("cell").try_cast("double")
    return cells.select("event_id", "cell", F.when(X.finite(number), number).alias("number"), F.coalesce(X.finite(number), F.lit(False)).alias("ok"))


@query("json_extract", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_extract(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("merge_precedence", "select o_orderkey, coalesce(c.c_name, o_orderstatus) as name, coalesce(c.c_acctbal, o_totalprice) as amount from orders left join (select * from customer where c_custkey % 3 = 0) c on o_custkey = c_custkey")
def merge_precedence(t: Tables):
    right = t.customer.where("c_custkey % 3 = 0")
    return t.orders.join(right, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", "o_orderstatus").alias("name"), F.coalesce("c_acctbal", "o_totalprice").alias("amount"))


@query("range_grid", "select cast(i as bigint) as i, round(i * 0.002, 3) as threshold from range(0, 10) r(i) union all select cast(10 + i as bigint), round(0.02 + i * 0.01, 3) from range(0, 9) r(i)")
def range_grid(t: Tables):
    fine = t.spark.range(10).select(F.col("id").alias("i"), F.round(F.col("id") * F.lit(0.002), 3).alias("threshold"))
    return fine.union(t.spark.range(9).select(F.col("id") + 10, F.round(F.lit(0.02) + F.col("id") * F.lit(0.01), 3)))


@query("column_profile", "select 'o_orderkey' as name, count(*) - count(o_orderkey) as nulls, count(distinct o_orderkey) as different from orders union all select 'o_custkey', count(*) - count(o_custkey), count(distinct o_custkey) from orders union all select 'o_orderstatus', count(*) - count(o_orderstatus), count(distinct o_orderstatus) from orders union all select 'o_orderpriority', count(*) - count(o_orderpriority), count(distinct o_orderpriority) from orders")
def column_profile(t: Tables):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    one = t.orders.agg(*[F.struct(F.count_if(F.col(n).isNull()).alias("nulls"), F.count_distinct(n).alias("different")).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n)["nulls"].alias("nulls"), F.col(n)["different"].alias("different")) for n in names])).alias("x")).select("x.*")


@query("parse_int_list", "select page_id, cast(x as bigint) as number, count(*) as n from (select page_id, unnest(regexp_extract_all(url, '[0-9]+')) as x from pages) group by 1, 2")
def parse_int_list(t: Tables):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("url", F.lit(r"(\d+)"), 1)).alias("x")).groupBy("page_id", F.col("x").cast("long").alias("number")).agg(F.count("*").alias("n"))


@query("site_token", "select page_id, split_part(url, '/', 3) as site, split_part(split_part(url, '/', 3), '.', 1) as first_token, split_part(url, '/', -1) as last_token from pages")
def site_token(t: Tables):
    host = F.split_part(F.col("url"), F.lit("/"), F.lit(3))
    return t.pages.select("page_id", host.alias("site"), F.split_part(host, F.lit("."), F.lit(1)).alias("first_token"), F.split_part("url", F.lit("/"), F.lit(-1)).alias("last_token"))


@query("box_geometry", "select l_orderkey, l_linenumber, l_extendedprice - l_quantity as bandwidth, (l_extendedprice + l_quantity) / 2 as centre, l_discount * l_quantity as duration from lineitem")
def box_geometry(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - F.col("l_quantity")).alias("bandwidth"), ((F.col("l_extendedprice") + F.col("l_quantity")) / 2).alias("centre"), (F.col("l_discount") * F.col("l_quantity")).alias("duration"))


@query("week_clamp", "select o_orderkey, greatest(1, least(weekofyear(o_orderdate), 48))::bigint as week, greatest(0.5::double, least(2 - o_totalprice / 100000, 1.5::double)) as sensitivity from orders")
def week_clamp(t: Tables):
    return t.orders.select("o_orderkey", X.clamp(F.weekofyear("o_orderdate"), 1, 48).cast("long").alias("week"), X.clamp(2 - F.col("o_totalprice") / 100000, 0.5, 1.5).alias("sensitivity"))


@query("cluster_paths", "select vec_id, case when label = 0 then 'Noise' else printf('Micro_%03d', label) end as path from embeddings")
def cluster_paths(t: Tables):
    return t.embeddings.select("vec_id", F.when(F.col("label") == 0, "Noise").otherwise(F.format_string("Micro_%03d", "label")).alias("path"))


@query("map_lookup", "select o_orderkey, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 end as level from orders")
def map_lookup(t: Tables):
    ranks = F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(2), F.lit("3-MEDIUM"), F.lit(3))
    return t.orders.select("o_orderkey", F.element_at(ranks, F.col("o_orderpriority")).alias("level"))


@query("public_projection", "select * exclude (c_acctbal, c_mktsegment), '1.0.0' as data_version, '1.0.0' as schema_version from customer")
def public_projection(t: Tables):
    return t.customer.drop("c_acctbal", "c_mktsegment").withColumns({"data_version": F.lit("1.0.0"), "schema_version": F.lit("1.0.0")})


@query("path_safety", r"select page_id, p as path, not (p = '' or starts_with(p, '/') or contains(p, '\') or regexp_matches(p, '(^|/)(\.|\.\.|)(/|$)')) as safe from (select page_id, case when page_id % 5 = 0 then '../' || url when page_id % 5 = 1 then '/' || url else replace(url, '//', '/') end as p from pages)")
def path_safety(t: Tables):
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), "url")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("/"), "url")).otherwise(F.replace("url", F.lit("//"), F.lit("/")))
    return t.pages.select("page_id", path.alias("path")).withColumn("safe", X.safe_path(F.col("path")))


_PATHS = "select o_orderkey, 'site' || (o_custkey % 5) || '/day/' || o_orderkey || case when o_orderkey % 4 = 0 then '.mp3' else '.wav' end as p from orders"


@query("path_inventory", rf"select o_orderkey, p as path, regexp_extract(p, '([^/]+)\.[^./]+$', 1) as stem, regexp_extract(p, '(\.[^./]+)$', 1) as suffix, len(string_split(p, '/'))::bigint as depth, regexp_replace(p, '\.[^./]+$', '.wav.csv') as companion from ({_PATHS})")
def path_inventory(t: Tables):
    p = F.concat(F.lit("site"), F.col("o_custkey") % 5, F.lit("/day/"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 4 == 0, ".mp3").otherwise(".wav"))
    return t.orders.select("o_orderkey", p.alias("path")).select("o_orderkey", "path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"), F.size(F.split("path", "/")).cast("long").alias("depth"), F.regexp_replace("path", r"\.[^./]+$", ".wav.csv").alias("companion"))


#: Fixed value: the recorder's file names, as date and time around a tool's name.
NAME = r"^(\d{4}-\d{2}-\d{2})-birdnet-(\d{2})_(\d{2})_(\d{2})\.mp3$"
_NAMES = "select o_orderkey, o_custkey % 5 as s, case when o_orderkey % 10 = 0 then '2023-02-30-birdnet-01_02_03.mp3' when o_orderkey % 11 = 0 then 'other.mp3' else strftime(o_orderdate, '%Y-%m-%d') || '-birdnet-' || lpad(cast(o_orderkey % 24 as varchar), 2, '0') || '_05_09.mp3' end as f from orders"


@query("filename_identity", f"""with n as ({_NAMES}), p as (select *, regexp_extract(f, '{NAME}', 1) as d, regexp_extract(f, '{NAME}', 2) as h, regexp_extract(f, '{NAME}', 3) as m, regexp_extract(f, '{NAME}', 4) as sec from n),
q as (select *, case when d <> '' and try_cast(d as date) is not null then d || 'T' || h || ':' || m || ':' || sec end as stamp from p)
select o_orderkey, stamp, stamp is not null as valid, left(sha256('2023|S' || s || '|' || coalesce(stamp, 'unparsed:' || f)), 24) as logical, left(sha256(f), 24) as physical from q""")
def filename_identity(t: Tables):
    name = F.when(F.col("o_orderkey") % 10 == 0, "2023-02-30-birdnet-01_02_03.mp3").when(F.col("o_orderkey") % 11 == 0, "other.mp3").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-birdnet-"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("_05_09.mp3")))
    named = t.orders.select("o_orderkey", F.concat(F.lit("S"), F.col("o_custkey") % 5).alias("site"), name.alias("f"))
    return identified(named, F.lit(2023)).select("o_orderkey", "stamp", F.col("stamp").isNotNull().alias("valid"), "logical", X.short_hash(F.col("f")).alias("physical"))


def identified(named, year):
    """named (site, f: file name) with stamp (ISO local time, null if the name or the calendar says no) and logical."""
    part = [F.regexp_extract("f", NAME, k) for k in range(1, 5)]
    stamp = F.when(part[0].try_cast("date").isNotNull() & F.concat(*part[1:]).rlike("^([01][0-9]|2[0-3])([0-5][0-9]){2}$"), F.concat(part[0], F.lit("T"), part[1], F.lit(":"), part[2], F.lit(":"), part[3]))
    return named.withColumn("stamp", stamp).withColumn("logical", X.logical_id(year, F.col("site"), F.col("stamp"), F.col("f")))


@query("stable_id", "select l_orderkey, l_linenumber, left(sha1(printf('%d|%d|%.9f|%.9f|%.3f|%.3f', l_orderkey, l_linenumber, l_discount, l_tax, l_quantity, l_extendedprice)), 20) as stable_id from lineitem")
def stable_id(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.substring(F.sha1(F.format_string("%d|%d|%.9f|%.9f|%.3f|%.3f", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_extendedprice")), 1, 20).alias("stable_id"))
