"""Detection tables: scopes, audits, retention, counts.

Roles: an event is a detector row; its confidence is least(value / 100, 1), its
recording the user, its species the event type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .base import Tables, query

_DUCK = """(select event_id, user_id, event_type, ts, value,
 case when event_id % 17 = 0 then 'nan' when event_id % 19 = 0 then '' else printf('0.%04d', least(cast(round(value * 10) as bigint), 9999)) end as score,
 try_cast(case when event_id % 17 = 0 or event_id % 19 = 0 then null else printf('0.%04d', least(cast(round(value * 10) as bigint), 9999)) end as decimal(38,30)) as d from events)"""


def rows(t: Tables) -> DataFrame:
    """Detector rows with score as text and d as an exact decimal."""
    score = F.when(F.col("event_id") % 17 == 0, "nan").when(F.col("event_id") % 19 == 0, "").otherwise(F.format_string("0.%04d", F.least(F.round(F.col("value") * 10).cast("long"), F.lit(9999))))
    return t.events.select("event_id", "user_id", "event_type", "ts", "value", score.alias("score")).withColumn("d", X.dec("score"))


def scope(d: Column, threshold: str, comparison: str = "gt") -> Column:
    """selected, excluded, or unknown where there is no valid score; never null."""
    limit = F.lit(threshold).cast("decimal(38,30)")
    accepted = d > limit if comparison == "gt" else d >= limit
    return F.when(d.isNull() | ~d.between(0, 1), "unknown").when(accepted, "selected").otherwise("excluded")


@query("score_scope", f"select event_id, case when d is null then 'unknown' when d > 0.5 then 'selected' else 'excluded' end as working, case when d is null then 'unknown' when d >= 0.7 then 'selected' else 'excluded' end as published, case when d > 0.5 and d < 0.7 then '(0.5,0.7)' when d >= 0.7 then '[0.7,1]' else 'outside' end as stratum from {_DUCK}")
def score_scope(t: Tables):
    d = F.col("d")
    stratum = F.when((d > F.lit("0.5").cast("decimal(38,30)")) & (d < F.lit("0.7").cast("decimal(38,30)")), "(0.5,0.7)").when((d >= F.lit("0.7").cast("decimal(38,30)")) & (d <= 1), "[0.7,1]").otherwise("outside")
    return rows(t).select("event_id", scope(d, "0.5").alias("working"), scope(d, "0.7", "ge").alias("published"), stratum.alias("stratum"))


@query("max_confidence", "select user_id, max(least(value / 100, 1.0)) as best from events group by 1")
def max_confidence(t: Tables):
    return t.events.groupBy("user_id").agg(F.max(F.least(F.col("value") / 100, F.lit(1.0))).alias("best"))


@query("detection_audit", f"""select user_id, count(*) as n_rows, count(d) as parsed, count(*) - count(d) as bad, count(*) filter (event_type = 'click') as targets,
 arg_max(score, (d, -event_id)) filter (d is not null) as best_text, min(event_id) filter (d is null) as first_bad,
 case when count(*) = count(d) then 'ok' else 'parse_error' end as status, count(*) filter (value > 300) as late from {_DUCK} group by 1""")
def detection_audit(t: Tables):
    ok = F.col("d").isNotNull()
    return rows(t).groupBy("user_id").agg(
        F.count("*").alias("n_rows"), F.count("d").alias("parsed"), F.count_if(~ok).alias("bad"), F.count_if(F.col("event_type") == "click").alias("targets"),
        F.max_by("score", F.when(ok, F.struct("d", -F.col("event_id")))).alias("best_text"), F.min(F.when(~ok, F.col("event_id"))).alias("first_bad"),
        F.when(F.bool_and(ok), "ok").otherwise("parse_error").alias("status"), F.count_if(F.col("value") > 300).alias("late"),
    )


@query("retention_decision", f"select user_id, event_type, case when not bool_and(d is not null and value < 250) then 'error' when bool_or(d >= 0.2) then 'positive' else 'negative' end as decision from {_DUCK} group by 1, 2")
def retention_decision(t: Tables):
    valid = F.col("d").isNotNull() & (F.col("value") < 250)
    hit = F.coalesce(F.col("d") >= F.lit("0.2").cast("decimal(38,30)"), F.lit(False))
    return rows(t).groupBy("user_id", "event_type").agg(F.when(~F.bool_and(valid), "error").when(F.bool_or(hit), "positive").otherwise("negative").alias("decision"))


@query("species_map", "select user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' order by event_type) || '}' as species from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def species_map(t: Tables):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("species"))


@query("role_status", "select o_orderpriority || ':' || o_orderstatus as role_status, count(*) as n from orders group by 1")
def role_status(t: Tables):
    return t.orders.groupBy(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("role_status")).agg(F.count("*").alias("n"))


@query("group_counts", "select event_type, user_id % 3 as site, count(*) as n from events group by 1, 2")
def group_counts(t: Tables):
    return t.events.groupBy("event_type", (F.col("user_id") % 3).alias("site")).agg(F.count("*").alias("n"))


@query("monthly_counts", "select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def monthly_counts(t: Tables):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).withColumn("total", F.round("total", 2))


@query("duration_hist", "select round(l_quantity, 0) as duration, count(*) as n from lineitem group by 1")
def duration_hist(t: Tables):
    return t.lineitem.groupBy(F.round("l_quantity", 0).alias("duration")).agg(F.count("*").alias("n"))


@query("filetype_counts", r"select case when e = '' then '(none)' else e end as extension, count(*) as n, sum(length(html))::bigint as chars from (select regexp_extract(url, '(\.[A-Za-z0-9]+)$', 1) as e, html from pages) group by 1")
def filetype_counts(t: Tables):
    ext = F.regexp_extract("url", r"(\.[A-Za-z0-9]+)$", 1)
    return t.pages.groupBy(F.when(ext == "", "(none)").otherwise(ext).alias("extension")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


_REASONS = "array_to_string(list_filter([case when l_quantity > 40 then 'long' end, case when l_discount = 0 then 'flat' end, case when l_returnflag = 'R' then 'returned' end], lambda x: x is not null), ';')"


def _reasons() -> Column:
    return X.all_reasons((F.col("l_quantity") > 40, "long"), (F.col("l_discount") == 0, "flat"), (F.col("l_returnflag") == "R", "returned"))


@query("reason_counts", f"select reason, count(*) as n from (select unnest(string_split({_REASONS}, ';')) as reason from lineitem) where reason <> '' group by 1")
def reason_counts(t: Tables):
    return t.lineitem.select(F.explode(F.split(_reasons(), ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


@query("flag_reconcile", "select event_id, (event_type = 'click') as stored, coalesce(value >= 70, false) as computed from events where (event_type = 'click') <> coalesce(value >= 70, false)")
def flag_reconcile(t: Tables):
    flags = t.events.select("event_id", (F.col("event_type") == "click").alias("stored"), F.coalesce(F.col("value") >= 70, F.lit(False)).alias("computed"))
    return flags.where("stored <> computed")
