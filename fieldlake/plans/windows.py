"""Ordered operators: bouts, runs, sliding sums, ranks, distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import segments
from .base import Tables, query

#: Bouts end after this many microseconds of silence.
GAP = 3_600_000_000
_SEG = "select user_id, event_id, epoch_us(ts) as a, epoch_us(ts) + cast(round(value * 1000000) as bigint) as b from events"


def detector_segments(t: Tables):
    return t.events.select("user_id", "event_id", X.micros("ts").alias("a"), (X.micros("ts") + F.round(F.col("value") * 1000000).cast("long")).alias("b"))


@query("bouts", f"""with s as ({_SEG}), f as (select *, case when lag(b) over w is null or a - lag(b) over w > {GAP} then 1 else 0 end as fresh from s window w as (partition by user_id order by a, event_id)),
g as (select *, sum(fresh) over (partition by user_id order by a, event_id) as bout from f),
h as (select user_id, bout, count(*) as n, arg_max(b, (a, b)) - min(a) as duration, sum(b - a) as active from g group by 1, 2)
select user_id, count(*) as bouts, sum(n)::bigint as segments, sum(active)::bigint as active, max((n, -bout)).unnamed_1 as longest_n, arg_max(duration, (n, -bout)) as longest_duration from h group by 1""".replace("max((n, -bout)).unnamed_1", "max(n)"))
def bouts(t: Tables):
    numbered = segments.numbered_bouts(detector_segments(t), "user_id", "a", "b", "event_id", GAP)
    return segments.longest_bouts(segments.bout_summary(numbered, "user_id", "a", "b"), "user_id")


@query("composite_rank", """with r as (select user_id, avg(value) as m, count(*) as n, stddev_pop(value) as s from events group by 1),
p as (select user_id, (rank() over (order by m) + (count(*) over (partition by m) - 1) / 2) / count(*) over () as pm, (rank() over (order by n) + (count(*) over (partition by n) - 1) / 2) / count(*) over () as pn, (rank() over (order by s) + (count(*) over (partition by s) - 1) / 2) / count(*) over () as ps from r)
select user_id, round((pm + pn + 1 - ps) / 3, 9) as score from p""")
def composite_rank(t: Tables):
    r = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.stddev_pop("value").alias("s"))
    one = r.withColumn("__all", F.lit(1))
    score = (X.rank_pct(F.col("m"), "__all") + X.rank_pct(F.col("n"), "__all") + 1 - X.rank_pct(F.col("s"), "__all")) / 3
    return one.select("user_id", F.round(score, 9).alias("score"))


@query("longest_run", """with r as (select user_id, event_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as island from events)
select user_id, max(n) as longest from (select user_id, event_type, island, count(*) as n from r group by 1, 2, 3) group by 1""")
def longest_run(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(w)), 0).otherwise(1)
    islands = t.events.withColumn("c", changed).withColumn("island", F.sum("c").over(w))
    return islands.groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("sliding_rms", """with s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
w as (select user_id, value, unnest([i // 5, i // 5 - 1]) as k, i from s)
select user_id, k::bigint as k, count(*) as n, round(sqrt(avg(value * value)), 6) as rms, count(*) < 10 as partial from w where k >= 0 group by 1, 2""")
def sliding_rms(t: Tables):
    """Windows of 10 rows every 5; the last ones may be partial."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.events.select("user_id", "value", F.floor(i / 5).alias("h"))
    hits = rows.select("user_id", "value", F.explode(F.array("h", F.col("h") - 1)).alias("k")).where("k >= 0")
    return hits.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), (F.count("*") < 10).alias("partial"))


@query("lag_diff", "select event_id, value - lag(value) over (partition by user_id order by ts, event_id) as delta from events")
def lag_diff(t: Tables):
    return t.events.select("event_id", (F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("delta"))


@query("cdf_quantiles", """with c as (select l_returnflag, l_quantity, sum(n) over (partition by l_returnflag order by l_quantity) as up, sum(n) over (partition by l_returnflag) as total from (select l_returnflag, l_quantity, count(*) as n from lineitem group by 1, 2))
select l_returnflag, min(l_quantity) filter (up >= 0.25 * total) as q25, min(l_quantity) filter (up >= 0.5 * total) as q50, min(l_quantity) filter (up >= 0.75 * total) as q75 from c group by 1""")
def cdf_quantiles(t: Tables):
    n = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    part = Window.partitionBy("l_returnflag")
    c = n.withColumn("up", F.sum("n").over(part.orderBy("l_quantity"))).withColumn("total", F.sum("n").over(part))
    return c.groupBy("l_returnflag").agg(*[F.min(F.when(F.col("up") >= q * F.col("total"), F.col("l_quantity"))).alias(name) for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])


@query("rms_gate", "select event_id, value from events where value >= (select quantile_cont(value, 0.1) from events)")
def rms_gate(t: Tables):
    gate = t.events.agg(F.percentile("value", 0.1).alias("gate"))
    return t.events.join(F.broadcast(gate), F.col("value") >= F.col("gate")).select("event_id", "value")  # one row


@query("weighted_mean", "select l_orderkey, round(sum(l_discount * greatest(l_quantity, 1e-6)) / sum(greatest(l_quantity, 1e-6)), 9) as mean, case when bool_and(l_returnflag = 'N') then 'manual' when not bool_or(l_returnflag = 'N') then 'auto' else 'mixed' end as kind from lineitem group by 1")
def weighted_mean(t: Tables):
    w, v = F.greatest(F.col("l_quantity"), F.lit(1e-6)), F.col("l_discount")
    manual = F.col("l_returnflag") == "N"
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.when(X.finite(v), v * w)) / F.sum(F.when(X.finite(v), w)), 9).alias("mean"), F.when(F.bool_and(manual), "manual").when(~F.bool_or(manual), "auto").otherwise("mixed").alias("kind"))


@query("entropy", "select user_id, round(-sum(p * ln(p)) / ln(5), 9) as entropy from (select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id) as p from events group by 1, 2) group by 1")
def entropy(t: Tables):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(5.0)), 9).alias("entropy"))


@query("db_ratio", "select l_orderkey, l_linenumber, round(10 * log10(l_extendedprice / l_quantity), 6) as db, round(100 * sqrt(l_discount / l_quantity), 6) as error from lineitem")
def db_ratio(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(10 * F.log10(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("db"), F.round(100 * F.sqrt(F.col("l_discount") / F.col("l_quantity")), 6).alias("error"))


@query("max_score_topk", "select event_id, value from events order by value desc, event_id limit 20")
def max_score_topk(t: Tables):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 20")
def topk(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(20)


_BAR = "select *, row_number() over (order by value desc, event_id) as place, (event_type = 'purchase')::int as hit from events"


@query("topk_lift", f"select k::bigint as k, round(avg(hit) filter (place <= k), 9) as precision, round(avg(hit) filter (place <= k) / avg(hit), 9) as lift from ({_BAR}), (values (100), (500), (1000)) v(k) group by 1")
def topk_lift(t: Tables):
    """The best k by score for each k; ranks come from one sorted pass over scores and hits alone."""
    best = t.events.select("event_id", "value", (F.col("event_type") == "purchase").cast("int").alias("hit"))
    base = best.agg(F.avg("hit").alias("base"))
    top = best.orderBy(F.desc("value"), "event_id").limit(1000).withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")))
    ks = t.spark.createDataFrame([(100,), (500,), (1000,)], "k long")
    return top.join(F.broadcast(ks), F.col("place") <= F.col("k")).groupBy("k").agg(F.avg("hit").alias("p")).crossJoin(base).select("k", F.round("p", 9).alias("precision"), F.round(F.col("p") / F.col("base"), 9).alias("lift"))
