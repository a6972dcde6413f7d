"""Scaling, comparison, review and closure queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import records as C
from .base import Tables, query
from .metrics import _PAIRS, prototype_pairs


@query("robust_scaling", "select event_id, round((value - m) / case when q3 - q1 = 0 then 1 else q3 - q1 end, 6) as scaled from events join (select event_type, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1) using (event_type)")
def robust_scaling(t: Tables):
    return C.scaled(t.events.select("event_id", "event_type", "value"), "value", ["event_type"], robust=True).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("standard_scaling", "with l as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), s as (select i, avg(v) as m, stddev_pop(v) as d from l group by 1) select vec_id, l.i::bigint as i, round((v - m) / case when d = 0 then 1 else d end, 6) as z from l join s on l.i = s.i")
def standard_scaling(t: Tables):
    """Every component of every vector by its column's mean and population deviation."""
    return C.scaled(C.components(t.embeddings, "vec_id", "embedding"), "v", ["i"], name="z").select("vec_id", F.col("i").cast("long").alias("i"), F.round("z", 6).alias("z"))


@query("principal_components")
def principal_components(t: Tables):
    """Share of the variance of the first 30 components, over vectors scaled by their columns. Not in SQL: an eigenvalue problem."""
    long = C.scaled(C.components(t.embeddings, "vec_id", "embedding"), "v", ["i"], robust=True, name="z")
    wide = long.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda x: x["z"]).alias("vector"))
    _, shares = C.principal(wide, "vec_id", "vector", 30)
    return t.spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(shares)], "component long, share double")


@query("payload_kinds", "select source, case when bool_and(coalesce(length(text) = 0, false)) then 'empty' when bool_and(coalesce(length(text) > 0, false)) then 'nonempty' else 'unverified' end as kind from documents group by 1")
def payload_kinds(t: Tables):
    return t.documents.select("source", F.length("text").alias("size")).groupBy("source").agg(C.payload_kind("size").alias("kind"))


@query("active_trim", "select l_orderkey, min(l_linenumber) filter (l_quantity >= 0.1 * m)::bigint as first, max(l_linenumber) filter (l_quantity >= 0.1 * m)::bigint as last from lineitem join (select l_orderkey as k, max(l_quantity) as m from lineitem group by 1) on k = l_orderkey group by 1")
def active_trim(t: Tables):
    """First and last active frame, those of a tenth of the loudest at least, in one aggregate: no frame meets its maximum by a join."""
    frames = F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("v")))
    found = t.lineitem.groupBy("l_orderkey").agg(frames.alias("f"), F.max("l_quantity").alias("m"))
    active = F.transform(F.filter("f", lambda x: x["v"] >= 0.1 * F.col("m")), lambda x: x["i"])
    return found.select("l_orderkey", F.array_min(active).cast("long").alias("first"), F.array_max(active).cast("long").alias("last"))


@query("boolean_parse", "select doc_id, lower(trim(case doc_id % 5 when 0 then ' TRUE ' when 1 then 'Yes' when 2 then '1' when 3 then 'no' else lang end)) in ('true', '1', 'yes') as flag from documents")
def boolean_parse(t: Tables):
    k = F.col("doc_id") % 5
    stated = F.when(k == 0, " TRUE ").when(k == 1, "Yes").when(k == 2, "1").when(k == 3, "no").otherwise(F.col("lang"))
    return t.documents.select("doc_id", stated.alias("stated")).select("doc_id", C.truth("stated").alias("flag"))


@query("offset_required", "select o_orderkey, case o_orderkey % 3 when 0 then epoch(o_orderdate::date::timestamp)::bigint + 43200 - 7200 when 1 then epoch(o_orderdate::date::timestamp)::bigint + 43200 end as seconds from orders")
def offset_required(t: Tables):
    k = F.col("o_orderkey") % 3
    stamp = F.concat(F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.lit("T12:00:00"), F.when(k == 0, "+02:00").when(k == 1, "Z").otherwise(""))
    return t.orders.select("o_orderkey", C.utc_seconds(stamp).alias("seconds"))


@query("field_union", "select c_custkey as key, c_name as name, c_acctbal::double as balance, null::bigint as nation from customer union all select s_suppkey, s_name, null, s_nationkey from supplier")
def field_union(t: Tables):
    """Inputs with different fields under one schema, fields in the order of their first appearance."""
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("duplicate_relations", "with h as (select doc_id, source, sha256(text) as h from documents where text is not null), f as (select h, min(doc_id) as one, count(distinct source) as sources from h group by 1) select 'alias' as relation, doc_id, one as other from h join f using (h) where doc_id <> one union all select 'cross_source', doc_id, sources from h join f using (h) where sources > 1")
def duplicate_relations(t: Tables):
    """Copies of a text, and texts in several sources, as one list of relations."""
    h = t.documents.where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    both = h.join(h.groupBy("h").agg(F.min("doc_id").alias("one"), F.count_distinct("source").alias("sources")), "h")
    alias = both.where("doc_id <> one").select(F.lit("alias").alias("relation"), "doc_id", F.col("one").alias("other"))
    return alias.unionByName(both.where("sources > 1").select(F.lit("cross_source").alias("relation"), "doc_id", F.col("sources").alias("other")))


@query("canonical_hash", """select doc_id, sha256('{"id": ' || doc_id || ', "lang": ' || coalesce('"' || lang || '"', 'null') || ', "source": ' || coalesce('"' || source || '"', 'null') || '}') as h from documents""")
def canonical_hash(t: Tables):
    return t.documents.select("doc_id", F.sha2(C.canonical_json({"source": "source", "id": "doc_id", "lang": "lang"}), 256).alias("h"))


@query("tolerance_compare", """with s as (select event_type, avg(value) as mean, min(value) as least, max(value) as most, avg(round(value, 1)) as mean1, min(value) as least1 from events group by 1),
a as (select event_type || '.mean' as path, mean as v from s union all select event_type || '.least', least from s union all select event_type || '.most', most from s),
e as (select event_type || '.mean' as path, mean1 as v from s union all select event_type || '.least', least1 from s)
select coalesce(a.path, e.path) as path, a.v is not null and e.v is not null and abs(a.v - e.v) <= greatest(1e-9 * greatest(abs(a.v), abs(e.v)), 1e-12) as agrees from a full join e on a.path = e.path""")
def tolerance_compare(t: Tables):
    """Statistics against those of rounded values: least values agree, means don't, and most is missing on one side."""
    s = t.events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg(F.round("value", 1)).alias("mean1"))
    flat = lambda names: s.select("event_type", F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(c).alias("v")) for n, c in names.items()])).alias("x")).select(F.concat_ws(".", "event_type", "x.k").alias("path"), "x.v")
    return C.compared(flat({"mean": "mean", "least": "least", "most": "most"}), flat({"mean": "mean1", "least": "least"}), "path", "v", 1e-9, 1e-12).select("path", "agrees")


@query("catalogue_check", "with a as (select row_number() over (order by n_name) as place, n_name, n_regionkey from nation), b as (select row_number() over (order by n_nationkey) as place, n_name, n_regionkey from nation where n_nationkey <> 7) select coalesce(a.place, b.place) as place, case when b.place is null then 'missing' when a.place is null then 'extra' when a.n_name <> b.n_name then 'order' when a.n_regionkey <> b.n_regionkey then 'role' else 'same' end as state from a full join b on a.place = b.place")
def catalogue_check(t: Tables):
    """A chosen list against the expected one, place by place; a catalogue is a short list."""
    listed = lambda df, key: df.withColumn("place", F.row_number().over(Window.orderBy(key)).cast("long")).select("place", F.struct("n_name", "n_regionkey").alias("x"))
    a, b = listed(t.nation, "n_name").withColumnRenamed("x", "a"), listed(t.nation.where("n_nationkey <> 7"), "n_nationkey").withColumnRenamed("x", "b")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a.n_name") != F.col("b.n_name"), "order").when(F.col("a.n_regionkey") != F.col("b.n_regionkey"), "role").otherwise("same")
    return a.join(b, "place", "full").select("place", state.alias("state"))


@query("recommendation_counts", "select case when quality is null then 'insufficient' when toxic = 1 then 'merge_review' when quality = 1 then 'keep' else 'overlap' end as advice, case when quality is null then 'no evidence' when toxic = 1 then 'look again' when quality = 1 then 'distinct' else 'not distinct' end as meaning, count(*) as n from labels group by 1, 2")
def recommendation_counts(t: Tables):
    advice = F.when(F.col("quality").isNull(), "insufficient").when(F.col("toxic") == 1, "merge_review").when(F.col("quality") == 1, "keep").otherwise("overlap")
    meaning = F.create_map(*[F.lit(x) for pair in {"insufficient": "no evidence", "merge_review": "look again", "keep": "distinct", "overlap": "not distinct"}.items() for x in pair])
    return t.labels.groupBy(advice.alias("advice")).agg(F.count("*").alias("n")).select("advice", meaning[F.col("advice")].alias("meaning"), "n")


@query("variant_evidence", f"with p as (select a, b, round(d, 6) as d from {_PAIRS}), c as (select d from p where a % 2 <> b % 2) select a, b, p.d, (select count(*) from c where c.d <= p.d) / (select count(*) from c) as percentile from p where b = a + 1")
def variant_evidence(t: Tables):
    """Each label's distance to its variant, and its place among distances across families; a row for each pair of labels, not of vectors."""
    p = prototype_pairs(t).withColumn("d", F.round("d", 6))
    c = p.where("a % 2 <> b % 2").agg(F.collect_list("d").alias("others"))  # label pairs: as many as the label list allows
    place = F.size(F.filter("others", lambda x: x <= F.col("d"))) / F.size("others")
    return p.where("b = a + 1").crossJoin(F.broadcast(c)).select("a", "b", "d", place.alias("percentile"))


@query("half_even", "select l_orderkey, l_linenumber, round_even(l_quantity / 2.0, 0) as even, round(l_quantity / 2.0, 0) as up from lineitem")
def half_even(t: Tables):
    half = F.col("l_quantity").cast("double") / 2
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(half, 0).alias("even"), F.round(half, 0).alias("up"))


_DECISION = "case role when 'user' then 'add' when 'assistant' then 'remove' when 'system' then 'defer' else role end"


@query("review_actions", f"with s as (select conv_id, turn, role, {_DECISION} as decision, conv_id % 3 = 0 as base, conv_id % 11 <> 5 as known from conversations), w as (select *, coalesce(last_value(case when known and decision = 'add' then true when known and decision = 'remove' then false end ignore nulls) over (partition by conv_id order by turn, role rows between unbounded preceding and 1 preceding), base) as m from s) select outcome, count(*) as n from (select case when not known then 'unmatched' when decision is null then 'missing_decision' when decision = 'add' then case when m then 'already_member' else 'added' end when decision = 'remove' then case when m then 'removed' else 'already_absent' end when decision = 'defer' then case when m then 'deferred_member' else 'deferred_candidate' end else 'invalid_decision' end as outcome from w) group by 1")
def review_actions(t: Tables):
    decision = F.when(F.col("role") == "user", "add").when(F.col("role") == "assistant", "remove").when(F.col("role") == "system", "defer").otherwise(F.col("role"))
    rows = t.conversations.select("conv_id", "turn", "role", decision.alias("decision"), (F.col("conv_id") % 3 == 0).alias("base"), (F.col("conv_id") % 11 != 5).alias("known"))
    return C.reviewed(rows, "conv_id", ["turn", "role"], "decision", "base", "known").groupBy("outcome").agg(F.count("*").alias("n"))


_NINE = {"missing_size": "o_totalprice is null", "zero_size": "o_totalprice = 0", "short": "o_totalprice < 20000", "long": "o_totalprice > 400000", "pending": "o_orderstatus = 'P'", "urgent": "o_orderpriority = '1-URGENT'", "unspecified": "o_orderpriority = '4-NOT SPECIFIED'", "overdrawn": "c_acctbal < 0", "no_account": "c_custkey is null"}
_NINE_SQL = "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _NINE.items()) + "], lambda x: x is not null), ';')"


@query("technical_status", f"select o_orderkey, {_NINE_SQL} as reasons, case when o_orderkey % 13 = 0 then 'unknown_score' when o_orderkey % 5 = 0 then 'outside_score_scope' when {_NINE_SQL} = '' then 'eligible' else 'held' end as status from orders left join customer on o_custkey = c_custkey")
def technical_status(t: Tables):
    """All of nine conditions that apply, and the status by scope first, then by reasons."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    found = joined.select("o_orderkey", X.all_reasons(*[(F.expr(c), n) for n, c in _NINE.items()]).alias("reasons"))
    k = F.col("o_orderkey")
    return found.withColumn("status", F.when(k % 13 == 0, "unknown_score").when(k % 5 == 0, "outside_score_scope").when(F.col("reasons") == "", "eligible").otherwise("held"))


_CLOCK = "(select distinct extract(year from o_orderdate)::bigint + case when o_orderkey % 3 = 0 then 100 else 0 end as y, o_custkey as site, o_orderdate as stamp from orders where o_orderkey % 50 < 4)"


@query("clock_match", f"select time_status, count(*) as n from (select case when c.y is not null then 'known_clock_error' else 'nominal' end as time_status from orders o left join {_CLOCK} c on c.y = extract(year from o.o_orderdate) and c.site = o.o_custkey and c.stamp = o.o_orderdate) group by 1 union all select 'unmatched_build', count(*) from {_CLOCK} c where not exists (select 1 from orders o where c.y = extract(year from o.o_orderdate) and c.site = o.o_custkey and c.stamp = o.o_orderdate)")
def clock_match(t: Tables):
    """Recordings by a table of clock errors with three keys, and the errors that match no recording."""
    keys = ["y", "site", "stamp"]
    own = t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.col("o_custkey").alias("site"), F.col("o_orderdate").alias("stamp"))
    clock = own.where("o_orderkey % 50 < 4").select((F.col("y") + F.when(F.col("o_orderkey") % 3 == 0, 100).otherwise(0)).alias("y"), "site", "stamp").distinct()
    status = own.join(clock.withColumn("known", F.lit(True)), keys, "left").groupBy(F.when(F.col("known"), "known_clock_error").otherwise("nominal").alias("time_status")).agg(F.count("*").alias("n"))
    return status.union(clock.join(own, keys, "left_anti").agg(F.lit("unmatched_build"), F.count("*")))


_WINDOW = "(select l_orderkey, l_quantity::double - 5 as start, l_quantity::double - 5 + l_linenumber - 2 as stop, l_discount::double as score from lineitem)"


@query("window_diagnostics", f"select l_orderkey, count(*) filter (stop <= start) as nonpositive, count(*) filter (start < 0) as negative, count(*) filter (stop > 30) as late, bool_and(start >= 0 and start < 30 and stop > start and stop <= 33 and stop - start <= 3.000001 and score between 0 and 1) as valid from {_WINDOW} group by 1")
def window_diagnostics(t: Tables):
    """Counts that never filter, and the five bounds of a valid window."""
    start = F.col("l_quantity").cast("double") - 5
    w = t.lineitem.select("l_orderkey", start.alias("start"), (start + F.col("l_linenumber") - 2).alias("stop"), F.col("l_discount").cast("double").alias("score"))
    valid = F.expr("start >= 0 and start < 30 and stop > start and stop <= 33 and stop - start <= 3.000001 and score between 0 and 1")
    return w.groupBy("l_orderkey").agg(F.count_if(F.expr("stop <= start")).alias("nonpositive"), F.count_if(F.expr("start < 0")).alias("negative"), F.count_if(F.expr("stop > 30")).alias("late"), F.bool_and(valid).alias("valid"))


@query("partition_closure", "select s.o_orderstatus as status, s.n as strata, t.n as total, s.n = t.n as closed from (select o_orderstatus, sum(n)::bigint as n from (select o_orderstatus, o_orderpriority, count(*) as n from orders where o_orderpriority <> '5-LOW' or o_orderstatus <> 'P' group by 1, 2) group by 1) s join (select o_orderstatus, count(*) as n from orders group by 1) t using (o_orderstatus)")
def partition_closure(t: Tables):
    """Sums of strata against totals that are counted apart; a stratum is left out of one of them, so one status is not closed."""
    strata = t.orders.where("o_orderpriority <> '5-LOW' or o_orderstatus <> 'P'").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    total = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("total"))
    return strata.groupBy("o_orderstatus").agg(F.sum("n").alias("strata")).join(total, "o_orderstatus").select(F.col("o_orderstatus").alias("status"), "strata", "total", (F.col("strata") == F.col("total")).alias("closed"))


@query("fold_leaks", "select k::bigint as fold, (select count(*) from (select sha256(text) as h from documents where text is not null group by 1 having count(distinct doc_id % 3) > 1 and bool_or(doc_id % 3 = k))) as shared from range(0, 3) r(k)")
def fold_leaks(t: Tables):
    """Texts that a fold shares with another one."""
    folds = t.documents.where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.collect_set(F.col("doc_id") % 3).alias("folds"))
    leaks = folds.where(F.size("folds") > 1).select(F.explode("folds").alias("fold")).groupBy("fold").agg(F.count("*").alias("shared"))
    return t.spark.range(3).select(F.col("id").alias("fold")).join(leaks, "fold", "left").fillna({"shared": 0})


_DRAWS = 100


@query("permutation_null", f"with u as (select user_id, avg(value) as m, bool_or(event_type = 'purchase') as y from events group by 1), n as (select count(*) filter (y) as k, avg(m) filter (y) as seen from u), d as (select r, avg(m) as s from (select r, m, row_number() over (partition by r order by md5(user_id || ':' || r), user_id) as place from u, range(0, {_DRAWS}) x(r)), n where place <= k group by r) select round((1 + count(*) filter (round(s, 9) >= round(seen, 9))) / (count(*) + 1), 9) as p, count(*) as n from d, n")
def permutation_null(t: Tables):
    """Labels dealt anew _DRAWS times by a hash, with as many of them as there are; users are few beside events."""
    u = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.bool_or(F.col("event_type") == "purchase").alias("y"))
    seen = u.agg(F.count_if("y").alias("k"), F.avg(F.when(F.col("y"), F.col("m"))).alias("seen"))
    draws = u.crossJoin(t.spark.range(_DRAWS).withColumnRenamed("id", "r"))
    place = F.row_number().over(Window.partitionBy("r").orderBy(F.md5(F.concat_ws(":", "user_id", "r")), "user_id"))
    drawn = draws.withColumn("place", place).crossJoin(F.broadcast(seen)).where("place <= k").groupBy("r", "seen").agg(F.avg("m").alias("s"))  # seen is one row
    p = (1 + F.count_if(F.round("s", 9) >= F.round("seen", 9))) / (F.count("*") + 1)
    return drawn.agg(F.round(p, 9).alias("p"), F.count("*").alias("n"))
