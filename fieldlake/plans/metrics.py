"""Label and vector metrics. Roles: an embedding's source is vec_id % 7, a document's score its length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from .base import Tables, query


@query("crosstab", "select lang, count(*) filter (source = 'src0') as src0, count(*) filter (source = 'src1') as src1, count(*) filter (source = 'src2') as src2 from documents group by 1")
def crosstab(t: Tables):
    return t.documents.groupBy("lang").pivot("source", ["src0", "src1", "src2"]).count().fillna(0)


@query("cluster_correspondence", "with n as (select lang, source, count(*) as n from documents group by 1, 2) select lang, source as best, n, round(n / total, 9) as share from (select *, sum(n) over (partition by lang) as total, row_number() over (partition by lang order by n desc, source) as r from n) where r = 1")
def cluster_correspondence(t: Tables):
    n = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    ranked = n.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "source"))).where("r = 1")
    return ranked.select("lang", F.col("source").alias("best"), "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


_CONT = "with c as (select lang as a, source as b, count(*)::double as n from documents group by 1, 2), ra as (select a, sum(n) as n from c group by 1), rb as (select b, sum(n) as n from c group by 1), t as (select sum(n) as t from c)"


@query("ari_nmi", f"""{_CONT}, s as (select (select sum(n * (n - 1) / 2) from c) as sij, (select sum(n * (n - 1) / 2) from ra) as sa, (select sum(n * (n - 1) / 2) from rb) as sb, (select t * (t - 1) / 2 from t) as st,
(select sum(c.n / t * ln(c.n * t / (ra.n * rb.n))) from c join ra using (a) join rb using (b), t) as mi, (select -sum(n / t * ln(n / t)) from ra, t) as ha, (select -sum(n / t * ln(n / t)) from rb, t) as hb)
select round((sij - sa * sb / st) / ((sa + sb) / 2 - sa * sb / st), 9) as ari, round(mi / ((ha + hb) / 2), 9) as nmi from s""")
def ari_nmi(t: Tables):
    return V.agreement(V.contingency(t.documents, "lang", "source")).select(F.round("ari", 9).alias("ari"), F.round("nmi", 9).alias("nmi"))


_PRED = "(select quality as y, (n_chars > 1500)::int as p, n_chars / 20000.0::double as s, doc_id from labels join documents using (doc_id))"


def predictions(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"), (F.col("n_chars") / 20000).alias("s"), "doc_id")


@query("confusion", f"select y, p, count(*) as n, round(count(*) / sum(count(*)) over (partition by y), 9) as share from {_PRED} group by 1, 2")
def confusion(t: Tables):
    n = predictions(t).groupBy("y", "p").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("y")), 9))


@query("classification_metrics", f"""with k as (select count(*) filter (y = 1 and p = 1)::double as tp, count(*) filter (y = 0 and p = 1)::double as fp, count(*) filter (y = 1 and p = 0)::double as fn, count(*) filter (y = 0 and p = 0)::double as tn from {_PRED})
select round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) as balanced_accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) as macro_f1, round((tp + tn) / (tp + tn + fp + fn), 9) as accuracy from k""")
def classification_metrics(t: Tables):
    cell = lambda y, p, name: F.count_if((F.col("y") == y) & (F.col("p") == p)).cast("double").alias(name)
    k = predictions(t).agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))
    return k.selectExpr("round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) as balanced_accuracy", "round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) as macro_f1", "round((tp + tn) / (tp + tn + fp + fn), 9) as accuracy")


_CURVE = f"select k::bigint as k, round(avg((s >= k / 20.0)::int) filter (y = 1), 9) as recall, round(avg((s >= k / 20.0)::int) filter (y = 0), 9) as negatives_kept from {_PRED}, range(0, 20) r(k) group by 1"


def curve(t: Tables) -> DataFrame:
    """Recall and kept negatives at each of 20 thresholds; the scores are counted by threshold first, so that the grid meets 40 rows and not all."""
    level = F.least(F.floor(F.col("s") * 20), F.lit(19))
    counts = predictions(t).groupBy("y", level.alias("level")).agg(F.count("*").alias("n"))
    total = counts.groupBy("y").agg(F.sum("n").alias("total"))
    grid = t.spark.range(20).select(F.col("id").alias("k"))
    share = lambda y: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("level") >= F.col("k")), F.col("n") / F.col("total"))), F.lit(0.0))
    return counts.join(total, "y").crossJoin(grid).groupBy("k").agg(F.round(share(1), 9).alias("recall"), F.round(share(0), 9).alias("negatives_kept"))


@query("recall_curve", _CURVE)
def recall_curve(t: Tables):
    return curve(t)


@query("recall_threshold", f"select target, coalesce(max(k) filter (recall >= target), 0)::bigint as k from ({_CURVE}), (values (0.5::double), (0.9::double), (0.99::double)) v(target) group by 1")
def recall_threshold(t: Tables):
    goals = t.spark.createDataFrame([(0.5,), (0.9,), (0.99,)], "target double")
    return curve(t).crossJoin(goals).groupBy("target").agg(F.coalesce(F.max(F.when(F.col("recall") >= F.col("target"), F.col("k"))), F.lit(0)).cast("long").alias("k"))


@query("permutation_p", "select (1 + count(*) filter (m >= (select avg(value) from events where event_type = 'click'))) / (count(*) + 1) as p, count(*) as n from (select user_id, avg(value) as m from events group by 1)")
def permutation_p(t: Tables):
    seen = t.events.where("event_type = 'click'").agg(F.avg("value").alias("seen"))
    return t.events.groupBy("user_id").agg(F.avg("value").alias("m")).crossJoin(seen).agg(((1 + F.count_if(F.col("m") >= F.col("seen"))) / (F.count("*") + 1)).alias("p"), F.count("*").alias("n"))


_LONG = "(select vec_id, label, vec_id % 7 as src, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)"
_UNITS = f"(select label, src, i, quantile_cont(v, 0.5) as v from {_LONG} group by 1, 2, 3)"
_PROTO = f"(select label, i, quantile_cont(v, 0.5) as v from {_UNITS} group by 1, 2)"


def sourced(t: Tables) -> DataFrame:
    return t.embeddings.withColumn("src", F.col("vec_id") % 7)


@query("source_units", f"select label, src, i::bigint as i, round(v, 6) as v from {_UNITS}")
def source_units(t: Tables):
    return V.source_units(sourced(t), "embedding", "label", "src").select("label", "src", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("label_prototypes", f"select label, i::bigint as i, round(v, 6) as v from {_PROTO}")
def label_prototypes(t: Tables):
    return V.prototypes(sourced(t), "embedding", "label", "src").select("label", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


_PAIRS = f"(select a.label as a, b.label as b, sqrt(sum((a.v - b.v) * (a.v - b.v))) as d from {_PROTO} a join {_PROTO} b on a.i = b.i and a.label < b.label group by 1, 2)"


def prototype_pairs(t: Tables) -> DataFrame:
    """Distances of label prototypes; there is one prototype for each label."""
    p = V.assembled(V.prototypes(sourced(t), "embedding", "label", "src"), "label")
    a, b = p.select(F.col("label").alias("a"), F.col("vector").alias("x")), p.select(F.col("label").alias("b"), F.col("vector").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", V.distance(F.col("x"), F.col("y")).alias("d"))


@query("cross_family_distance", f"select a, b, round(d, 6) as d from {_PAIRS} where a % 2 = b % 2")
def cross_family_distance(t: Tables):
    return prototype_pairs(t).where("a % 2 = b % 2").withColumn("d", F.round("d", 6))


@query("distance_ratio", f"""select round((select avg(d) from {_PAIRS}) / (select avg(d) from (select l.vec_id, sqrt(sum((l.v - p.v) * (l.v - p.v))) as d from {_LONG} l join {_PROTO} p on p.label = l.label and p.i = l.i group by 1)), 6) as ratio""")
def distance_ratio(t: Tables):
    """Mean distance of prototypes over the mean distance of vectors to their own prototype: a row for each vector, never a pair of vectors."""
    p = V.assembled(V.prototypes(sourced(t), "embedding", "label", "src"), "label")
    within = t.embeddings.join(p, "label").agg(F.avg(V.distance(F.col("embedding"), F.col("vector"))).alias("w"))
    return prototype_pairs(t).agg(F.avg("d").alias("b")).crossJoin(within).select(F.round(F.col("b") / F.col("w"), 6).alias("ratio"))


@query("silhouette", f"""with d as (select l.vec_id, l.label, p.label as other, sqrt(sum((l.v - p.v) * (l.v - p.v))) as d from {_LONG} l join {_PROTO} p on p.i = l.i group by 1, 2, 3),
s as (select vec_id, label, min(d) filter (other = label) as a, min(d) filter (other <> label) as b from d group by 1, 2)
select label, round(avg((b - a) / greatest(a, b)), 6) as silhouette from s group by 1""")
def silhouette(t: Tables):
    """The silhouette against label prototypes, which is linear in the rows."""
    p = V.assembled(V.prototypes(sourced(t), "embedding", "label", "src"), "label").withColumnRenamed("label", "other")
    d = t.embeddings.crossJoin(p).select("vec_id", "label", "other", V.distance(F.col("embedding"), F.col("vector")).alias("d"))
    s = d.groupBy("vec_id", "label").agg(F.min(F.when(F.col("other") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("d"))).alias("b"))
    return s.groupBy("label").agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"))


@query("spearman", "with r as (select rank() over (order by m) + (count(*) over (partition by m) - 1) / 2 as x, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2 as y from (select user_id, avg(value) as m, count(*) as n from events group by 1)) select round(corr(x, y), 6) as rho from r")
def spearman(t: Tables):
    r = t.events.groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    return r.select(rank("m").alias("x"), rank("n").alias("y")).agg(F.round(F.corr("x", "y"), 6).alias("rho"))


@query("array_zscore", f"select vec_id, i::bigint as i, round((v - m) / greatest(s, 1e-9), 6) as z from {_LONG} join (select vec_id, avg(v) as m, stddev_pop(v) as s from {_LONG} group by 1) using (vec_id)")
def array_zscore(t: Tables):
    v = F.transform("embedding", lambda x: x.cast("double"))
    sums = t.embeddings.select("vec_id", v.alias("v")).withColumn("m", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"))
    sums = sums.withColumn("s", F.sqrt(F.aggregate(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda a, x: a + x) / F.size("v")))
    return sums.select("vec_id", "m", "s", F.posexplode("v").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round((F.col("x") - F.col("m")) / F.greatest(F.col("s"), F.lit(1e-9)), 6).alias("z"))


@query("array_slice", "select vec_id, len(embedding[9:24])::bigint as n, embedding[9]::double as first, embedding[24]::double as last from embeddings")
def array_slice(t: Tables):
    cut = t.embeddings.select("vec_id", F.slice("embedding", 9, 16).alias("x"))
    return cut.select("vec_id", F.size("x").cast("long").alias("n"), F.element_at("x", 1).cast("double").alias("first"), F.element_at("x", -1).cast("double").alias("last"))


@query("array_pad", "select vec_id, greatest(len(embedding), 80)::bigint as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total, 0.0::double as last from embeddings")
def array_pad(t: Tables):
    padded = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), 80 - F.size("embedding")))
    return t.embeddings.select("vec_id", padded.alias("x")).select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.element_at("x", -1).alias("last"))


@query("topk_array", "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint as argmax, list_reverse_sort(embedding)[3]::double as third from embeddings")
def topk_array(t: Tables):
    return t.embeddings.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("argmax"), F.element_at(F.sort_array("embedding", asc=False), 3).cast("double").alias("third"))


@query("fused_view", "select vec_id, (len(embedding) + 8)::bigint as n, round(embedding[1] / sqrt(64.0), 6) as first, round(embedding[8] / sqrt(8.0), 6) as last from embeddings")
def fused_view(t: Tables):
    scaled = lambda a, n: F.transform(a, lambda x: x.cast("double") / math.sqrt(n))
    view = F.concat(scaled(F.col("embedding"), 64), scaled(F.slice("embedding", 1, 8), 8))
    return t.embeddings.select("vec_id", view.alias("x")).select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.element_at("x", 1), 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last"))


@query("feature_subset", "select vec_id, (len(embedding) - 3)::bigint as n, embedding[1]::double as a, embedding[5]::double as b from embeddings")
def feature_subset(t: Tables):
    kept = F.filter("embedding", lambda x, i: ~i.isin(1, 2, 3))
    return t.embeddings.select("vec_id", F.size(kept).cast("long").alias("n"), F.element_at(kept, 1).cast("double").alias("a"), F.element_at(kept, 2).cast("double").alias("b"))


@query("vector_checks", "select vec_id, len(embedding) = 64 as right_size, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) as finite from embeddings")
def vector_checks(t: Tables):
    return t.embeddings.select("vec_id", (F.size("embedding") == 64).alias("right_size"), F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


@query("eligible_labels", "select source, count(*) as n, count(distinct lang) as groups from documents group by 1 having count(*) >= 10 and count(distinct lang) >= 3")
def eligible_labels(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("groups")).where("n >= 10 and groups >= 3")


@query("source_support", """with c as (select lang, source, count(*) as n from documents group by 1, 2), s as (select lang, sum(n)::bigint as n, count(*) as recordings, sum(n * n) as q, max(n) as top from c group by 1)
select lang, n, recordings, round(n * n / q, 6) as effective, round(top / n, 6) as max_share, case when n >= 20 and recordings >= 5 and n * n / q >= 3 then 'high' when n >= 10 and recordings >= 3 then 'moderate' else 'low' end as tier from s""")
def source_support(t: Tables):
    c = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    s = c.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("recordings"), F.sum(F.col("n") * F.col("n")).alias("q"), F.max(F.col("n")).alias("top"))
    effective = F.col("n") * F.col("n") / F.col("q")
    tier = F.when((F.col("n") >= 20) & (F.col("recordings") >= 5) & (effective >= 3), "high").when((F.col("n") >= 10) & (F.col("recordings") >= 3), "moderate").otherwise("low")
    return s.select("lang", "n", "recordings", F.round(effective, 6).alias("effective"), F.round(F.col("top") / F.col("n"), 6).alias("max_share"), tier.alias("tier"))


_GRID = "(select user_id % 5 as a, event_type as b, median(value) as score, round(avg(value), 9) as m, count(*) as n from events group by 1, 2)"


def grid(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 5).alias("a"), F.col("event_type").alias("b")).agg(F.median("value").alias("score"), F.round(F.avg("value"), 9).alias("m"), F.count("*").alias("n"))


@query("grid_stability", f"select a, b, round(score, 9) as score, m, n from {_GRID}")
def grid_stability(t: Tables):
    return grid(t).withColumn("score", F.round("score", 9))


@query("grid_best", f"select a, arg_max(b, (score, b)) as best, round(max(score), 9) as score from {_GRID} group by 1")
def grid_best(t: Tables):
    return grid(t).groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("best"), F.round(F.max("score"), 9).alias("score"))


@query("tiered_filter", f"with x as (select a, b, n, case when m > 1000 then 1 when n > 10 then 2 else 3 end as tier from {_GRID}) select a, b, n, tier from x where tier = (select min(tier) from x)")
def tiered_filter(t: Tables):
    x = grid(t).select("a", "b", "n", F.when(F.col("m") > 1000, 1).when(F.col("n") > 10, 2).otherwise(3).alias("tier"))
    return x.join(F.broadcast(x.agg(F.min("tier").alias("least"))), F.col("tier") == F.col("least")).drop("least")  # one row


@query("fold_leakage", "select k::bigint as fold, (select count(*) from (select user_id from events where user_id % 3 = k intersect select user_id from events where user_id % 3 <> k)) as shared from range(0, 3) r(k)")
def fold_leakage(t: Tables):
    folds = t.events.select("user_id", (F.col("user_id") % 3).alias("fold")).distinct()
    leaks = folds.groupBy("user_id").agg(F.count("*").alias("n"), F.min("fold").alias("fold")).groupBy("fold").agg(F.count_if(F.col("n") > 1).alias("shared"))
    return t.spark.range(3).select(F.col("id").alias("fold")).join(leaks, "fold", "left").fillna({"shared": 0})


@query("fixture_summary", "select event_type, min(value) as least, round(median(value), 9) as middle, max(value) as most from events group by 1")
def fixture_summary(t: Tables):
    return t.events.groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.median("value"), 9).alias("middle"), F.max("value").alias("most"))


def at_least(n: int, k: int) -> float:
    """The chance of k or more heads in n fair throws."""
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n


@query("sign_test", "with c as (select count(*) as n, count(*) filter (m > 20) as k from (select user_id, median(value) as m from events group by 1)) select n, k, round((select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from range(0, 100000) r(i) where i >= k and i <= n), 9) as p from c")
def sign_test(t: Tables):
    c = t.events.groupBy("user_id").agg(F.median("value").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("m") > 20).alias("k")).first()
    return t.spark.createDataFrame([(c["n"], c["k"], round(at_least(c["n"], c["k"]), 9))], "n long, k long, p double")
