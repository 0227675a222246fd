"""Vector analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bank as K
from ..operators import evaluate as E
from ..operators import hierarchy as H
from ..operators import losses as L
from ..operators import vectors as V
from ..operators.quantiles import exact_quantiles
from .base import query, table

c = F.col
LONG = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)"
#: The tree over labels: a label is a nation, its parent a region.
TREE = "t AS (SELECT n_nationkey AS label, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def tree(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(c("n_nationkey").alias("label"), "r_name", "n_name")


def show(df, *cols):
    """Arrays of doubles as rows, rounded."""
    return df.select(*cols, F.posexplode("mean").alias("i", "x")).select(*cols, c("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("a14_segment_sum", f"WITH {LONG} SELECT label, i, round(sum(x), 6) AS x FROM v GROUP BY ALL")
def a14(spark, d):
    return emb(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", c("i").cast("long").alias("i")).agg(F.round(F.sum("x"), 6).alias("x"))


@query("a15_group_mean_normalized", f"WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1) SELECT label, i, round(avg(x / n), 6) AS x FROM v JOIN n USING (vec_id) GROUP BY ALL")
def a15(spark, d):
    return show(V.group_mean(emb(spark, d).withColumn("u", V.normalized(c("v"))), ["label"], "u"), "label")


@query("a16_leaf_uniform_rollup", f"WITH {LONG}, {TREE}, m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL) SELECT depth, key, i, round(avg(x), 6) AS x FROM (SELECT -1 AS depth, '' AS key, i, x FROM m JOIN t USING (label) UNION ALL SELECT 0, r_name, i, x FROM m JOIN t USING (label) UNION ALL SELECT 1, r_name || '|' || n_name, i, x FROM m JOIN t USING (label)) GROUP BY ALL")
def a16(spark, d):
    means = V.group_mean(emb(spark, d), ["label"], "v").join(tree(spark, d), "label")
    return show(V.roll_up(means, ["r_name", "n_name"]), "depth", "key")


@query("a17_one_hot_mean", f"WITH {LONG} SELECT vec_id % 7 AS grp, i, round(avg(x), 6) AS x FROM v GROUP BY ALL")
def a17(spark, d):
    return show(V.group_mean(emb(spark, d).withColumn("grp", c("vec_id") % 7), ["grp"], "v"), "grp")


@query("a18_variance_split", f"WITH {LONG}, m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL), g AS (SELECT i, avg(x) AS g FROM v GROUP BY 1), k AS (SELECT i, avg(m) AS k FROM m GROUP BY 1), n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT count(DISTINCT label) AS s FROM embeddings) SELECT round(sum((x - g) ** 2) / any_value(n), 6) AS total, round(sum((x - m) ** 2) / any_value(n), 6) AS within, round(sum((m - g) ** 2) / any_value(n), 6) AS between, round((SELECT sum((m - k) ** 2) / any_value(s) FROM m JOIN k USING (i), s), 6) AS between_classes FROM v JOIN m USING (label, i) JOIN g USING (i), n")
def a18(spark, d):
    out = V.variance_split(emb(spark, d), "label", "v")
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query("a19_row_norms", f"WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1) SELECT round(min(n), 6) AS least, round(max(n), 6) AS most, count(*) FILTER (WHERE NOT isfinite(n)) AS bad FROM n")
def a19(spark, d):
    n = emb(spark, d).select(V.norm(c("v")).alias("n"))
    return n.agg(F.round(F.min("n"), 6).alias("least"), F.round(F.max("n"), 6).alias("most"), F.count_if(F.isnan("n") | (F.abs("n") == float("inf"))).alias("bad"))


NEAR = f"WITH {LONG}, m AS (SELECT label AS cls, i, avg(x) AS m FROM v GROUP BY ALL), mn AS (SELECT cls, sqrt(sum(m * m)) AS mn FROM m GROUP BY 1), s AS (SELECT vec_id, label, cls, sum(x * m) / any_value(mn) / sqrt(sum(x * x)) AS cosine FROM v JOIN m USING (i) JOIN mn USING (cls) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, cls) AS k FROM s)"


def predicted(spark, d):
    classes = V.group_mean(emb(spark, d), ["label"], "v").withColumnRenamed("label", "cls")
    return V.nearest_class(emb(spark, d), "vec_id", "v", classes, "cls", "mean").join(emb(spark, d).select("vec_id", "label"), "vec_id")


@query("j15_nearest_class", f"{NEAR} SELECT vec_id, cls, round(cosine, 6) AS cosine FROM b WHERE k = 1")
def j15(spark, d):
    return predicted(spark, d).select("vec_id", "cls", F.round("cosine", 6).alias("cosine"))


@query("a20_top1_accuracy", f"{NEAR}, e AS (SELECT label, count(*) FILTER (WHERE cls = label) AS correct, count(*) AS n_eval, 100.0 * count(*) FILTER (WHERE cls = label) / count(*) AS top1 FROM b WHERE k = 1 GROUP BY 1) SELECT label, correct, n_eval, round(top1, 6) AS top1, count(*) OVER () AS n_classes, round(avg(top1) OVER (), 6) AS macro FROM e")
def a20(spark, d):
    out = E.accuracy(predicted(spark, d), "label", "cls")
    return out.withColumns({"top1": F.round("top1", 6), "macro": F.round("macro", 6)})


#: Three ranks of class texts (the last one shared by labels of one initial); every eleventh row is unlabelled at the last.
RANK_TEXTS = {"region": "r_name", "nation": "n_name", "initial": "substr(n_name, 1, 1)"}
RANK_SQL = " UNION ALL ".join(
    f"""SELECT '{rank}' AS rank, count(*) FILTER (WHERE gold = guess) AS correct, count(*) AS n_eval, (SELECT count(DISTINCT {text}) FROM m JOIN t USING (label)) AS n_classes, (SELECT count(DISTINCT label) FROM m JOIN t USING (label)) AS n_paths
  FROM (SELECT vec_id, gold, arg_max(text, (cosine, -ord)) AS guess FROM (SELECT v.vec_id, any_value({'CASE WHEN v.vec_id % 11 = 3 THEN NULL ELSE ' + text + ' END' if rank == 'initial' else text}) AS gold, c.text, any_value(c.ord) AS ord, sum(v.x * c.x) / sqrt(sum(c.x * c.x)) AS cosine
    FROM v JOIN t ON t.label = v.label JOIN (SELECT text, i, avg(x) AS x, any_value(ord) AS ord FROM (SELECT {text} AS text, i, x, dense_rank() OVER (ORDER BY {text}) AS ord FROM m JOIN t USING (label)) GROUP BY text, i) c ON c.i = v.i GROUP BY v.vec_id, c.text) WHERE gold IS NOT NULL GROUP BY ALL)"""
    for rank, text in RANK_TEXTS.items()
)


@query("p10_zero_shot_by_rank", f"WITH {LONG}, {TREE}, m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), r AS ({RANK_SQL}), p AS (SELECT *, 100.0 * correct / greatest(n_eval, 1) AS top1 FROM r) SELECT rank, correct, n_eval, n_classes, n_paths, round(top1, 6) AS top1 FROM p UNION ALL SELECT 'average', NULL, NULL, NULL, NULL, round(avg(top1), 6) FROM p")
def p10(spark, d):
    """Classes of one text are one class; a row's gold is its text; rows without gold are not counted."""
    t = tree(spark, d)
    paths = V.group_mean(emb(spark, d), ["label"], "v").join(t, "label")
    text = {"region": c("r_name"), "nation": c("n_name"), "initial": F.substring("n_name", 1, 1)}
    gold = text | {"initial": F.when(c("vec_id") % 11 != 3, text["initial"])}
    rows = emb(spark, d).join(t, "label").select("vec_id", "v", *[x.alias(f"gold_{r}") for r, x in gold.items()])
    out = E.by_rank(rows, "vec_id", "v", {r: f"gold_{r}" for r in text}, {r: paths.select(x.alias("text"), "mean") for r, x in text.items()}, "text", "mean")
    return out.withColumn("top1", F.round("top1", 6))


@query("j14_blocked_similarity", f"WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1), u AS (SELECT vec_id, label, i, x / n AS x FROM v JOIN n USING (vec_id)), s AS (SELECT a.vec_id, b.vec_id AS other, sum(a.x * b.x) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.i = b.i WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY ALL) SELECT vec_id, round(max(cosine), 6) AS cosine FROM s GROUP BY 1 HAVING max(cosine) >= 0.3")
def j14(spark, d):
    e = emb(spark, d)
    return V.blocked_max_cosine(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), "vec_id", "label", "v", least=0.3).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("j18_ancestor_lookup", f"WITH {LONG}, {TREE}, m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), r AS (SELECT r_name, i, avg(x) AS x FROM m JOIN t USING (label) GROUP BY ALL) SELECT label, round(sum(m.x * r.x), 6) AS along FROM m JOIN t USING (label) JOIN r ON t.r_name = r.r_name AND m.i = r.i GROUP BY 1")
def j18(spark, d):
    means = V.group_mean(emb(spark, d), ["label"], "v").join(tree(spark, d), "label")
    up = V.group_mean(means, ["r_name"], "mean", "parent")
    return means.join(up, "r_name").select("label", F.round(V.dot(c("mean"), c("parent")), 6).alias("along"))


@query("a24_spectrum", f"WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1), k AS (SELECT count(*) AS k, avg(n) AS mean_norm FROM n), mu AS (SELECT i, avg(x) AS mu FROM v GROUP BY 1), cov AS (SELECT a.i, b.i AS j, avg(a.x * b.x) - any_value(p.mu) * any_value(q.mu) AS c FROM v a JOIN v b ON a.vec_id = b.vec_id JOIN mu p ON p.i = a.i JOIN mu q ON q.i = b.i GROUP BY a.i, b.i), s AS (SELECT sum(t * t) AS ss FROM (SELECT i, sum(x / n) AS t FROM v JOIN n USING (vec_id) GROUP BY 1)) SELECT round((SELECT sum(c) FILTER (WHERE i = j) ** 2 / sum(c * c) FROM cov), 4) AS participation, round((ss - k) / (k * (k - 1)), 6) AS mean_cosine, round(mean_norm, 6) AS mean_norm FROM s, k")
def a24(spark, d):
    s = V.spectrum(emb(spark, d), "v")
    return s.select(F.round("participation", 4).alias("participation"), F.round("mean_cosine", 6).alias("mean_cosine"), F.round("mean_norm", 6).alias("mean_norm"))


@query("a29_zero_sum", f"WITH {LONG}, {TREE}, m AS (SELECT label, r_name, i, avg(x) AS x FROM v JOIN t USING (label) GROUP BY ALL), r AS (SELECT r_name, i, avg(x) AS x, count(*) AS k FROM m GROUP BY ALL), o AS (SELECT i, avg(x) AS x, count(*) AS k FROM m GROUP BY 1), g AS (SELECT abs(sum(m.x - r.x)) / any_value(r.k) AS g FROM m JOIN r ON r.r_name = m.r_name AND r.i = m.i GROUP BY m.r_name, m.i UNION ALL SELECT abs(sum((r.x - o.x) * r.k)) / any_value(o.k) FROM r JOIN o ON o.i = r.i GROUP BY r.i) SELECT max(g) <= 1e-10 AS zero_sum, round(max(g), 9) AS gap FROM g")
def a29(spark, d):
    """The steps below each node, by their leaves, cancel out."""
    from ..operators import bank as K

    gap = K.zero_sum_gap(K.nodes(V.group_mean(emb(spark, d), ["label"], "v").join(tree(spark, d), "label"), ["r_name", "n_name"]))
    return gap.select((c("gap") <= 1e-10).alias("zero_sum"), F.round("gap", 9).alias("gap"))


@query("a33_penalty", f"WITH {LONG}, {TREE}, m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), r AS (SELECT r_name, i, avg(x) AS r FROM m JOIN t USING (label) GROUP BY ALL), k AS (SELECT r_name, count(DISTINCT label) AS k FROM m JOIN t USING (label) GROUP BY 1), z AS (SELECT label, t.r_name, sum((m.x - r.r) * r.r) AS d, sqrt(sum((m.x - r.r) ** 2)) AS a, sqrt(sum(r.r ** 2)) AS b FROM m JOIN t USING (label) JOIN r ON r.r_name = t.r_name AND r.i = m.i GROUP BY ALL) SELECT r_name, round(sum(d ** 2 / greatest(a ** 2 * b ** 2, 1e-12)) / any_value(k), 6) AS penalty FROM z JOIN k USING (r_name) WHERE k >= 2 GROUP BY r_name")
def a33(spark, d):
    """Mean squared cosine of a leaf's offset with its parent, where the parent has two leaves."""
    means = V.group_mean(emb(spark, d), ["label"], "v").join(tree(spark, d), "label")
    up = V.group_mean(means, ["r_name"], "mean", "parent").join(means.groupBy("r_name").agg(F.count("*").alias("k")), "r_name").where("k >= 2")
    z = means.join(up, "r_name").select("r_name", "k", "parent", F.zip_with("mean", "parent", lambda a, b: a - b).alias("g"))
    cos2 = F.pow(V.dot(c("g"), c("parent")), 2) / F.greatest(V.dot(c("g"), c("g")) * V.dot(c("parent"), c("parent")), F.lit(1e-12))
    return z.groupBy("r_name").agg(F.round(F.sum(cos2) / F.first("k"), 6).alias("penalty"))


@query("a34_drift", f"WITH {LONG}, a AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), b AS (SELECT label, i, avg(x) AS y FROM v WHERE vec_id % 3 <> 0 GROUP BY ALL), d AS (SELECT label, sqrt(sum((x - y) ** 2)) AS d FROM a JOIN b USING (label, i) GROUP BY 1) SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.95), 6) AS p95, count(*) AS n FROM d")
def a34(spark, d):
    e = emb(spark, d)
    both = V.group_mean(e, ["label"], "v").join(V.group_mean(e.where("vec_id % 3 <> 0"), ["label"], "v", "fresh"), "label")
    gap = both.select(V.norm(F.zip_with("mean", "fresh", lambda a, b: a - b)).alias("d"))
    p95 = exact_quantiles(gap, [], "d", {"p95": 0.95})
    return gap.agg(F.round(F.avg("d"), 6).alias("mean"), F.count("*").alias("n")).join(p95.select(F.round("p95", 6).alias("p95")))  # one row each


@query("m01_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, 1.0 AS unit FROM embeddings")
def m01(spark, d):
    return emb(spark, d).select("vec_id", F.round(V.norm(c("v")), 6).alias("norm"), F.round(V.norm(V.normalized(c("v"))), 6).alias("unit"))


@query("m02_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m02(spark, d):
    e = emb(spark, d)
    after = e.select((c("vec_id") - 1).alias("vec_id"), c("v").alias("w"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(c("v"), c("w")), 6).alias("cosine"))


@query("m03_masked_cos2", "SELECT a.vec_id, CASE WHEN a.label = b.label THEN round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) ELSE 0.0 END AS cos2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m03(spark, d):
    e = emb(spark, d)
    after = e.select((c("vec_id") - 1).alias("vec_id"), c("v").alias("w"), c("label").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.when(c("label") == c("other"), F.round(F.pow(V.cosine(c("v"), c("w")), 2), 6)).otherwise(F.lit(0.0)).alias("cos2"))


@query("m04_image_normalize", "SELECT page_id, round(avg((('0x' || h)::INT / 255.0 - 0.5) / 0.25), 6) AS mean FROM (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS h FROM pages) GROUP BY 1")
def m04(spark, d):
    from ..sources.bytestore import normalized_bytes

    x = normalized_bytes(table(spark, d, "pages").select("page_id", F.encode("html", "utf-8").alias("data")), "data", 0.5, 0.25)
    sums = x.select("page_id", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("s"), F.size("x").alias("n"))
    return sums.groupBy("page_id").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@query("m07_softmax", "WITH e AS (SELECT event_id, user_id, value / 100 AS x, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS target FROM events), m AS (SELECT user_id, max(x) AS m FROM e GROUP BY 1), l AS (SELECT user_id, any_value(m) + ln(sum(exp(x - m))) AS lse FROM e JOIN m USING (user_id) GROUP BY 1) SELECT user_id, round(any_value(lse), 6) AS logsumexp, round(sum(exp(x - lse) * (x - lse)), 6) AS weighted_log, round(any_value(lse) - sum(CASE WHEN event_id = target THEN x END), 6) AS cross_entropy FROM e JOIN l USING (user_id) GROUP BY 1")
def m07(spark, d):
    """Of each user's values: logsumexp, the sum of softmax times log-softmax, and the cross-entropy of the last."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", (c("value") / 100).alias("x"))
    tops = e.groupBy("user_id").agg(F.max("x").alias("m"), F.max_by("x", F.struct("ts", "event_id")).alias("own"))
    j = e.join(tops, "user_id")
    lse = j.groupBy("user_id").agg((F.first("m") + F.log(F.sum(F.exp(c("x") - c("m"))))).alias("lse"), F.first("own").alias("own"))
    log_p = c("x") - c("lse")
    return e.join(lse, "user_id").groupBy("user_id").agg(F.round(F.first("lse"), 6).alias("logsumexp"), F.round(F.sum(F.exp(log_p) * log_p), 6).alias("weighted_log"), F.round(F.first("lse") - F.first("own"), 6).alias("cross_entropy"))


LEVELS_SQL = "l AS (SELECT event_type, avg(value) AS loss, avg(value) FILTER (WHERE event_id % 2 = 0) AS ref, stddev_pop(value) AS norm FROM events GROUP BY 1)"


@query("m08_level_weights", f"WITH {LEVELS_SQL}, e AS (SELECT *, exp((loss - max(loss) OVER ()) / 10) AS e, loss / ref AS r, 1 / greatest(norm, 1e-12) AS i FROM l) SELECT event_type, round(e / avg(e) OVER (), 6) AS lse, round(r / avg(r) OVER (), 6) AS ratio, round(i / avg(i) OVER (), 6) AS gradnorm FROM e")
def m08(spark, d):
    levels = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("loss"), F.avg(F.when(c("event_id") % 2 == 0, c("value"))).alias("ref"), F.stddev_pop("value").alias("norm"))
    one = lambda scheme, **kw: L.level_weights(levels, "loss", scheme, **kw).select("event_type", F.round("weight", 6).alias(scheme))
    return one("lse", tau=10.0).join(one("ratio", ref="ref"), "event_type").join(one("gradnorm", grad_norm="norm"), "event_type")


BATCHES = "u AS (SELECT vec_id // 32 AS batch, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS x, list_reverse(embedding)::DOUBLE[] AS y FROM embeddings)"


@query(
    "m15_batch_losses",
    f"""WITH {BATCHES}, z AS (SELECT a.batch, a.vec_id AS a, b.vec_id AS b, 10 * list_dot_product(a.x, b.y) AS z, 10 * list_dot_product(a.y, b.x) AS t FROM u a JOIN u b USING (batch)),
rows_ AS (SELECT batch, a, ln(sum(exp(z))) AS lse, ln(sum(exp(t))) AS tlse FROM z GROUP BY ALL), cols_ AS (SELECT batch, b, ln(sum(exp(z))) AS lse, ln(sum(exp(t))) AS tlse FROM z GROUP BY ALL), n AS (SELECT batch, count(*) AS n FROM u GROUP BY 1),
j AS (SELECT z.batch, z.a, z.b, z, t, r.lse AS rl, r.tlse AS rt, c.lse AS cl, c.tlse AS ct FROM z JOIN rows_ r ON r.batch = z.batch AND r.a = z.a JOIN cols_ c ON c.batch = z.batch AND c.b = z.b)
SELECT batch, any_value(n) AS n, round(sum(CASE WHEN a = b THEN rl - z + cl - z END) / 2 / any_value(n), 6) AS contrastive, round(sum(ln(1 + exp(CASE WHEN a = b THEN -(z - 5) ELSE z - 5 END))) / any_value(n), 6) AS sigmoid,
  round(-sum(exp(t - rt) * (z - rl) + exp(t - ct) * (z - cl)) / 2 / any_value(n), 6) AS distillation FROM j JOIN n USING (batch) GROUP BY batch""",
)
def m15(spark, d):
    """The losses of every batch of 32 pairs: a vector's image is its unit form, its text the reversed vector, the teacher has them swapped."""
    rows = emb(spark, d).select(F.expr("vec_id div 32").alias("batch"), "vec_id", V.normalized(c("v")).alias("x"), F.reverse("v").alias("y"))
    out = L.batch_losses(rows, "batch", "vec_id", "x", "y", "y", "x", 10.0, -5.0)
    return out.select("batch", "n", *[F.round(x, 6).alias(x) for x in ("contrastive", "sigmoid", "distillation")])


@query("m15_caption_loss", "SELECT vec_id // 32 AS batch, round(avg(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) - embedding[label + 1]::DOUBLE), 6) AS loss, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY 1")
def m15_caption(spark, d):
    out = L.caption_loss(emb(spark, d).withColumn("batch", F.expr("vec_id div 32")), "batch", "v", "label", 0)
    return out.withColumn("loss", F.round("loss", 6))


RANKS2 = ["r_name", "n_name"]
BANK_SQL = f"{LONG}, {TREE}, m AS (SELECT label, r_name, n_name, i, avg(x) AS x FROM v JOIN t USING (label) GROUP BY ALL), r AS (SELECT r_name, i, avg(x) AS x, count(*) AS k FROM m GROUP BY ALL), o AS (SELECT i, avg(x) AS x FROM m GROUP BY 1)"


def bank_of(spark, d, rows):
    return V.group_mean(rows, ["label"], "v").join(tree(spark, d), "label")


@query("p08_bank_refresh", f"WITH {BANK_SQL} SELECT 1 AS depth, r_name || '|' || n_name AS key, r_name AS parent, 1 AS n_leaves, 0 AS n_children, round(sum(x * x), 6) AS energy FROM m GROUP BY r_name, n_name UNION ALL SELECT 0, r_name, '', any_value(k), any_value(k), round(sum(x * x), 6) FROM r GROUP BY r_name UNION ALL SELECT -1, '', '', (SELECT count(DISTINCT label) FROM m), (SELECT count(DISTINCT r_name) FROM m), round(sum(x * x), 6) FROM o")
def p08(spark, d):
    """Leaf means, and the means of leaves up to the root."""
    bank = K.nodes(bank_of(spark, d, emb(spark, d)), RANKS2)
    return bank.select("depth", "key", "parent", "n_leaves", "n_children", F.round(V.dot(c("mean"), c("mean")), 6).alias("energy"))


@query("p08_bank_monitor", f"WITH {BANK_SQL}, e AS (SELECT label, any_value(k) AS k, sum((m.x - r.x) * (r.x - o.x)) ** 2 / (sum((m.x - r.x) ** 2) * sum((r.x - o.x) ** 2)) AS c FROM m JOIN r ON r.r_name = m.r_name AND r.i = m.i JOIN o ON o.i = m.i GROUP BY label HAVING any_value(k) > 1) SELECT 1 AS depth, rule, round(avg(c), 6) AS by_edge, round(avg(c), 6) AS by_leaf FROM e, (VALUES ('parent'), ('literal')) q(rule) GROUP BY rule")
def p08_monitor(spark, d):
    out = K.monitor(K.nodes(bank_of(spark, d, emb(spark, d)), RANKS2), 1)
    return out.select("depth", "rule", F.round("by_edge", 6).alias("by_edge"), F.round("by_leaf", 6).alias("by_leaf"))


@query("p08_bank_penalty", f"WITH {BANK_SQL}, e AS (SELECT label, CASE WHEN any_value(k) >= 2 THEN sum((m.x - r.x) * (r.x - o.x)) ** 2 / (greatest(sum((m.x - r.x) ** 2), 1e-12) * sum((r.x - o.x) ** 2)) ELSE 0 END AS c FROM m JOIN r ON r.r_name = m.r_name AND r.i = m.i JOIN o ON o.i = m.i GROUP BY label) SELECT label % 5 = 0 AS heldout, round(avg(c), 6) AS penalty FROM e GROUP BY 1")
def p08_penalty(spark, d):
    """L* of the bank, apart for leaves that training leaves out."""
    means = bank_of(spark, d, emb(spark, d)).withColumn("heldout", c("label") % 5 == 0)
    return K.penalty(K.nodes(means, RANKS2), means, RANKS2, "heldout").withColumn("penalty", F.round("penalty", 6))


@query("p08_bank_drift", f"WITH {BANK_SQL}, w AS (SELECT label, r_name, i, avg(x) AS x FROM v JOIN t USING (label) WHERE vec_id % 3 <> 0 GROUP BY ALL), wr AS (SELECT r_name, i, avg(x) AS x FROM w GROUP BY ALL), wo AS (SELECT i, avg(x) AS x FROM w GROUP BY 1), g AS (SELECT 1 AS depth, label::VARCHAR AS key, i, m.x AS a, w.x AS b FROM m JOIN w USING (label, i) UNION ALL SELECT 0, r_name, i, r.x, wr.x FROM r JOIN wr USING (r_name, i)), q AS (SELECT depth, key, sqrt(sum((a - b) ** 2)) AS dist, 1 - sum((a - o.x) * (b - wo.x)) / sqrt(sum((a - o.x) ** 2) * sum((b - wo.x) ** 2)) AS turn FROM g JOIN o USING (i) JOIN wo USING (i) GROUP BY ALL) SELECT depth, count(*) AS n, round(avg(dist), 6) AS dist_mean, round(quantile_cont(dist, 0.95), 6) AS dist_p95, round(avg(turn), 6) AS turn_mean, round(quantile_cont(turn, 0.95), 6) AS turn_p95 FROM q GROUP BY 1")
def p08_drift(spark, d):
    old, new = (K.nodes(bank_of(spark, d, rows), RANKS2) for rows in (emb(spark, d), emb(spark, d).where("vec_id % 3 <> 0")))
    out = K.drift(old, new)
    return out.select("depth", "n", *[F.round(x, 6).alias(x) for x in ("dist_mean", "dist_p95", "turn_mean", "turn_p95")])


@query("p08_bank_update", f"WITH {LONG}, m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT label, i, avg(x) AS mu, count(*) AS k FROM v WHERE vec_id % 10 = 1 GROUP BY ALL) SELECT m.label, round(sum(CASE WHEN b.k IS NULL THEN x ELSE x + (mu - x) * (k / n) END), 6) AS total FROM m LEFT JOIN b ON b.label = m.label AND b.i = m.i GROUP BY m.label")
def p08_update(spark, d):
    e = emb(spark, d)
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    step = e.where("vec_id % 10 = 1")
    batch = V.group_mean(step, ["label"], "v", "mu").join(step.groupBy("label").agg(F.count("*").alias("k")), "label").join(n, "label")
    return K.moved(V.group_mean(e, ["label"], "v"), "label", batch).select("label", F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("p09_vector_drop_list", f"WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1), u AS (SELECT vec_id, label, i, x / n AS x FROM v JOIN n USING (vec_id)), s AS (SELECT a.vec_id, b.vec_id AS other, sum(a.x * b.x) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.i = b.i WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 GROUP BY ALL) SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS n_val, count(DISTINCT vec_id) FILTER (WHERE cosine >= 0.35) AS dropped FROM s")
def p09(spark, d):
    e = emb(spark, d)
    val = e.where("vec_id % 20 = 0")
    drop = V.blocked_max_cosine(val, e.where("vec_id % 20 <> 0"), "vec_id", "label", "v", least=0.35)
    return val.agg(F.count("*").alias("n_val")).join(drop.agg(F.count("*").alias("dropped")))


@query("p15_geometry_with_null", f"WITH {BANK_SQL}, p AS (SELECT r_name, row_number() OVER (ORDER BY md5('0-' || r_name)) AS a, row_number() OVER (ORDER BY md5('1-' || r_name)) AS b FROM (SELECT DISTINCT r_name FROM r)), s AS (SELECT x.r_name, y.r_name AS other FROM p x JOIN p y ON x.a = y.b), e AS (SELECT m.label, sum(m.x * r.x) / sqrt(sum(m.x ** 2) * sum(r.x ** 2)) AS own, sum(m.x * q.x) / sqrt(sum(m.x ** 2) * sum(q.x ** 2)) AS other FROM m JOIN r ON r.r_name = m.r_name AND r.i = m.i JOIN s ON s.r_name = m.r_name JOIN r q ON q.r_name = s.other AND q.i = m.i GROUP BY m.label) SELECT round(avg(own), 6) AS own, round(avg(other), 6) AS null_value FROM e")
def p15(spark, d):
    """Cosines of leaves with their parents against the same after the parents are shuffled by hash."""
    means = V.group_mean(emb(spark, d), ["label"], "v").join(tree(spark, d), "label")
    up = V.group_mean(means, ["r_name"], "mean", "parent")
    # Parents are numbered in two random orders, by ranges of the hashes.
    order = lambda seed: H.dense_ids(up.withColumn("h", F.md5(F.concat_ws("-", F.lit(str(seed)), "r_name"))), ["h", "r_name"], "k")
    moved = order(0).select("k", "r_name").join(order(1).select("k", c("parent").alias("shuffled")), "k")
    j = means.join(up, "r_name").join(moved.drop("k"), "r_name")
    return j.agg(F.round(F.avg(V.cosine(c("mean"), c("parent"))), 6).alias("own"), F.round(F.avg(V.cosine(c("mean"), c("shuffled"))), 6).alias("null_value"))
