"""Aggregations over the catalog and its tables (A1-A36 but those of vectors and metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from .base import CATALOG_SQL, GROUP_SIZE, RANKS, TRAIN_SQL, catalog, prefix_key, query, table, train

c = F.col


@query("a01_grouped_count", f"WITH {CATALOG_SQL} SELECT split, count(*) AS n FROM cat GROUP BY split")
def a01(spark, d):
    return catalog(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query("a02_conditional_counts", f"WITH {CATALOG_SQL} SELECT n_name, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val FROM cat GROUP BY n_name")
def a02(spark, d):
    return catalog(spark, d).groupBy("n_name").agg(*[F.count_if(c("split") == s).alias(f"n_{s}") for s in ("train", "val")])


PATTERNS = {"upper_first": "^[A-Z]", "has_digit": "[0-9]", "has_comma": ",", "has_upper_inside": "[a-z][A-Z]", "ends_stop": r"\.$", "has_hash": "###"}


@query("a03_regex_profile", "SELECT lang, source, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS {k}" for k, p in PATTERNS.items()) + " FROM documents GROUP BY lang, source")
def a03(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.count_if(c("text").rlike(p)).alias(k) for k, p in PATTERNS.items()])


@query("a04_distinct_counts", f"WITH {CATALOG_SQL} SELECT n_name, count(DISTINCT c_name) AS names, count(DISTINCT o_orderpriority) AS priorities FROM cat GROUP BY n_name")
def a04(spark, d):
    return catalog(spark, d).groupBy("n_name").agg(F.count_distinct("c_name").alias("names"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("a05_prefix_vs_name", f"{TRAIN_SQL} " + " UNION ALL ".join(f"SELECT {i} AS depth, count(DISTINCT {' || chr(124) || '.join(RANKS[: i + 1])}) AS paths, count(DISTINCT {r}) AS names FROM train" for i, r in enumerate(RANKS)))
def a05(spark, d):
    rows = train(spark, d)
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("depth"), prefix_key(RANKS[: i + 1]).alias("path"), c(r).alias("name")) for i, r in enumerate(RANKS)]))
    return rows.select(*RANKS).distinct().select(levels.alias("x")).select("x.*").groupBy("depth").agg(F.count_distinct("path").alias("paths"), F.count_distinct("name").alias("names"))


@query("a06_constant_per_group", "SELECT c_nationkey, min(n_name) AS n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def a06(spark, d):
    cu, n = table(spark, d, "customer"), table(spark, d, "nation")
    return cu.join(n, cu.c_nationkey == n.n_nationkey).groupBy("c_nationkey").agg(F.min("n_name").alias("n_name"), F.count("*").alias("n"))


@query("a07_homonyms", f"{TRAIN_SQL} SELECT o_orderpriority AS leaf, count(*) AS parents FROM (SELECT DISTINCT r_name, n_name, c_mktsegment, o_orderpriority FROM train) GROUP BY 1 HAVING count(*) > 1")
def a07(spark, d):
    return train(spark, d).select(*RANKS).distinct().groupBy(c("o_orderpriority").alias("leaf")).agg(F.count("*").alias("parents")).where("parents > 1")


@query("a08_counts_with_zero_groups", "SELECT n_nationkey AS id, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1")
def a08(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 8000").groupBy(c("s_nationkey").alias("id")).agg(F.count("*").alias("n"))
    return rich.join(table(spark, d, "nation").select(c("n_nationkey").alias("id")), "id", "right").select("id", F.coalesce("n", F.lit(0)).alias("n"))


LEAVES_SQL = f"{TRAIN_SQL}, leaves AS (SELECT r_name, n_name, c_mktsegment, o_orderpriority, key, count(*) AS n_s, CAST(ceil(count(*) / {GROUP_SIZE}) AS BIGINT) AS g_s FROM train GROUP BY ALL)"


def leaves(spark, d):
    return H.leaf_counts(train(spark, d), [*RANKS, "key"], GROUP_SIZE)


@query("a09_group_totals", f"{LEAVES_SQL} SELECT count(*) AS n_leaves, CAST(sum(g_s) AS BIGINT) AS groups, max(g_s) AS most, count(*) FILTER (WHERE g_s > 2) AS above FROM leaves")
def a09(spark, d):
    return leaves(spark, d).agg(F.count("*").alias("n_leaves"), F.sum("g_s").alias("groups"), F.max("g_s").alias("most"), F.count_if(c("g_s") > 2).alias("above"))


@query("a10_argmax_first_tie", f"{LEAVES_SQL} SELECT key, n_s FROM leaves ORDER BY n_s DESC, key LIMIT 1")
def a10(spark, d):
    return leaves(spark, d).orderBy(F.desc("n_s"), "key").limit(1).select("key", "n_s")


@query("a11_medians", f"{LEAVES_SQL} SELECT min(n_s) AS least, max(n_s) AS most, quantile_disc(n_s, 0.5) AS lower_median, CAST(median(n_s) AS DOUBLE) AS median FROM leaves")
def a11(spark, d):
    return leaves(spark, d).agg(F.min("n_s").alias("least"), F.max("n_s").alias("most"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_s)").cast("long").alias("lower_median"), F.median("n_s").alias("median"))


@query("a12_percentiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part GROUP BY 1")
def a12(spark, d):
    from ..operators.quantiles import exact_quantiles

    out = exact_quantiles(table(spark, d, "part"), ["p_brand"], "p_retailprice", {"p10": 0.1, "p90": 0.9, "p95": 0.95})
    return out.select("p_brand", *[F.round(n, 6).alias(n) for n in ("p10", "p90", "p95")])


@query("a12_overall", "SELECT round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem")
def a12_all(spark, d):
    """Of a whole table, narrowed by passes: at most a thousand different values meet in a task."""
    from ..operators.quantiles import exact_quantiles

    out = exact_quantiles(table(spark, d, "lineitem"), [], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, most=1000)
    return out.select(*[F.round(n, 4).alias(n) for n in ("p10", "p50", "p95")])


@query("a13_weighted_mean", "SELECT l_returnflag, round(sum(x * w) / sum(w), 6) AS mean, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_quantity = 7 THEN NULL ELSE l_discount END AS x, l_quantity AS w FROM lineitem) WHERE x IS NOT NULL GROUP BY 1")
def a13(spark, d):
    x = F.when(c("l_quantity") == 7, F.lit(float("nan"))).otherwise(c("l_discount"))
    t = table(spark, d, "lineitem").select("l_returnflag", x.alias("x"), c("l_quantity").alias("w")).where(~F.isnan("x"))
    return t.groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum(c("x") * c("w")), F.sum("w")), 6).alias("mean"), F.count("*").alias("n"))


@query("a21_partial_then_final", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def a21(spark, d):
    """Sums of all workers: partial aggregates before the one exchange."""
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum(c("l_quantity").cast("long")).alias("quantity"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("a22_ordered_concat", "SELECT 0 AS worker, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation ORDER BY worker, k")
def a22(spark, d):
    part = lambda i, t, k, n: table(spark, d, t).select(F.lit(i).alias("worker"), c(k).alias("k"), c(n).alias("name"))
    return part(0, "region", "r_regionkey", "r_name").union(part(1, "nation", "n_nationkey", "n_name")).orderBy("worker", "k")


@query("a23_replica_spread", "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def a23(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.max("value") - F.min("value"), 6).alias("spread"))


@query("a25_category_report", f"WITH {CATALOG_SQL} SELECT c_mktsegment, o_orderstatus, count(*) AS n, count(*) FILTER (WHERE split = 'val') AS n_val, count(DISTINCT c_name) AS names FROM cat GROUP BY ALL ORDER BY n DESC, c_mktsegment, o_orderstatus")
def a25(spark, d):
    return catalog(spark, d).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.count_if(c("split") == "val").alias("n_val"), F.count_distinct("c_name").alias("names")).orderBy(F.desc("n"), "c_mktsegment", "o_orderstatus")


@query("a26_examples", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name))[1:10], ',') AS examples FROM part GROUP BY 1")
def a26(spark, d):
    return table(spark, d, "part").select("p_brand", "p_name").distinct().groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_name")), 1, 10), ",").alias("examples"))


@query("a27_later_copies", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def a27(spark, d):
    from ..operators.quality import later_copies

    return later_copies(table(spark, d, "documents"), "doc_id", "text")


@query("a30_bijection", "SELECT count(DISTINCT n_nationkey) = count(DISTINCT n_name) AND count(DISTINCT (n_nationkey, n_name)) = count(DISTINCT n_name) AS bijection, count(DISTINCT n_regionkey) = count(DISTINCT n_name) AS region_bijection FROM nation")
def a30(spark, d):
    return table(spark, d, "nation").agg(((F.count_distinct("n_nationkey") == F.count_distinct("n_name")) & (F.count_distinct("n_nationkey", "n_name") == F.count_distinct("n_name"))).alias("bijection"), (F.count_distinct("n_regionkey") == F.count_distinct("n_name")).alias("region_bijection"))


@query("a32_shard_totals", "SELECT CAST(sum(n) AS BIGINT) AS n, max(n) AS most, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT page_id % 8 AS shard, count(*) AS n, sum(octet_length(encode(html))) AS bytes FROM pages GROUP BY 1)")
def a32(spark, d):
    shards = table(spark, d, "pages").groupBy((c("page_id") % 8).alias("shard")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))
    return shards.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"))


@query("a35_taxa_lost", f"{TRAIN_SQL}, kept AS (SELECT * FROM train WHERE o_totalprice > 250000) " + " UNION ALL ".join(f"SELECT {i} AS depth, count(*) AS lost FROM (SELECT {' || chr(124) || '.join(RANKS[: i + 1])} FROM train EXCEPT SELECT {' || chr(124) || '.join(RANKS[: i + 1])} FROM kept)" for i in range(4)))
def a35(spark, d):
    rows = train(spark, d)
    flags = rows.groupBy(*RANKS).agg(F.bool_or(c("o_totalprice") > 250000).alias("kept"))
    out = None
    for i in range(len(RANKS)):
        one = flags.groupBy(*RANKS[: i + 1]).agg(F.bool_or("kept").alias("kept")).agg(F.lit(i).alias("depth"), F.count_if(~c("kept")).alias("lost"))
        out = one if out is None else out.union(one)
    return out


@query("a36_what_if_merge", f"{LEAVES_SQL}, m AS (SELECT r_name || '|' || n_name || '|' || c_mktsegment || '|' || CASE WHEN o_orderpriority LIKE '4%' THEN '5-LOW' ELSE o_orderpriority END AS target, key, n_s FROM leaves) SELECT target, CAST(sum(n_s) AS BIGINT) AS n, bool_or(key = target) AS existing, count(*) AS merged FROM m GROUP BY target HAVING count(*) > 1 OR NOT bool_or(key = target)")
def a36(spark, d):
    leaf = F.when(c("o_orderpriority").startswith("4"), "5-LOW").otherwise(c("o_orderpriority"))
    m = leaves(spark, d).withColumn("target", prefix_key([*RANKS[:3], leaf]))
    return m.groupBy("target").agg(F.sum("n_s").alias("n"), F.bool_or(c("key") == c("target")).alias("existing"), F.count("*").alias("merged")).where("merged > 1 OR NOT existing")
