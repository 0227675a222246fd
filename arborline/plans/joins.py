"""Joins (J1-J19) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import CATALOG_SQL, TRAIN_SQL, catalog, complete, query, table, train

c = F.col


@query("j01_inner_equi", f"WITH {CATALOG_SQL} SELECT split, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM cat JOIN orders ON uuid = o_orderkey WHERE o_orderpriority IS NOT NULL GROUP BY split".replace("WHERE o_orderpriority", "WHERE cat.o_orderpriority"))
def j01(spark, d):
    index = table(spark, d, "orders").select(c("o_orderkey").alias("uuid"), "o_custkey")
    return catalog(spark, d).where(complete()).join(index, "uuid").groupBy("split").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query("j02_inner_dictionary_sorted", f"{TRAIN_SQL}, ids AS (SELECT r_name, n_name, c_mktsegment, o_orderpriority, row_number() OVER (ORDER BY r_name, n_name, c_mktsegment, o_orderpriority) - 1 AS sid FROM (SELECT DISTINCT r_name, n_name, c_mktsegment, o_orderpriority FROM train)) SELECT sid, uuid FROM train JOIN ids USING (r_name, n_name, c_mktsegment, o_orderpriority) ORDER BY sid, uuid")
def j02(spark, d):
    from ..operators.hierarchy import dense_ids
    from .base import RANKS

    rows = train(spark, d)
    return rows.join(dense_ids(rows.select(*RANKS).distinct(), list(RANKS)), list(RANKS)).select("sid", "uuid").orderBy("sid", "uuid")


@query("j03_left_composite_by_position", "SELECT l_orderkey, l_linenumber, r.n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) r USING (l_orderkey, l_linenumber)")
def j03(spark, d):
    li = table(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    asked = li.select(*key).distinct()
    return asked.join(li.where("l_returnflag = 'R'").groupBy(*key).agg(F.count("*").alias("n")), key, "left").orderBy(*key)


SIDES = "a AS (SELECT o_orderkey AS uuid FROM orders WHERE o_orderkey % 50 <> 0), b AS (SELECT o_orderkey AS uuid FROM orders WHERE o_orderkey % 60 <> 0)"


def sides(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("uuid"))
    return o.where("uuid % 50 <> 0"), o.where("uuid % 60 <> 0")


@query("j04_full_outer_reconcile", f"WITH {SIDES} SELECT count(*) AS n, count(*) FILTER (WHERE b.uuid IS NULL) AS left_only, count(*) FILTER (WHERE a.uuid IS NULL) AS right_only, CAST(sum(coalesce(a.uuid, b.uuid)) AS BIGINT) AS s FROM a FULL JOIN b ON a.uuid = b.uuid")
def j04(spark, d):
    a, b = sides(spark, d)
    j = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "uuid", "full_outer")
    return j.agg(F.count("*").alias("n"), F.count_if(c("r").isNull()).alias("left_only"), F.count_if(c("l").isNull()).alias("right_only"), F.sum("uuid").alias("s"))


@query("j05_full_outer_counts", f"WITH {CATALOG_SQL}, k AS (SELECT c_name, split FROM cat) SELECT coalesce(a.c_name, b.c_name) AS c_name, coalesce(a.n, 0) AS n_train, coalesce(b.n, 0) AS n_val FROM (SELECT c_name, count(*) AS n FROM k WHERE split = 'train' GROUP BY 1) a FULL JOIN (SELECT c_name, count(*) AS n FROM k WHERE split = 'val' GROUP BY 1) b ON a.c_name = b.c_name")
def j05(spark, d):
    n = lambda s: catalog(spark, d).where(c("split") == s).groupBy("c_name").agg(F.count("*").alias(f"n_{s}"))
    return n("train").join(n("val"), "c_name", "full_outer").fillna(0, ["n_train", "n_val"])


@query("j06_semi", "SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j06(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").agg(F.count("*").alias("n"))


@query("j07_inner_different_names", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY s_name")
def j07(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_name", "n_name").orderBy("s_name")


@query("j08_left_with_zero_null_assertion", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j08(spark, d):
    from ..operators.quality import assert_that

    cu, n = table(spark, d, "customer"), table(spark, d, "nation")
    return assert_that(cu.join(n, cu.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name"), c("n_name").isNotNull(), "a class is missing")


@query("j09_left_expression_key", "SELECT p_partkey, split_part(p_name, ' ', -1) AS leaf, n FROM part LEFT JOIN (SELECT split_part(p_name, ' ', -1) AS leaf, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1) q ON split_part(p_name, ' ', -1) = q.leaf")
def j09(spark, d):
    p = table(spark, d, "part").withColumn("leaf", F.element_at(F.split("p_name", " "), -1))
    return p.join(p.where("p_size > 25").groupBy("leaf").agg(F.count("*").alias("n")), "leaf", "left").select("p_partkey", "leaf", "n")


@query("j10_left_fill", "SELECT n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) ON n_nationkey = s_nationkey")
def j10(spark, d):
    poor = table(spark, d, "supplier").where("s_acctbal < 0").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(poor, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("j11_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j11(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j12_lookup_with_misses", "SELECT d.doc_id % 10 AS shard, count(l.doc_id) AS hits, count(*) - count(l.doc_id) AS misses FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def j12(spark, d):
    hits = table(spark, d, "labels").select("doc_id", F.lit(1).alias("hit"))
    return table(spark, d, "documents").join(hits, "doc_id", "left").groupBy((c("doc_id") % 10).alias("shard")).agg(F.count("hit").alias("hits"), F.count_if(c("hit").isNull()).alias("misses"))


@query("j13_parent_vs_kept", f"WITH {CATALOG_SQL} SELECT n_name, count(DISTINCT c_name) AS n_all, count(DISTINCT c_name) FILTER (WHERE o_totalprice > 200000) AS n_kept FROM cat GROUP BY n_name HAVING count(DISTINCT c_name) > count(DISTINCT c_name) FILTER (WHERE o_totalprice > 200000)")
def j13(spark, d):
    rows = catalog(spark, d)
    n = lambda df, name: df.groupBy("n_name").agg(F.count_distinct("c_name").alias(name))
    return n(rows, "n_all").join(n(rows.where("o_totalprice > 200000"), "n_kept"), "n_name", "left").fillna(0).where("n_all > n_kept")


@query("j16_self_join_by_step", "WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS step, value FROM events WHERE user_id IN (1, 2)) SELECT a.step, abs(a.value - b.value) < 50 AS near FROM s a JOIN s b ON a.step = b.step WHERE a.user_id = 1 AND b.user_id = 2")
def j16(spark, d):
    from ..operators.metrics import steps

    s = steps(table(spark, d, "events").where("user_id IN (1, 2)"))
    a, b = (s.where(c("user_id") == u).select("step", c("value").alias(f"v{u}")) for u in (1, 2))
    return a.join(b, "step").select("step", (F.abs(c("v1") - c("v2")) < 50).alias("near"))


@query("j17_consistency", "SELECT user_id, event_type, count(*) AS n, count(DISTINCT round(value)) = 1 AS agree FROM events GROUP BY ALL")
def j17(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.count_distinct(F.round("value")) == 1).alias("agree"))


@query("j19_annotations_of_known_images", "SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) d ON c.conv_id = d.doc_id")
def j19(spark, d):
    images = table(spark, d, "documents").where("doc_id % 3 = 0").select(c("doc_id").alias("conv_id"))
    return table(spark, d, "conversations").join(images, "conv_id").select("conv_id", "turn")


@query("u01_union_all", "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def u01(spark, d):
    return table(spark, d, "supplier").select(c("s_name").alias("name")).unionByName(table(spark, d, "customer").select(c("c_name").alias("name")))


@query("u02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02(spark, d):
    return table(spark, d, "customer").select(c("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u03_unique_by_key", "SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def u03(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))


@query("u04_difference", f"WITH {SIDES} SELECT uuid FROM a EXCEPT SELECT uuid FROM b")
def u04(spark, d):
    a, b = sides(spark, d)
    return a.subtract(b)


@query("u05_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def u05(spark, d):
    return table(spark, d, "customer").select(c("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").where("s_acctbal > 3000").select("s_nationkey"))


@query("u06_set_equality", f"WITH {SIDES} SELECT NOT EXISTS (SELECT uuid FROM a EXCEPT SELECT uuid FROM b) AND NOT EXISTS (SELECT uuid FROM b EXCEPT SELECT uuid FROM a) AS equal")
def u06(spark, d):
    a, b = sides(spark, d)
    return a.withColumn("s", F.lit(1)).union(b.withColumn("s", F.lit(2))).groupBy("uuid").agg(F.count_distinct("s").alias("n")).agg((F.count_if(c("n") < 2) == 0).alias("equal"))


@query("u07_vocabulary_sum", "SELECT coalesce(a.w, b.w) AS w, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT split_part(p_name, ' ', 1) AS w, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT split_part(p_name, ' ', 2) AS w, count(*) AS n FROM part GROUP BY 1) b ON a.w = b.w")
def u07(spark, d):
    n = lambda i, name: table(spark, d, "part").groupBy(F.get(F.split("p_name", " "), F.lit(i)).alias("w")).agg(F.count("*").alias(name))
    return n(0, "a").join(n(1, "b"), "w", "full_outer").select("w", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))
