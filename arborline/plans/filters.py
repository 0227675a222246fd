"""Projections, filters, predicates and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .base import CATALOG_SQL, SEVEN, catalog, complete, query, table

c = F.col


@query("f01_notnull_membership", f"WITH {CATALOG_SQL} SELECT uuid, split, o_orderpriority FROM cat WHERE o_orderpriority IS NOT NULL AND split IN ('train', 'val')")
def f01(spark, d):
    return catalog(spark, d).where(c("o_orderpriority").isNotNull() & c("split").isin("train", "val")).select("uuid", "split", "o_orderpriority")


@query("f02_rename_drop", "SELECT s_suppkey AS uuid, s_name AS name, s_nationkey AS nation FROM supplier")
def f02(spark, d):
    return table(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "uuid", "s_name": "name", "s_nationkey": "nation"}).drop("s_acctbal")


@query("f03_complete_flag", f"WITH {CATALOG_SQL} SELECT split, o_orderpriority IS NOT NULL AND c_mktsegment IS NOT NULL AND n_name IS NOT NULL AND r_name IS NOT NULL AS complete, count(*) AS n FROM cat GROUP BY ALL")
def f03(spark, d):
    return catalog(spark, d).withColumn("complete", complete()).groupBy("split", "complete").agg(F.count("*").alias("n"))


DIRTY = "CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN ' ' || o_orderpriority WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"


@query("f04_padded_or_empty", f"SELECT count(*) FILTER (WHERE p <> trim(p) OR p = '') AS bad_priority, count(*) FILTER (WHERE s <> trim(s) OR s = '') AS bad_status FROM (SELECT {DIRTY} AS p, o_orderstatus AS s FROM orders)")
def f04(spark, d):
    t = table(spark, d, "orders").select(F.expr(DIRTY).alias("p"), c("o_orderstatus").alias("s"))
    return t.agg(*[F.count_if(Q.padded_or_empty(c(x))).alias(n) for x, n in (("p", "bad_priority"), ("s", "bad_status"))])


@query("f05_cardinality_assertion", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 20 = 0) AS n_val FROM orders")
def f05(spark, d):
    t = table(spark, d, "orders")
    counted = t.agg(F.count("*").alias("n"), F.count_if(c("o_orderkey") % 20 == 0).alias("n_val"))
    return Q.assert_that(counted, (c("n") > 0) & (c("n_val") <= c("n")), "unexpected row counts")


@query("f06_uniqueness", "SELECT count(*) AS n, count(DISTINCT o_orderkey) + CAST(count(*) > count(o_orderkey) AS INT) AS n_unique, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders")
def f06(spark, d):
    return Q.uniqueness(table(spark, d, "orders"), "o_orderkey")


@query("f07_source_cascade", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'first' WHEN o_orderkey % 5 = 0 THEN 'second' WHEN o_orderkey % 7 = 0 THEN 'third' ELSE 'none' END AS source, count(*) AS n FROM orders GROUP BY ALL")
def f07(spark, d):
    k = c("o_orderkey")
    source = F.when(k % 3 == 0, "first").when(k % 5 == 0, "second").when(k % 7 == 0, "third").otherwise("none")
    return table(spark, d, "orders").groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query("f08_null_pattern", f"WITH {CATALOG_SQL} SELECT {' || '.join(f'CASE WHEN {r} IS NULL THEN chr(45) ELSE chr(120) END' for r in SEVEN)} AS pattern, count(*) AS n FROM cat GROUP BY ALL")
def f08(spark, d):
    return catalog(spark, d).groupBy(Q.null_pattern(SEVEN).alias("pattern")).agg(F.count("*").alias("n"))


CAPTIONS = "SELECT d.doc_id, text, CASE WHEN quality = 1 THEN 'success' WHEN quality = 0 THEN 'failed' END AS status, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE n_chars / 1000.0 END AS sim FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def captions(spark, d):
    """The caption corpus: documents, status from labels, similarity from size."""
    status = F.when(c("quality") == 1, "success").when(c("quality") == 0, "failed")
    sim = F.when(c("doc_id") % 7 == 0, None).otherwise(c("n_chars") / 1000)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "text", status.alias("status"), sim.alias("sim"))


@query("f09_status_filter", f"SELECT doc_id, status FROM ({CAPTIONS}) WHERE status IS NULL OR status = 'success'")
def f09(spark, d):
    return captions(spark, d).where(Q.status_ok("status")).select("doc_id", "status")


@query("f10_threshold_passes_null", f"SELECT doc_id, round(sim, 6) AS sim FROM ({CAPTIONS}) WHERE sim IS NULL OR sim >= 1.5")
def f10(spark, d):
    return captions(spark, d).where(Q.at_least_or_null("sim", 1.5)).select("doc_id", F.round("sim", 6).alias("sim"))


LATER = "SELECT doc_id AS drop_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1"


@query("f11_drop_list", f"SELECT doc_id FROM documents WHERE doc_id NOT IN ({LATER})")
def f11(spark, d):
    docs = table(spark, d, "documents")
    return Q.without(docs, Q.later_copies(docs, "doc_id", "text").select(c("doc_id").cast("string").alias("drop_id")), "doc_id").select("doc_id")


@query("f12_blank_text", "SELECT doc_id, octet_length(encode(x)) AS n FROM (SELECT doc_id, nullif(regexp_replace(CASE WHEN doc_id % 13 = 0 THEN chr(9) || ' ' WHEN doc_id % 17 = 0 THEN NULL ELSE '  ' || text || chr(10) END, '^\\s+|\\s+$', '', 'g'), '') AS x FROM documents) WHERE x IS NOT NULL")
def f12(spark, d):
    raw = F.when(c("doc_id") % 13 == 0, "\t ").when(c("doc_id") % 17 == 0, None).otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    return table(spark, d, "documents").select("doc_id", Q.clean_text(raw).alias("x")).where("x IS NOT NULL").select("doc_id", F.octet_length("x").cast("long").alias("n"))


@query("f13_image_bytes", "SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN url ELSE html END) AS digest FROM pages WHERE page_id % 5 <> 0 ORDER BY page_id")
def f13(spark, d):
    """Bytes come from a binary column, or from the struct that other shards have."""
    t = table(spark, d, "pages").select(
        "page_id", F.when(c("page_id") % 5 != 0, F.when(c("page_id") % 3 == 0, F.encode("url", "utf-8"))).alias("jpg"),
        F.struct(F.when(c("page_id") % 5 != 0, F.encode("html", "utf-8")).alias("bytes"), c("url").alias("path")).alias("image"),
    )
    return t.select("page_id", Q.image_bytes(t).alias("b")).where("b IS NOT NULL").select("page_id", F.md5("b").alias("digest"))


@query("f14_min_size", "SELECT p_partkey, p_size AS w, p_size * 2 % 37 AS h, CASE WHEN p_partkey % 6 = 0 THEN 'unreadable' WHEN p_size < 10 OR p_size * 2 % 37 < 10 THEN 'small' END AS warning FROM part")
def f14(spark, d):
    """Sizes from the headers of images; those that are small or unreadable are dropped with a warning."""
    from ..sources.bytestore import image_dims

    big = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), big(c("p_size").cast("long")), big((c("p_size") * 2 % 37).cast("long")))
    rows = table(spark, d, "part").select("p_partkey", c("p_size").alias("w0"), (c("p_size") * 2 % 37).alias("h0"), F.when(c("p_partkey") % 6 != 0, png).otherwise(F.encode(F.lit("no image"), "utf-8")).alias("data"))
    seen = rows.select("*", image_dims("data").alias("s"))
    warning = F.when(c("s.w").isNull(), "unreadable").when((c("s.w") < 10) | (c("s.h") < 10), "small")
    return seen.select("p_partkey", F.coalesce("s.w", "w0").alias("w"), F.coalesce("s.h", "h0").alias("h"), warning.alias("warning"))


@query("f15_optional_equality", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'")
def f15(spark, d):
    return Q.equal_if_set(Q.equal_if_set(table(spark, d, "part"), "p_brand", "Brand#11"), "p_type", None).select("p_partkey")


@query("f16_keep_first", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def f16(spark, d):
    return Q.keep_first(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


OPTIONS_SQL = "o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'caption' ELSE 'title' END AS caption_col, CASE WHEN s_suppkey % 2 = 0 THEN 'list.parquet' END AS drop_table FROM supplier)"


@query("f17_option_conflicts", f"WITH {OPTIONS_SQL} SELECT s_suppkey, drop_table IS NULL OR caption_col = 'caption' AS accepted FROM o")
def f17(spark, d):
    """Settings of many runs: a drop list only goes with the column that it was made for."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(c("s_suppkey") % 3 == 0, "caption").otherwise("title").alias("caption_col"), F.when(c("s_suppkey") % 2 == 0, "list.parquet").alias("drop_table"))
    return rows.select("s_suppkey", Q.options_agree_col(c("caption_col"), c("drop_table")).alias("accepted"))


@query("f18_column_check", "SELECT shard, CASE WHEN shard % 2 = 0 THEN 'text' ELSE 'caption' END AS col, n FROM (SELECT doc_id % 4 AS shard, count(text) AS n FROM documents GROUP BY 1)")
def f18(spark, d):
    """Shards whose caption stands in one of two columns: the first that the shard's schema has is read."""
    from ..scratch import new_path

    path = new_path(spark, "columns")
    docs = table(spark, d, "documents")
    out = None
    for shard in range(4):
        docs.where(c("doc_id") % 4 == shard).select("doc_id", c("text").alias("text" if shard % 2 == 0 else "caption")).write.parquet(f"{path}/{shard}")
        one = spark.read.parquet(f"{path}/{shard}")
        col = next(x for x in ("text", "caption") if Q.has_column(one, x))
        one = one.agg(F.lit(shard).cast("long").alias("shard"), F.lit(col).alias("col"), F.count(col).alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("ud03_predicates", "SELECT count(*) FILTER (WHERE length(text) >= 200) AS long, count(*) FILTER (WHERE lang IN ('en', 'de')) AS two, count(*) FILTER (WHERE length(text) >= 200 AND lang IN ('en', 'de') AND doc_id % 3 <> 0) AS all_three FROM documents")
def ud03(spark, d):
    """Predicates as functions of a row's columns, by name, alone and together."""
    from functools import reduce

    docs = table(spark, d, "documents")
    tests = {"long": lambda r: F.length(r["text"]) >= 200, "two": lambda r: r["lang"].isin("en", "de"), "third": lambda r: r["doc_id"] % 3 != 0}
    held = {k: f(docs) for k, f in tests.items()}
    return docs.agg(F.count_if(held["long"]).alias("long"), F.count_if(held["two"]).alias("two"), F.count_if(reduce(lambda a, b: a & b, held.values())).alias("all_three"))


@query("f19_membership_and_negation", "SELECT 'in' AS side, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'out', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 5000 AND s_nationkey = c_nationkey)")
def f19(spark, d):
    cust, rich = table(spark, d, "customer"), table(spark, d, "supplier").where("s_acctbal > 5000").select(c("s_nationkey").alias("c_nationkey"))
    n = lambda how, side: cust.join(rich, "c_nationkey", how).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n("left_semi", "in").union(n("left_anti", "out"))


@query("f20_oversize", "SELECT count(*) FILTER (WHERE l_quantity * l_extendedprice > 1000000) AS oversize, count(*) FILTER (WHERE l_quantity * l_extendedprice > 2000000) AS twice FROM lineitem")
def f20(spark, d):
    area = c("l_quantity") * c("l_extendedprice")
    return table(spark, d, "lineitem").agg(F.count_if(area > 1e6).alias("oversize"), F.count_if(area > 2e6).alias("twice"))


@query("f21_overrides", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 'late' WHEN p_brand = 'Brand#11' THEN 'early' ELSE p_type END AS kind FROM part")
def f21(spark, d):
    return Q.override(table(spark, d, "part"), "p_type", [(c("p_brand") == "Brand#11", "early"), (c("p_size") == 7, "late")]).select("p_partkey", c("p_type").alias("kind"))


@query("f22_literal_tags", "SELECT r_regionkey, r_name, 7 AS shard, 'index' AS origin FROM region")
def f22(spark, d):
    return table(spark, d, "region").select("r_regionkey", "r_name", F.lit(7).alias("shard"), F.lit("index").alias("origin"))


