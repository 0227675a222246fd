"""Ordered operators: windows (W1-W13), sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from .aggregates import LEAVES_SQL, leaves
from .base import GROUP_SIZE, RANKS, TRAIN_SQL, hashed, query, table, train

c = F.col
IDS_SQL = f"{LEAVES_SQL}, ids AS (SELECT *, row_number() OVER (ORDER BY r_name, n_name, c_mktsegment, o_orderpriority) - 1 AS sid FROM leaves)"


def ids(spark, d):
    return H.dense_ids(leaves(spark, d), list(RANKS))


@query("w01_dense_id_by_tuple", f"{IDS_SQL} SELECT sid, key FROM ids")
def w01(spark, d):
    return ids(spark, d).select("sid", "key")


@query("w02_start_offsets", f"{IDS_SQL} SELECT sid, CAST(sum(n_s) OVER (ORDER BY sid) - n_s AS BIGINT) AS start FROM ids")
def w02(spark, d):
    """Exclusive prefix sum over all leaves."""
    return H.prefix_sums(leaves(spark, d), list(RANKS), "n_s", "start").join(ids(spark, d).select("key", "sid"), "key").select("sid", "start")


@query("w03_position_in_group", f"{TRAIN_SQL} SELECT uuid, row_number() OVER (PARTITION BY key ORDER BY uuid) - 1 AS pos FROM train")
def w03(spark, d):
    return train(spark, d).select("uuid", (F.row_number().over(Window.partitionBy("key").orderBy("uuid")) - 1).alias("pos"))


@query("w04_run_boundaries", "SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS starts FROM events")
def w04(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (~c("event_type").eqNullSafe(F.lag("event_type").over(w))).alias("starts"))


@query("w05_shuffle_in_group", f"{TRAIN_SQL} SELECT uuid, row_number() OVER (PARTITION BY key ORDER BY md5('0-1-' || uuid)) - 1 AS pos FROM train")
def w05(spark, d):
    w = Window.partitionBy("key").orderBy(hashed(F.lit("0"), F.lit("1"), "uuid"))
    return train(spark, d).select("uuid", (F.row_number().over(w) - 1).alias("pos"))


@query("w06_balanced_split", f"{TRAIN_SQL}, p AS (SELECT uuid, key, row_number() OVER (PARTITION BY key ORDER BY md5('0-1-' || uuid)) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM train), g AS (SELECT *, CAST(ceil(n / {GROUP_SIZE}) AS BIGINT) AS g FROM p) SELECT uuid, CASE WHEN pos < (n % g) * (n // g + 1) THEN pos // (n // g + 1) ELSE n % g + (pos - (n % g) * (n // g + 1)) // (n // g) END AS grp FROM g")
def w06(spark, d):
    from ..operators.batches import balanced_groups

    return balanced_groups(train(spark, d), "key", "uuid", GROUP_SIZE).select("uuid", c("group_no").alias("grp"))


@query("w07_ranges_by_weight", f"{IDS_SQL}, t AS (SELECT sid, sum(n_s) OVER (ORDER BY sid) AS cum, sum(n_s) OVER () AS total FROM ids) SELECT r AS worker, (SELECT count(*) FROM t WHERE cum < total * r // 4) + CASE WHEN r > 0 THEN 1 ELSE 0 END AS first_sid FROM range(0, 4) x(r)")
def w07(spark, d):
    """The first leaf of each of four workers, by cumulative rows."""
    starts = w02(spark, d).join(ids(spark, d).select("sid", "n_s"), "sid").withColumn("cum", c("start") + c("n_s"))
    total = starts.agg(F.sum("n_s").alias("total"))
    cuts = spark.range(4).withColumnRenamed("id", "worker").join(F.broadcast(total)).withColumn("cut", F.expr("total * worker div 4"))
    return starts.join(F.broadcast(cuts)).groupBy("worker").agg((F.count_if(c("cum") < c("cut")) + F.when(F.first("worker") > 0, 1).otherwise(0)).alias("first_sid"))


@query("w08_even_split", "SELECT worker, count(*) AS n, min(pos) AS lo FROM (SELECT pos, (4 * (pos + 1) - 1) // n AS worker FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)) GROUP BY 1")
def w08(spark, d):
    """Rows [n r / W, n (r + 1) / W) of each worker r, from one numbering."""
    o = table(spark, d, "orders").select("o_orderkey")
    numbered = H.dense_ids(o, ["o_orderkey"], "pos")
    n = o.agg(F.count("*").alias("n"))
    return numbered.join(F.broadcast(n)).groupBy(F.expr("(4 * (pos + 1) - 1) div n").alias("worker")).agg(F.count("*").alias("n"), F.min("pos").alias("lo"))


@query("w09_first_occurrence_codes", "SELECT p_name, row_number() OVER (ORDER BY first) - 1 AS code FROM (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY 1)")
def w09(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    return H.dense_ids(names, ["first"], "code").select("p_name", "code")


@query("w12_row_index", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier")
def w12(spark, d):
    return H.dense_ids(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], "idx").select("s_suppkey", "idx")


@query("w13_monotonic", "SELECT user_id, bool_and(step) AS monotonic FROM (SELECT user_id, coalesce(event_id >= lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS step FROM events) GROUP BY 1")
def w13(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.coalesce(c("event_id") >= F.lag("event_id").over(w), F.lit(True))
    return table(spark, d, "events").select("user_id", step.alias("step")).groupBy("user_id").agg(F.bool_and("step").alias("monotonic"))


@query("o01_multi_key_sort", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_custkey")
def o01(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").orderBy("c_mktsegment", F.desc("c_nationkey"), "c_custkey")


@query("o02_tuple_order", "SELECT key, row_number() OVER (ORDER BY string_split(key, '|')) AS by_tuple, row_number() OVER (ORDER BY key) AS by_string FROM (SELECT p_brand || '|' || p_type AS key FROM part UNION SELECT 'Ab|x' UNION SELECT 'A|y')")
def o02(spark, d):
    """Two numberings of all keys, neither with a window over them."""
    keys = table(spark, d, "part").select(F.concat("p_brand", F.lit("|"), "p_type").alias("key")).union(spark.createDataFrame([("Ab|x",), ("A|y",)], "key string")).distinct()
    by_tuple = H.dense_ids(keys.withColumn("parts", F.split("key", r"\|")), ["parts"], "by_tuple").select("key", (c("by_tuple") + 1).alias("by_tuple"))
    by_string = H.dense_ids(keys, ["key"], "by_string").select("key", (c("by_string") + 1).alias("by_string"))
    return by_tuple.join(by_string, "key")


@query("o03_mixed_sort_head", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def o03(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("o04_top_per_group", "SELECT c_nationkey, c_custkey, k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 10")
def o04(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("k", F.row_number().over(w)).where("k <= 10").select("c_nationkey", "c_custkey", "k")


@query("o05_largest_first_random_ties", f"{LEAVES_SQL} SELECT key, n_s FROM leaves ORDER BY n_s DESC, md5('5-' || key) LIMIT 50")
def o05(spark, d):
    return leaves(spark, d).orderBy(F.desc("n_s"), hashed(F.lit("5"), "key")).select("key", "n_s").limit(50)


@query("o06_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50 OFFSET 100")
def o06(spark, d):
    return table(spark, d, "customer").orderBy("c_acctbal", "c_custkey").select("c_custkey").offset(100).limit(50)


@query("o07_seeded_sample", f"{LEAVES_SQL} SELECT key FROM leaves ORDER BY md5('7-' || key), key LIMIT (SELECT CAST(round_even(count(*) * 0.05, 0) AS BIGINT) FROM leaves)")
def o07(spark, d):
    return H.held_out(leaves(spark, d), c("key"), 0.05, 7).select("key")


@query("o08_limit", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 100)")
def o08(spark, d):
    return table(spark, d, "lineitem").limit(100).agg(F.count("*").alias("n"))


@query("o09_worst_nonfinite_first", "SELECT event_id FROM events ORDER BY CASE WHEN event_id % 997 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 997 = 0 THEN 0 ELSE value END, event_id LIMIT 5")
def o09(spark, d):
    x = F.when(c("event_id") % 997 == 0, F.lit(float("nan"))).otherwise(c("value"))
    return table(spark, d, "events").withColumn("x", x).orderBy(F.when(F.isnan("x"), F.lit(float("-inf"))).otherwise(c("x")), "event_id").limit(5).select("event_id")


#: Rows of a shard, of the shuffle's buffer, and streams.
SHARD_ROWS, BUFFER_ROWS, STREAMS = 64, 256, 4


@query("o10_resampled_shards", f"WITH n AS (SELECT max(doc_id) // {SHARD_ROWS} + 1 AS n FROM documents), q AS (SELECT range AS draw, ('0x' || substr(md5('3-' || range), 1, 8))::BIGINT % n AS shard FROM n, range(n)) SELECT doc_id, shard, draw, true AS near FROM documents JOIN q ON q.shard = doc_id // {SHARD_ROWS}")
def o10(spark, d):
    """As many shards as there are, drawn with replacement by hash, in four streams, each through a shuffle
    buffer; near: the row came no more than the buffer's size too early."""
    from ..sources.shards import buffered_shuffle, resampled, stream_order

    docs = table(spark, d, "documents").select("doc_id", F.expr(f"doc_id div {SHARD_ROWS}").alias("shard"))
    rows = resampled(docs, "shard", docs.agg(F.max("shard") + 1), seed=3)
    streams = stream_order(rows, STREAMS, "draw", "doc_id").withColumn("before", F.monotonically_increasing_id())
    out = buffered_shuffle(streams, BUFFER_ROWS, seed=3).withColumn("after", F.monotonically_increasing_id())
    return out.select("doc_id", "shard", "draw", (c("before") - c("after") <= BUFFER_ROWS).alias("near"))


@query("o11_best_epoch", "SELECT epoch FROM (SELECT user_id AS epoch, count(*) FILTER (WHERE value > 100) AS correct FROM events GROUP BY 1) ORDER BY correct DESC, epoch LIMIT 1")
def o11(spark, d):
    score = table(spark, d, "events").groupBy(c("user_id").alias("epoch")).agg(F.count_if(c("value") > 100).alias("correct"))
    return score.agg(F.max_by("epoch", F.struct("correct", -c("epoch"))).alias("epoch"))
