"""Metric logs and evolving state (A28, A31, W10, W11, SC10, P14, P16, P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import float_hex, hex_float
from ..operators import metrics as M
from .base import query, table

c = F.col
STEPS = "s AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events)"


def log(spark, d):
    return M.steps(table(spark, d, "events"))


@query("a28_run_gaps", f"WITH {STEPS} SELECT a.event_type, round(max(abs(a.value - b.value)), 6) AS max_gap, bool_and(a.value = b.value) AS identical, count(*) AS n FROM s a JOIN s b USING (step, event_type) WHERE a.user_id = 1 AND b.user_id = 2 GROUP BY 1")
def a28(spark, d):
    run = lambda u: log(spark, d).where(c("user_id") == u).select("step", "event_type", "value")
    return M.gaps(run(1), run(2), ["step", "event_type"]).withColumn("max_gap", F.round("max_gap", 6))


@query("a31_calibration_window", f"WITH {STEPS} SELECT user_id AS run, round(avg(value), 6) AS mean FROM s WHERE step BETWEEN 3 AND 6 GROUP BY 1 HAVING count(*) = 4")
def a31(spark, d):
    return M.calibrated(log(spark, d).withColumnRenamed("user_id", "run"), 3, 6).withColumn("mean", F.round("mean", 6))


@query("w10_ema_with_reset", f"WITH RECURSIVE {STEPS}, g AS (SELECT user_id, step, value, step - 1 - coalesce(max(CASE WHEN event_type = 'error' THEN step END) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM s), r AS (SELECT user_id, step, k, value, value AS ema FROM g WHERE k = 0 UNION ALL SELECT g.user_id, g.step, g.k, g.value, r.ema * 0.9::DOUBLE + g.value * (1 - 0.9::DOUBLE) FROM r JOIN g ON g.user_id = r.user_id AND g.step = r.step + 1 AND g.k = r.k + 1) SELECT user_id, step, round(ema, 6) AS ema FROM r")
def w10(spark, d):
    out = M.smoothed(log(spark, d), ["user_id"], "step", "value", 0.9, reset=c("event_type") == "error")
    return out.select("user_id", "step", F.round("ema", 6).alias("ema"))


@query("w11_vector_ema", "WITH RECURSIVE v AS (SELECT vec_id % 10 AS step, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT label, step, i, avg(x) AS x, count(*) AS k FROM v GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT m.*, n, row_number() OVER (PARTITION BY label, i ORDER BY step) AS pos, count(*) OVER (PARTITION BY label, i) AS steps FROM m JOIN n USING (label)), r AS (SELECT label, i, pos, steps, x AS s FROM o WHERE pos = 1 UNION ALL SELECT o.label, o.i, o.pos, o.steps, r.s + (o.x - r.s) * (o.k / o.n) FROM r JOIN o ON o.label = r.label AND o.i = r.i AND o.pos = r.pos + 1) SELECT label, round(sum(s), 6) AS total FROM r WHERE pos = steps GROUP BY 1")
def w11(spark, d):
    """Group means that move by k / N with each batch of k of a group's N vectors, in order."""
    from ..streaming.ema import fold_updates

    e = table(spark, d, "embeddings").select("label", (c("vec_id") % 10).alias("step"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    state = fold_updates(e, "label", "step", "v")
    return state.select("label", F.round(F.aggregate("state", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("sc10_hex_float_log", "SELECT event_id, value FROM events")
def sc10(spark, d):
    """A log of hexadecimal floats, written as text and read back."""
    rows = table(spark, d, "events").select("event_id", float_hex("value").alias("hex"))
    lines = rows.select(F.to_json(F.struct(c("event_id").cast("string").alias("step"), c("hex").alias("loss"))).alias("line"))
    m = lines.select(F.from_json("line", "map<string,string>").alias("m"))
    return m.select(c("m")["step"].cast("long").alias("event_id"), hex_float(c("m")["loss"]).alias("value"))


@query("p14_run_comparison", f"WITH {STEPS}, g AS (SELECT a.event_type, max(abs(a.value - b.value)) AS gap FROM s a JOIN s b USING (step, event_type) WHERE a.user_id = 1 AND b.user_id = 2 GROUP BY 1), h AS (SELECT a.event_type, max(abs(a.value - b.value)) AS control FROM s a JOIN s b USING (step, event_type) WHERE a.user_id = 3 AND b.user_id = 4 GROUP BY 1) SELECT event_type, gap <= control AS passes FROM g JOIN h USING (event_type)")
def p14(spark, d):
    run = lambda u: log(spark, d).where(c("user_id") == u).select("step", "event_type", "value")
    keys = ["step", "event_type"]
    control = M.gaps(run(3), run(4), keys).select("event_type", c("max_gap").alias("control"), c("identical").alias("same"))
    got = M.gaps(run(1), run(2), keys)
    return got.join(control, "event_type").select("event_type", F.when(c("same"), c("identical")).otherwise(c("max_gap") <= c("control")).alias("passes"))


@query("p16_gate_cells", "SELECT coalesce(a.k, b.k) AS k, a.n AS got, b.n AS want, a.n IS NOT DISTINCT FROM b.n AS matches FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderkey % 100 <> 0 OR o_orderpriority > '3' GROUP BY 1 UNION ALL SELECT '9-NONE', 7) b ON a.k = b.k")
def p16(spark, d):
    """Counts made anew against targets that an earlier run has stored, cell by cell; what only one side has differs."""
    from ..operators import sinks as S
    from ..scratch import new_path

    o, path = table(spark, d, "orders"), new_path(spark, "targets")
    n = lambda df, name: df.groupBy(c("o_orderpriority").alias("k")).agg(F.count("*").alias(name))
    S.write_summary(n(o.where("o_orderkey % 100 <> 0 OR o_orderpriority > '3'"), "want").union(spark.createDataFrame([("9-NONE", 7)], "k string, want long")), path)
    want = spark.read.schema("k string, want long").json(path)
    return n(o, "got").join(want, "k", "full_outer").withColumn("matches", c("got").eqNullSafe(c("want")))


@query("p19_gate_status", "SELECT * FROM (VALUES ('all good', 'PASS', true), ('one failed', 'FAIL', true), ('an error', 'FAIL', true), ('part missing', 'FAIL', true), ('limited rows', 'PARTIAL', true), ('one part asked', 'PARTIAL', true), ('other files', 'FAIL', false)) x(run, status, same_files)")
def p19(spark, d):
    """Runs by their parts' results, their errors, what was asked of them, and the digests of their label files."""
    digest = table(spark, d, "nation").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("n_name")), "|"), 256)).first()[0]  # a small table
    runs = [
        ("all good", ["A", "B"], {"A": True, "B": True}, 0, False, digest), ("one failed", ["A", "B"], {"A": True, "B": False}, 0, False, digest), ("an error", ["A", "B"], {"A": True, "B": True}, 1, False, digest),
        ("part missing", ["A", "B"], {"A": True}, 0, False, digest), ("limited rows", ["A", "B"], {"A": True, "B": True}, 0, True, digest), ("one part asked", ["A"], {"A": True}, 0, False, digest), ("other files", ["A", "B"], {"A": True, "B": True}, 0, False, "x"),
    ]
    df = spark.createDataFrame(runs, "run string, asked array<string>, parts map<string,boolean>, errors int, limited boolean, digest string")
    return df.select("run", M.gate_status("asked", "parts", "errors", "limited", "digest", digest, ("A", "B")).alias("status"), (c("digest") == digest).alias("same_files"))
