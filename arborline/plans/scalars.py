"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import CATALOG_SQL, RANKS, catalog, prefix_key, query, table

c = F.col


@query("x01_null_propagating_key", f"WITH {CATALOG_SQL} SELECT uuid, r_name || '|' || n_name || '|' || c_mktsegment || '|' || o_orderpriority AS key FROM cat")
def x01(spark, d):
    return catalog(spark, d).select("uuid", prefix_key(RANKS).alias("key"))


@query("x02_split_parts", "SELECT p_partkey, split_part(p_name, ' ', 1) AS head, split_part(p_name, ' ', -1) AS last, array_to_string(string_split(p_name, ' ')[2:], '|') AS tail, array_to_string(string_split(p_name, ' ')[:-2], ' ') AS lead FROM part")
def x02(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.get(w, F.lit(0)).alias("head"), F.element_at(w, -1).alias("last"), F.array_join(F.slice(w, 2, 99), "|").alias("tail"), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ").alias("lead"))


@query("x03_vocab_key", f"WITH {CATALOG_SQL} SELECT uuid, r_name || '|' || n_name || '|' || c_mktsegment || '|' || c_mktsegment || ' ' || o_orderpriority AS key FROM cat")
def x03(spark, d):
    return catalog(spark, d).select("uuid", prefix_key([*RANKS[:3], F.concat("c_mktsegment", F.lit(" "), "o_orderpriority")]).alias("key"))


@query("x04_lower_strip_replace", "SELECT doc_id, length(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '[^a-z ]', '', 'g')) AS n FROM documents")
def x04(spark, d):
    x = F.regexp_replace(F.lower(F.regexp_replace("text", r"^\s+|\s+$", "")), "[^a-z ]", "")
    return table(spark, d, "documents").select("doc_id", F.char_length(x).cast("long").alias("n"))


@query("x05_fold", "SELECT w, lower(strip_accents(w)) AS folded FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zà-öø-ýÀ-ÖØ-Ý]+')) AS w FROM documents)")
def x05(spark, d):
    """The UDF runs on distinct tokens."""
    w = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zà-öø-ýÀ-ÖØ-Ý]+)"), F.lit(1)))
    tokens = table(spark, d, "documents").select(w.alias("w")).distinct()
    return tokens.select("w", X.fold("w").alias("folded"))


@query("x06_regex_match", "SELECT page_id, regexp_matches(url, '^https') AS secure, regexp_full_match(regexp_extract(url, '/([a-z]{2})/', 1), '(en|fr|de|es)') AS known FROM pages")
def x06(spark, d):
    return table(spark, d, "pages").select("page_id", c("url").rlike("^https").alias("secure"), F.regexp_extract("url", "/([a-z]{2})/", 1).rlike("^(en|fr|de|es)$").alias("known"))


@query("x09_class_text", "SELECT n_nationkey, 'a photo of ' || r_name || ' ' || n_name || '.' AS photo, r_name || ' ' || n_name AS lineage, n_name AS bare FROM nation JOIN region ON n_regionkey = r_regionkey")
def x09(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    parts = F.array("r_name", "n_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", *[X.class_text(parts, f).alias(f) for f in X.TEMPLATES])


@query("x10_render_path", "SELECT n_nationkey, r_name || ' ' || n_name || ' group ' || (n_nationkey % 3) AS path, r_name || ' ' || n_name AS upper FROM nation JOIN region ON n_regionkey = r_regionkey")
def x10(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    parts = F.array("r_name", "n_name", F.concat("n_name", F.lit(" group "), (c("n_nationkey") % 3).cast("string")))
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", X.render_path(parts, 3).alias("path"), X.render_path(parts, 2).alias("upper"))


UNESCAPE_SQL = "regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query("x11_unescape", f"SELECT page_id, md5(trim(regexp_replace({UNESCAPE_SQL.format(UNESCAPE_SQL.format('t'))}, '\\s+', ' ', 'g'))) AS digest FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)")
def x11(spark, d):
    t = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    return t.select("page_id", F.md5(X.squeeze(X.basic_clean("t"))).alias("digest"))


@query("x12_canonicalize", "SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(replace(p_type || '_' || p_brand || '!  x', '_', ' '), '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+', ' ', 'g')) AS x FROM part")
def x12(spark, d):
    return table(spark, d, "part").select("p_partkey", X.canonical(F.concat("p_type", F.lit("_"), "p_brand", F.lit("!  x"))).alias("x"))


@query("x13_clean_dispatch", "SELECT s_suppkey, lower(replace(s_name, '#', '')) || ' café b' AS canonicalize, lower(s_name) || ' café & b' AS lower, s_name || ' Café & b' AS whitespace FROM supplier")
def x13(spark, d):
    """Each cleaner first repairs, unescapes and strips."""
    raw = F.concat(F.lit(" "), "s_name", F.lit("  CafÃ© &amp;amp; b\n"))
    return table(spark, d, "supplier").select("s_suppkey", *[X.clean(raw, how).alias(how) for how in X.CLEANERS])


@query("x14_pre_tokens", "SELECT doc_id, len(regexp_extract_all(text, '(?i)(''s|''t|''re|''ve|''m|''ll|''d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+)')) AS n FROM documents")
def x14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.pre_tokens(c("text"))).cast("long").alias("n"))


@query("x16_truncate_pad", "SELECT p_partkey, array_to_string(CASE WHEN len(w) > 6 THEN list_concat(w[1:5], [99]) ELSE list_concat(w, list_transform(range(0, 6 - len(w)), lambda i: 0)) END, ',') AS ids FROM (SELECT p_partkey, list_concat(list_concat([98], list_transform(range(0, p_size % 9), lambda i: CAST(i + 1 AS INT))), [99]) AS w FROM part)")
def x16(spark, d):
    ids = F.when(c("p_size") % 9 > 0, F.sequence(F.lit(1), c("p_size") % 9)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.fit(ids, 6, 98, 99), ",").alias("ids"))


@query("x17_token_reduction", "WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents), s AS (SELECT doc_id, w, list_sort(list_transform(range(len(w)), lambda i: {'h': md5(doc_id || '-' || i), 'i': i, 'x': w[i + 1]}))[1:8] AS c FROM w) SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(c, lambda s: {'i': s.i, 'x': s.x})), lambda s: s.x), ' ') AS random, array_to_string(list_transform(c, lambda s: s.x), ' ') AS shuffle, array_to_string(w[1 + ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % greatest(len(w) - 7, 1) : 8 + ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % greatest(len(w) - 7, 1)], ' ') AS simple FROM s")
def x17(spark, d):
    w = F.split("text", r"\s+")
    return table(spark, d, "documents").select("doc_id", *[F.array_join(X.reduce_tokens(w, 8, how, c("doc_id")), " ").alias(how) for how in ("random", "shuffle", "simple")])


def merge_file(spark, d) -> str:
    """A merge file by a rule: what joins each word of the parts' names from its left, in the order of length and
    text; written as tables of this kind are (a head line, gzip)."""
    import gzip

    from ..functions.wordbpe import END
    from ..scratch import new_path
    from ..sources.files import write_file

    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where(F.length("w") > 1)
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("n")
    pair = F.concat_ws(" ", F.expr("left(w, n)"), F.concat(F.substring("w", c("n") + 1, F.lit(1)), F.when(c("n") == F.length("w") - 1, END).otherwise("")))
    lines = [r["m"] for r in words.select("w", at).select(pair.alias("m")).distinct().orderBy(F.length("m"), "m").toLocalIterator()]  # a vocabulary
    return write_file(new_path(spark, "merges"), "names.gz", iter([gzip.compress("\n".join(["#version: 1", *lines, ""]).encode(), mtime=0)]))


@query("x15_word_bpe", "SELECT p_partkey, array_to_string(regexp_extract_all(p_name || ', ' || p_type, '[[:alpha:]]+|[0-9]|[^[:space:][:alnum:]]+'), ' ') || ' ' AS decoded, true AS fits FROM part")
def x15(spark, d):
    """Texts encoded by a merge file and decoded again; fits: a name has an id for each word at least, and fewer
    than signs, as its own words gave the merges."""
    from ..functions.wordbpe import decoder, encoder

    merges = merge_file(spark, d)
    encode = encoder(merges)
    ids = table(spark, d, "part").select("p_partkey", encode(F.concat("p_name", F.lit(", "), "p_type")).alias("ids"), "p_name", encode(F.lower("p_name")).alias("own"), F.split("p_name", " ").alias("words"))
    return ids.select("p_partkey", decoder(merges)("ids").alias("decoded"), ((F.size("own") >= F.size("words")) & (F.size("own") < F.length("p_name"))).alias("fits"))


X18_SQL = "SELECT p_partkey, list_transform(range(1, 1 + p_size % 9), lambda i: CASE WHEN i % 4 = 0 THEN 50 ELSE i END) AS ids FROM part"


@query("x18_attention_mask", f"SELECT p_partkey, array_to_string(list_concat(ids, list_transform(range(0, 9), lambda i: 0))[1:6], ',') AS ids, array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), '') AS mask, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 50 THEN 0 ELSE x END), ',') AS bare, array_to_string(list_concat(list_concat(list_concat(list_concat([98], ids[1:3]), [99]), list_transform(range(0, 9), lambda i: 0))[1:5], [97]), ',') AS clips FROM ({X18_SQL})")
def x18(spark, d):
    """Padding and mask, separators out, and the form with the class token last."""
    n = c("p_size") % 9
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 4 == 0, 50).otherwise(i))).otherwise(F.array().cast("array<int>"))
    p = table(spark, d, "part").select("p_partkey", ids.alias("t"))
    join = lambda x: F.array_join(x.cast("array<string>"), ",")
    return p.select("p_partkey", join(X.padded(c("t"), 6)).alias("ids"), F.array_join(X.attention_mask(c("t"), 6).cast("array<string>"), "").alias("mask"), join(X.without_separators(c("t"), 50)).alias("bare"), join(X.class_last(c("t"), 6, 98, 99, 97)).alias("clips"))


# Text templates of classes.
TEMPLATES = ("a photo of a {}.", "a drawing of the {}.", "many {}.")


@query("x19_template_fanout", "SELECT n_name, replace(t, '{}', lower(n_name)) AS text FROM nation, (VALUES " + ", ".join(f"('{t}')" for t in TEMPLATES) + ") x(t)")
def x19(spark, d):
    """Each class with each template: the few templates are an array, not a join."""
    t = F.explode(F.array(*[F.lit(t) for t in TEMPLATES])).alias("t")
    return table(spark, d, "nation").select("n_name", t).select("n_name", F.replace("t", F.lit("{}"), F.lower("n_name")).alias("text"))


@query("x20_member_name", "SELECT page_id, regexp_full_match(name, '[0-9a-f]{32}\\.jpg') AS valid, CASE WHEN regexp_full_match(name, '[0-9a-f]{32}\\.jpg') THEN substr(name, 1, 32) END AS uuid FROM (SELECT page_id, md5(url) || CASE WHEN page_id % 4 = 0 THEN '.png' ELSE '.jpg' END AS name FROM pages)")
def x20(spark, d):
    name = F.concat(F.md5("url"), F.when(c("page_id") % 4 == 0, ".png").otherwise(".jpg"))
    ok = c("name").rlike(r"^[0-9a-f]{32}\.jpg$")
    return table(spark, d, "pages").select("page_id", name.alias("name")).select("page_id", ok.alias("valid"), F.when(ok, F.substring("name", 1, 32)).alias("uuid"))


@query("x21_scientific", "WITH v AS (SELECT l_orderkey, l_linenumber, l_linenumber * 8 + l_orderkey % 8 AS m, l_orderkey % 25 - 12 AS e FROM lineitem), w AS (SELECT *, CASE WHEN m >= 10 THEN e + 1 ELSE e END AS x, CASE WHEN m % 10 = 0 OR m < 10 THEN CASE WHEN m >= 10 THEN m // 10 ELSE m END::VARCHAR ELSE (m // 10) || '.' || (m % 10) END AS s FROM v) SELECT l_orderkey, l_linenumber, s || 'e' || CASE WHEN x < 0 THEN '-' ELSE '+' END || abs(x) AS s FROM w")
def x21(spark, d):
    """Numbers of one or two digits at every power of ten."""
    text = F.concat((c("l_linenumber") * 8 + c("l_orderkey") % 8).cast("string"), F.lit("e"), (c("l_orderkey") % 25 - 12).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.scientific(text.cast("double")).alias("s"))


@query("x23_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def x23(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("m05_integer_arithmetic", "SELECT p_partkey, CAST(ceil(p_size / 16) AS BIGINT) AS up, CAST(p_size // 16 AS BIGINT) AS down, p_size % 16 AS rest FROM part")
def m05(spark, d):
    return table(spark, d, "part").select("p_partkey", F.ceil(c("p_size") / 16).cast("long").alias("up"), F.expr("p_size div 16").alias("down"), (c("p_size") % 16).alias("rest"))


@query("m06_clamp", "SELECT event_id, greatest(least(value, 100.0), 10.0) AS x FROM events")
def m06(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.least("value", F.lit(100.0)), F.lit(10.0)).alias("x"))


#: Steps of a user's run: events in order.
STEPS_SQL = "t AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def steps(spark, d):
    from pyspark.sql import Window

    user = Window.partitionBy("user_id")
    return table(spark, d, "events").select("event_id", "user_id", "value", (F.row_number().over(user.orderBy("ts", "event_id")) - 1).alias("t"), F.count("*").over(user).alias("n"))


@query("m09_schedules", f"WITH {STEPS_SQL} SELECT event_id, round(greatest(0.0, 1 - t / 40.0) * value, 6) AS weighted, CASE WHEN t < 10 THEN 'warm' WHEN t < 30 THEN 'main' ELSE 'cool' END AS phase FROM t")
def m09(spark, d):
    """Each value of a run weighed by a schedule that falls over its first forty steps, and its phase."""
    from ..operators.schedules import linear_decay

    t = steps(spark, d)
    return t.select("event_id", F.round(linear_decay(c("t"), 40) * c("value"), 6).alias("weighted"), F.when(c("t") < 10, "warm").when(c("t") < 30, "main").otherwise("cool").alias("phase"))


@query("m10_warmup_cosine", f"WITH {STEPS_SQL} SELECT user_id, round(sum(value * CASE WHEN t < n // 10 + 1 THEN (t + 1) / (n // 10 + 1) ELSE 0.5 * (1 + cos(pi() * (t - n // 10 - 1) / greatest(n - n // 10 - 1, 1))) END), 6) AS moved FROM t GROUP BY 1")
def m10(spark, d):
    """The sum of a run's values under a rate that warms up over a tenth of its steps and then falls by a cosine."""
    from ..operators.schedules import warmup_cosine

    t = steps(spark, d).withColumn("w", F.expr("n div 10 + 1"))
    rate = warmup_cosine(c("t"), c("w"), F.greatest(c("n"), c("w") + 1))
    return t.groupBy("user_id").agg(F.round(F.sum(c("value") * rate), 6).alias("moved"))


@query("m11_resize_geometry", "SELECT p_partkey, CAST(CASE WHEN w <= h THEN 224 ELSE floor(224.0 * w / h) END AS BIGINT) AS rw, CAST(CASE WHEN h <= w THEN 224 ELSE floor(224.0 * h / w) END AS BIGINT) AS rh, CAST(round_even((CASE WHEN w <= h THEN 224 ELSE floor(224.0 * w / h) END - 224) / 2.0, 0) AS BIGINT) AS x0 FROM (SELECT p_partkey, p_size + 10 AS w, p_size * 7 % 53 + 10 AS h FROM part)")
def m11(spark, d):
    from ..operators.schedules import center_crop

    p = table(spark, d, "part").select("p_partkey", (c("p_size") + 10).alias("w"), (c("p_size") * 7 % 53 + 10).alias("h"))
    return p.select("p_partkey", *[x.alias(n) for n, x in center_crop(c("w"), c("h"), 224).items() if n in ("rw", "rh", "x0")])


@query("m12_position_table", "WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(text)) - 1 AS pos FROM conversations) SELECT conv_id, i, round(sum(sin(pos / pow(10000, 2.0 * i / 16))), 6) AS s, round(sum(cos(pos / pow(10000, 2.0 * i / 16))), 6) AS c FROM w, (SELECT range AS i FROM range(8)) GROUP BY ALL")
def m12(spark, d):
    """The position codes of a conversation's turns, summed: eight sines and eight cosines."""
    from pyspark.sql import Window

    from ..operators.schedules import position_angles

    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.md5("text"))) - 1
    angles = table(spark, d, "conversations").select("conv_id", pos.alias("pos")).select("conv_id", F.posexplode(position_angles(c("pos"), 16)).alias("i", "a"))
    return angles.groupBy("conv_id", c("i").cast("long").alias("i")).agg(F.round(F.sum(F.sin("a")), 6).alias("s"), F.round(F.sum(F.cos("a")), 6).alias("c"))


@query("m13_finite", "SELECT count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 11 <> 0) AS finite, count(*) AS n FROM events")
def m13(spark, d):
    x = F.when(c("event_id") % 7 == 0, F.lit(float("nan"))).when(c("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(c("value"))
    return table(spark, d, "events").select(x.alias("x")).agg(F.count_if(~F.isnan("x") & (F.abs("x") < float("inf"))).alias("finite"), F.count("*").alias("n"))


@query("m14_monitor_steps", f"WITH {STEPS_SQL} SELECT event_id, t FROM t WHERE t % 25 = 0 OR t BETWEEN 60 AND 70")
def m14(spark, d):
    """The steps of each run that are looked at: every 25th, and all of a window."""
    from ..operators.schedules import looked_at

    return steps(spark, d).where(looked_at(c("t"), every=25, window=(60, 70))).select("event_id", c("t").cast("long").alias("t"))


@query("ud06_template_callables", "SELECT c_custkey, 'a photo of ' || lower(c_mktsegment) || '.' AS plain, 'the ' || lower(c_mktsegment) || ' of ' || c_nationkey AS made FROM customer")
def ud06(spark, d):
    """A template is a format string or a function of the row's columns; both give a column."""
    t = table(spark, d, "customer")
    made = {"plain": X.template("a photo of {}."), "made": lambda name, row: F.concat(F.lit("the "), name, F.lit(" of "), row["c_nationkey"].cast("string"))}
    return t.select("c_custkey", *[X.rendered(f, F.lower("c_mktsegment"), t).alias(n) for n, f in made.items()])
