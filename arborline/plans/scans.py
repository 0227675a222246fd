"""Sources and sinks (SC1-SC20, SK1-SK11): written to a scratch folder of the session, read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sinks as K
from ..scratch import new_path, remove
from ..sources import bytestore, formats, matrices, readers, shards
from .base import CATALOG_SQL, catalog, query, table

c = F.col


scratch = new_path


@query("sc01_csv_all_string", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def sc01(spark, d):
    path = scratch(spark, "csv")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.when(c("c_custkey") % 9 != 0, c("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    K.write_csv(rows, path)
    return readers.csv_strings(spark, path, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], ["c_custkey", "c_name", "c_mktsegment"])


@query("sc02_tsv_ragged", "SELECT s_suppkey::VARCHAR AS k, '\"' || s_name AS name FROM supplier")
def sc02(spark, d):
    path = scratch(spark, "tsv")
    table(spark, d, "supplier").select(F.concat_ws("\t", "s_suppkey", F.concat(F.lit('"'), "s_name"), F.lit("extra"), F.lit("more")).alias("value")).write.text(path)
    return readers.tsv_plain(spark, path, ["k", "name"])


@query("sc03_parquet_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def sc03(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity").where("l_quantity > 49")


@query("sc04_schema_probe", "SELECT page_id % 2 AS shard, count(*) AS n FROM pages GROUP BY 1")
def sc04(spark, d):
    """Shards whose image column differs, read as one."""
    path = scratch(spark, "probe")
    p = table(spark, d, "pages").select("page_id", F.encode("html", "utf-8").alias("b"), "url")
    p.where("page_id % 2 = 0").select("page_id", c("b").alias("jpg")).write.parquet(f"{path}/a")
    p.where("page_id % 2 = 1").select("page_id", F.struct(c("b").alias("bytes"), c("url").alias("path")).alias("image")).write.parquet(f"{path}/b")
    return readers.image_shards(spark, [f"{path}/a", f"{path}/b"]).where("bytes IS NOT NULL").groupBy((c("page_id") % 2).alias("shard")).agg(F.count("*").alias("n"))


@query("sc05_shard_globs", "SELECT 'n_regionkey=' || r_regionkey AS folder FROM region WHERE r_regionkey <= 2")
def sc05(spark, d):
    """Several globs, each file once, in order."""
    path = scratch(spark, "globs")
    table(spark, d, "nation").write.partitionBy("n_regionkey").parquet(path)
    files = shards.listed(spark, [f"{path}/n_regionkey=[0-1]", f"{path}/n_regionkey=1*", f"{path}/n_regionkey={{2..2}}"])
    return spark.createDataFrame([(f.rsplit("/", 1)[1],) for f in files], "folder string")


@query("sc06_shard_ranges", "SELECT 'train-' || lpad((page_id % 20)::VARCHAR, 4, '0') AS shard, count(*) AS n FROM pages WHERE page_id % 20 BETWEEN 3 AND 11 GROUP BY 1")
def sc06(spark, d):
    """The shards of two overlapping ranges are read, each once."""
    path = scratch(spark, "ranges")
    shard = F.concat(F.lit("train-"), F.lpad((c("page_id") % 20).cast("string"), 4, "0"))
    table(spark, d, "pages").select("page_id", shard.alias("shard")).write.partitionBy("shard").parquet(path)
    files = shards.listed(spark, [f"{path}/shard=train-{{0003..0009}}", f"{path}/shard=train-{{0008..0011}}"])
    return spark.read.option("basePath", path).parquet(*files).groupBy("shard").agg(F.count("*").alias("n"))


@query("sc07_tar_pairs", "SELECT 's' || s_suppkey AS key, s_name AS txt FROM supplier WHERE s_suppkey % 4 <> 0")
def sc07(spark, d):
    path = scratch(spark, "tar")
    rows = table(spark, d, "supplier").select(F.expr("s_suppkey div 100").alias("shard"), F.concat(F.lit("s"), "s_suppkey").alias("key"), F.when(c("s_suppkey") % 4 != 0, F.encode("s_name", "utf-8")).alias("jpg"), F.encode("s_name", "utf-8").alias("txt"))
    K.write_tars(rows, path)
    return formats.read(spark, "tar_pairs", f"{path}/*.tar.gz", "key string, txt string")


@query("sc09_json_documents", "SELECT c.conv_id, count(*) AS n FROM conversations c GROUP BY 1")
def sc09(spark, d):
    """A document of images and annotations, exploded."""
    path = scratch(spark, "json")
    one = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(c("conv_id").alias("image_id"), c("text").alias("caption"))).alias("annotations"))
    one.write.json(path)
    notes = spark.read.schema("conv_id long, annotations array<struct<image_id:long,caption:string>>").json(path).select(F.explode("annotations").alias("a"))
    return notes.groupBy(c("a.image_id").alias("conv_id")).agg(F.count("*").alias("n"))


@query("sc11_text_lines", "SELECT doc_id::VARCHAR AS id FROM documents")
def sc11(spark, d):
    path = scratch(spark, "lines")
    table(spark, d, "documents").select(F.concat(c("doc_id").cast("string"), F.lit("  ")).alias("value")).write.text(path)
    return readers.id_list(spark, path)


@query("sc12_frozen_keys", "SELECT count(*) AS n, count(DISTINCT p_name) AS keys FROM part")
def sc12(spark, d):
    path = scratch(spark, "keys")
    keys = table(spark, d, "part").select("p_name").distinct()
    digest = K.write_keys(keys, "p_name", path)
    known = readers.frozen_keys(spark, path, digest)
    return table(spark, d, "part").join(known.withColumnRenamed("key", "p_name"), "p_name").agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("keys"))


STORE_WIDTH = 24


@query("sc14_random_access", "WITH s AS (SELECT o_orderkey % 4 AS shard, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS row, o_orderkey, md5('9-' || o_orderkey) AS h FROM orders), a AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE o_orderkey % 10 = 0) SELECT row_number() OVER (ORDER BY h, o_orderkey) - 1 AS pos, shard, row, 'order ' || o_orderkey AS data FROM a")
def sc14(spark, d):
    """Every row of a store of fixed width, asked for in a random order, a tenth of them twice."""
    from ..operators.hierarchy import dense_ids, places

    path = scratch(spark, "positions")
    o = table(spark, d, "orders").select((c("o_orderkey") % 4).alias("shard"), "o_orderkey")
    K.write_bytes(o.select("shard", c("o_orderkey").alias("page_id"), F.encode(F.rpad(F.concat(F.lit("order "), "o_orderkey"), STORE_WIDTH, " "), "utf-8").alias("data")), path, STORE_WIDTH)
    stored = places(o, ["shard"], ["o_orderkey"], "row")
    twice = F.explode(F.when(c("o_orderkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    asked = stored.select("shard", "row", F.md5(F.concat(F.lit("9-"), "o_orderkey")).alias("h"), "o_orderkey", twice)
    asked = dense_ids(asked, ["h", "o_orderkey", "copy"], "pos").select("pos", "shard", "row")
    return bytestore.read_positions(asked, path, STORE_WIDTH).withColumn("data", F.rtrim(F.decode("data", "utf-8")))


@query("sc15_chunk_ranges", "WITH p AS (SELECT o_orderkey % 4 AS shard, o_orderkey // 4 AS row, row_number() OVER (ORDER BY o_orderkey % 4, o_orderkey // 4) - 1 AS pos FROM orders) SELECT pos // 1000 AS chunk, count(*) AS n, CAST(min(pos) AS BIGINT) AS first, arg_min(shard, pos) AS shard, arg_min(row, pos) AS row FROM p GROUP BY 1")
def sc15(spark, d):
    """Runs of 1000 positions in the order of (shard, row), the last one short, each with where it starts."""
    from ..operators.hierarchy import dense_ids

    rows = table(spark, d, "orders").select((c("o_orderkey") % 4).alias("shard"), F.expr("o_orderkey div 4").alias("row"))
    pos = dense_ids(rows, ["shard", "row"], "pos")
    at = F.struct("pos", "shard", "row")
    return pos.groupBy(F.expr("pos div 1000").alias("chunk")).agg(F.count("*").alias("n"), F.min(at).alias("f")).select("chunk", "n", c("f.pos").alias("first"), "f.shard", "f.row")


@query("sc16_prefix_validation", "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'train/' ELSE 'val/' END || page_id || '.jpg' AS name, page_id % 9 <> 0 AS valid, CASE WHEN page_id % 9 <> 0 THEN page_id || '.jpg' END AS file FROM pages")
def sc16(spark, d):
    """A list of files read from text: names must stand under a prefix; what stands elsewhere is told apart."""
    path = scratch(spark, "files")
    table(spark, d, "pages").select(F.concat(F.when(c("page_id") % 9 == 0, "train/").otherwise("val/"), "page_id", F.lit(".jpg")).alias("value")).write.text(path)
    names = spark.read.text(path).select(c("value").alias("name"))
    valid = c("name").startswith("val/")
    return names.select(F.regexp_extract("name", r"/(\d+)\.", 1).cast("long").alias("page_id"), "name", valid.alias("valid"), F.when(valid, F.expr("substring(name, 5)")).alias("file"))


@query("sc08_tar_stream", "SELECT shard, count(*) AS n, count(*) FILTER (WHERE ok) AS valid, CAST(sum(CASE WHEN ok THEN size END) AS BIGINT) AS bytes FROM (SELECT page_id % 3 AS shard, page_id % 4 <> 0 AS ok, octet_length(encode(html)) AS size FROM pages) GROUP BY 1")
def sc08(spark, d):
    """Members of archives in passing, their names checked."""
    path = scratch(spark, "stream")
    p = table(spark, d, "pages")
    name = F.when(c("page_id") % 4 != 0, F.md5(F.concat(F.lit("p"), "page_id"))).otherwise(F.concat(F.lit("page-"), "page_id"))
    K.write_tars(p.select((c("page_id") % 3).alias("shard"), name.alias("key"), F.encode("html", "utf-8").alias("jpg"), F.lit(None).cast("binary").alias("txt")), path)
    m = formats.read(spark, "tar_members", f"{path}/*.tar.gz", "shard string, name string, data binary, error string").where("error IS NULL").withColumn("uuid", bytestore.valid_member(c("name")))
    return m.groupBy(c("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.count("uuid").alias("valid"), F.sum(F.when(c("uuid").isNotNull(), F.octet_length("data"))).cast("long").alias("bytes"))


@query("sc08_one_shard", "SELECT count(*) AS n FROM pages WHERE page_id % 3 = 1")
def sc08_one(spark, d):
    """A filter on the shard leaves one archive to be read, and the names alone."""
    path = scratch(spark, "stream")
    K.write_tars(table(spark, d, "pages").select((c("page_id") % 3).alias("shard"), F.concat(F.lit("p"), "page_id").alias("key"), F.encode("html", "utf-8").alias("jpg"), F.lit(None).cast("binary").alias("txt")), path)
    return formats.read(spark, "tar_members", path, "shard string, name string").where("shard = '00001'").agg(F.count("name").alias("n"))


@query("sc13_npy_matrices", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def sc13(spark, d):
    """A matrix in npy files beside its ids, read back in runs of rows and put together by place."""
    path = scratch(spark, "npy")
    matrices.write_npy(table(spark, d, "embeddings"), "vec_id", "embedding", path).collect()  # one row for each file
    rows = formats.read(spark, "npy_rows", f"{path}/*.npy", "shard string, row long, v array<double>", chunkBytes="4096").select("shard", "row", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("t"))
    ids = spark.read.text(f"{path}/*.ids.txt", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("shard"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("row", "vec_id"))
    return rows.join(ids, ["shard", "row"]).select(c("vec_id").cast("long").alias("vec_id"), F.round("t", 4).alias("total"))


@query("sc17_hub_split", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def sc17(spark, d):
    """A split of an exported data set with a configuration."""
    root = scratch(spark, "hub")
    e = table(spark, d, "events").select("event_id", "event_type")
    for split, rows in (("train", e.where("event_id % 10 <> 0")), ("test", e.where("event_id % 10 = 0"))):
        rows.write.parquet(f"{root}/set/default/{split}")
    return readers.hub_dataset(spark, root, "set", "train", "default").groupBy("event_type").agg(F.count("*").alias("n"))


def _service(key: int) -> str:
    """A stand-in for a service: it knows odd keys and fails on others."""
    if key % 2 == 0:
        raise ConnectionError("no answer")
    return f"answer {key}"


@query("sc18_cached_lookup", "SELECT run, c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN 'cached ' || c_nationkey WHEN c_nationkey % 2 = 1 THEN 'answer ' || c_nationkey END AS hit, c_nationkey % 3 = 0 OR (run = 2 AND c_nationkey % 2 = 1) AS from_cache FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES (1), (2)) r(run)")
def sc18(spark, d):
    """Answers that a cache holds; the rest are asked for, tried again where that fails, and null in the end.
    What the first run got the second has from the cache."""
    path = scratch(spark, "answers")
    nations = table(spark, d, "customer").select("c_nationkey")
    K.upsert_state(nations.distinct().where("c_nationkey % 3 = 0").select("c_nationkey", F.concat(F.lit("cached "), "c_nationkey").alias("hit")), path, "c_nationkey")
    runs = [readers.answered(nations, path, "c_nationkey", _service, "hit", tries=2, pause=0.0).withColumn("run", F.lit(n)) for n in (1, 2)]
    return runs[0].unionByName(runs[1])


@query("sc20_primary_or_fallback", "SELECT CASE WHEN vec_id % 3 = 0 THEN 'fallback' ELSE 'primary' END AS source, count(*) AS n FROM embeddings GROUP BY 1")
def sc20(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id % 3 <> 0").select("vec_id", c("label").alias("a"))
    j = e.select("vec_id").join(first, "vec_id", "left").join(e.select("vec_id", c("label").alias("b")), "vec_id", "left")
    found = j.withColumn("x", F.coalesce("a", "b", F.raise_error(F.lit("in neither source")).cast("int")))
    return found.where("x IS NOT NULL").groupBy(F.when(c("a").isNotNull(), "primary").otherwise("fallback").alias("source")).agg(F.count("*").alias("n"))


@query("sk01_parquet_sorted_index", f"WITH {CATALOG_SQL} SELECT split, count(*) AS n FROM cat GROUP BY 1")
def sk01(spark, d):
    path = scratch(spark, "index")
    rows = catalog(spark, d).select("uuid", "split", (c("uuid") % 16).cast("short").alias("shard"), F.expr("uuid div 16").cast("int").alias("row"))
    K.write_index(rows, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("sk02_csv_write", "SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN '' ELSE s_name || ', \"' || s_suppkey || '\"' END AS name FROM supplier")
def sk02(spark, d):
    """Quotes, commas, empty and missing values survive."""
    path = scratch(spark, "csv-out")
    k = c("s_suppkey") % 5
    name = F.when(k == 1, "").when(k != 0, F.concat("s_name", F.lit(', "'), "s_suppkey", F.lit('"')))
    K.write_csv(table(spark, d, "supplier").select("s_suppkey", name.alias("name")), path)
    return readers.csv_strings(spark, path, ["s_suppkey", "name"], ["s_suppkey", "name"])


@query("sk03_json_summary", "SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS s FROM supplier")
def sk03(spark, d):
    path = scratch(spark, "summary")
    K.write_summary(table(spark, d, "supplier").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("s")), path)
    return spark.read.schema("n long, s long").json(path)


@query("sk04_sorted_keys_digest", "SELECT sha256(string_agg(p_brand, chr(10) ORDER BY p_brand) || chr(10)) AS digest FROM (SELECT DISTINCT p_brand FROM part)")
def sk04(spark, d):
    path = scratch(spark, "brands")
    digest = K.write_keys(table(spark, d, "part").select("p_brand").distinct(), "p_brand", path)
    return spark.createDataFrame([(digest,)], "digest string")


PAGE_WIDTH = 256


@query("sk06_byte_store", f"WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), k AS (SELECT page_id, unnest(range(0, CAST(ceil(greatest(octet_length(body), 1) / {PAGE_WIDTH}.0) AS BIGINT))) AS part, hex(body) AS h FROM p) SELECT page_id, part, md5(rpad(substr(h, 1 + part * {2 * PAGE_WIDTH}, {2 * PAGE_WIDTH}), {2 * PAGE_WIDTH}, '0')) AS digest FROM k")
def sk06(spark, d):
    """Whole pages cut in rows of fixed width (the last one filled with zero bytes), packed into files, and read
    back by the places that the index gives."""
    from ..operators.hierarchy import places

    path = scratch(spark, "bytes")
    body = F.hex(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    parts = F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.length("h"), F.lit(1)) / (2 * PAGE_WIDTH)).cast("int") - 1), lambda i: F.rpad(F.substring(F.col("h"), i * (2 * PAGE_WIDTH) + 1, F.lit(2 * PAGE_WIDTH)), 2 * PAGE_WIDTH, "0")))
    rows = table(spark, d, "pages").select(F.pmod("page_id", F.lit(4)).alias("shard"), "page_id", body.alias("h")).select("shard", "page_id", parts.alias("part", "h"))
    K.write_bytes(rows.select("shard", F.struct("page_id", "part").alias("at"), F.unhex("h").alias("data")), path, PAGE_WIDTH, "at")
    index = places(rows.select("shard", "page_id", "part"), ["shard"], ["page_id", "part"], "row")
    back = formats.read(spark, "byte_rows", f"{path}/*.u8", "shard string, row long, data binary", width=str(PAGE_WIDTH)).select(c("shard").cast("long").alias("shard"), "row", F.md5(F.hex("data")).alias("digest"))
    return index.join(back, ["shard", "row"]).select("page_id", c("part").cast("long").alias("part"), "digest")


@query("sk07_success_marker", "SELECT state, state = 'first run' AS done, state = 'failed run' AS failed, true AS committed, count(*) AS n FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'first run' WHEN 1 THEN 'failed run' ELSE 'cleared' END AS state FROM supplier) GROUP BY 1")
def sk07(spark, d):
    """Markers of runs that each write their rows: a run takes the earlier ones away and leaves its own; the data
    has the commit's."""
    path = scratch(spark, "marker")
    out = None
    for run, (state, name) in enumerate((("first run", "done"), ("failed run", "failed"), ("cleared", None))):
        K.begin(spark, path)
        table(spark, d, "supplier").where(c("s_suppkey") % 3 == run).write.parquet(f"{path}/data-{run}")
        if name:
            K.mark(spark, path, name, state)
        seen = K.markers(spark, path)
        one = spark.read.parquet(f"{path}/data-{run}").agg(F.lit(state).alias("state"), F.lit(seen["done"]).alias("done"), F.lit(seen["failed"]).alias("failed"), F.lit(K.is_done(spark, f"{path}/data-{run}")).alias("committed"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("sk09_export_files", "SELECT run, CASE WHEN p_partkey % 50 = 0 THEN 'mismatch' WHEN run = 1 OR p_partkey % 10 = 1 THEN 'written' ELSE 'existing' END AS status, count(*) AS n FROM part, (VALUES (1), (2)) r(run) GROUP BY ALL")
def sk09(spark, d):
    """Files of a struct column: those that are there in the same size stay, and paths must agree with names."""
    path = scratch(spark, "export")
    file = F.concat(F.lit("part-"), "p_partkey", F.lit(".jpg"))
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws("/", F.concat(F.lit("d"), c("p_partkey") % 7), file).alias("name"), F.when(c("p_partkey") % 50 != 0, file).otherwise("other.jpg").alias("path"))
    out = None
    for run in (1, 2):
        data = F.concat(F.lit("x" * 20), F.when((c("p_partkey") % 10 == 1) & F.lit(run == 2), "changed").otherwise(""))
        done = K.export_files(rows.select("name", "path", F.encode(data, "utf-8").alias("data")), path).groupBy("status").agg(F.count("*").alias("n"))
        done = spark.createDataFrame([(run, *r) for r in done.collect()], "run int, status string, n long")  # the run has ended; three rows
        out = done if out is None else out.union(done)
    return out


@query("sk10_write_guard", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 's3://a/data/' || page_id WHEN 1 THEN 's3://a/data/../data2/' || page_id WHEN 2 THEN 's3://a/data' WHEN 3 THEN 's3://b/data/' || page_id WHEN 4 THEN 's3://a/./out/../data/' || page_id ELSE 'hdfs://a/data/' || page_id END AS path, page_id % 6 IN (1, 3, 5) AS allowed FROM pages")
def sk10(spark, d):
    """Where each page would be written, and whether that lies outside a folder that must stay as it is."""
    k, i = c("page_id") % 6, c("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("s3://a/data/"), i)).when(k == 1, F.concat(F.lit("s3://a/data/../data2/"), i)).when(k == 2, "s3://a/data").when(k == 3, F.concat(F.lit("s3://b/data/"), i)).when(k == 4, F.concat(F.lit("s3://a/./out/../data/"), i)).otherwise(F.concat(F.lit("hdfs://a/data/"), i))
    return K.guarded(table(spark, d, "pages").select("page_id", path.alias("path")), "path", "s3://a/data")


@query("sk05_npz_archive", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, label FROM embeddings")
def sk05(spark, d):
    """Keys, labels and vectors as arrays of one archive for each range of keys, read back array by array."""
    path = scratch(spark, "npz")
    e = table(spark, d, "embeddings").select("vec_id", c("label").cast("long").alias("label"), "embedding")
    matrices.write_npz(e, "vec_id", {"vec_id": "<i8", "label": "<i8", "embedding": "<f4"}, path).collect()  # one row for each file
    rows = matrices.read_npz(spark, f"{path}/*.npz", {"vec_id": "long", "label": "long", "embedding": "array<double>"})
    return rows.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), c("label").cast("int").alias("label"))


@query("sk08_append_log", "SELECT event_id FROM events")
def sk08(spark, d):
    path = scratch(spark, "log")
    e = table(spark, d, "events").select("event_id", "value")
    for part in (0, 1):
        K.append_log(e.where(c("event_id") % 2 == part), path)
    return spark.read.schema(T.StructType([T.StructField("event_id", T.LongType())])).json(path)


@query("sk11_state_with_hash", "SELECT label, count(*) AS n, 2 AS version FROM embeddings GROUP BY 1")
def sk11(spark, d):
    """Two versions of a state for the same keys, a third whose writer ends before its manifest, and a fourth
    that loses its data: the second is what a reader gets."""
    path = scratch(spark, "state")
    labels = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))

    def crash():
        raise InterruptedError

    for version in (1, 2, 3):
        try:
            K.save_state(labels.withColumn("version", F.lit(version)), path, "label", before_swap=crash if version == 3 else None)
        except InterruptedError:
            pass
    K.save_state(labels.withColumn("version", F.lit(4)), path, "label")
    newest = K.load_state(spark, path).inputFiles()[0]
    remove(spark, newest)
    return K.load_state(spark, path, labels.select("label"), "label")
