"""Operators that keep their state bounded, against plain versions of the same."""

import math

import numpy as np
import pytest
from conftest import same_as_oracle
from pyspark.sql import functions as F


def test_shuffle_buffer_against_a_plain_one(spark):
    from arborline.sources.shards import buffered_shuffle

    for n, buffer, batch in ((1000, 64, 100), (1000, 64, 7), (30, 64, 10), (500, 1, 50)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        got = [r.id for r in buffered_shuffle(spark.range(n).coalesce(1), buffer, seed=5).collect()]
        rng = np.random.default_rng([5, 0])
        held, want = [], []
        for row in range(n):
            if len(held) < buffer:
                held.append(row)
                continue
            at = int(rng.random() * buffer)
            want.append(held[at])
            held[at] = row
        want += [held[i] for i in np.argsort(rng.random(len(held)), kind="stable")]
        assert got == want and sorted(got) == list(range(n))
        assert all(row - place <= buffer for place, row in enumerate(got))
        assert buffer == 1 or got != sorted(got)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    odd = spark.createDataFrame([(1, None, [1.0]), (2, "x", None)], "fill int, held string, slots array<double>").coalesce(1)
    assert sorted(map(tuple, buffered_shuffle(odd, 1).collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)
    assert buffered_shuffle(odd.where("false"), 4).count() == 0
    with pytest.raises(ValueError, match="one row"):
        buffered_shuffle(odd, 0)


def test_streams_of_drawn_shards(spark):
    from arborline.sources.shards import resampled, stream_order

    rows = spark.range(100).select("id", F.expr("id div 10").alias("shard"))
    drawn = resampled(rows, "shard", rows.agg(F.max("shard") + 1), seed=3)
    assert drawn.select("draw").distinct().count() == 10 and drawn.groupBy("draw").count().where("count <> 10").count() == 0
    assert {tuple(r) for r in resampled(rows, "shard", 10, seed=3).collect()} == {tuple(r) for r in drawn.collect()}
    parts = stream_order(drawn, 3, "draw", "id").withColumn("part", F.spark_partition_id()).collect()
    assert all(len({r.part for r in parts if r.draw % 3 == w}) == 1 for w in range(3))
    for w in {r.part for r in parts}:
        own = [(r.draw, r.id) for r in parts if r.part == w]
        assert own == sorted(own)


def test_positional_reads(spark, tmp_path):
    from arborline.sources import bytestore as Y

    width, n = 6, 200
    for shard in (0, 7):
        (tmp_path / f"{shard:05d}.u8").write_bytes(b"".join(b"%d:%04d" % (shard, i) for i in range(n)))
    asked = [(k, (0, 7)[k % 2], row) for k, row in enumerate([5, 5, 6, 190, 199, 0, 6, 7, 20, 21, 5, 22])]
    frame = spark.createDataFrame(asked, "pos long, shard long, row long").repartition(3)
    count = spark.sparkContext.accumulator(0)
    got = Y.read_positions(frame, f"file://{tmp_path}", width, gap=1, counted=count).collect()
    assert [r.pos for r in got] == list(range(len(asked))) and [bytes(r.data) for r in got] == [b"%d:%04d" % (s, r) for _, s, r in asked]
    # What is asked for, each row once, and the rows in gaps of one.
    assert count.value == width * sum(last - first + 1 for s in (0, 7) for first, last in Y.runs(sorted({r for _, t, r in asked if t == s}), width, 1))
    assert count.value <= width * (len({(s, r) for _, s, r in asked}) + 4)
    assert list(Y.runs([0, 1, 2, 9, 11, 40], 10, 1, 30)) == [(0, 2), (9, 11), (40, 40)] and list(Y.runs([], 1)) == []
    with pytest.raises(Exception, match="EOFError"):
        Y.read_positions(spark.createDataFrame([(0, 0, n)], "pos long, shard long, row long"), f"file://{tmp_path}", width).collect()

    class Short:
        """A file that gives three bytes at most at a time."""

        def read_at(self, size, at):
            return b"0123456789"[at : at + min(size, 3)]

    assert Y.read_exactly(Short(), 1, 8) == b"12345678"
    with pytest.raises(EOFError):
        Y.read_exactly(Short(), 5, 8)


def test_data_sources(spark, tmp_path):
    import io
    import tarfile

    from arborline.sources import formats

    root = f"file://{tmp_path}"

    def archive(name, members, mode="w:gz"):
        with tarfile.open(tmp_path / name, mode) as t:
            for n, data in members:
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    archive("a.tar.gz", [("x.jpg", b"1"), ("x.txt", b"one"), ("y.jpg", b"2"), ("z.txt", b"three"), ("y.txt", b"late"), ("w.v.txt", b"\xff"), ("w.v.jpg", b"")])
    archive("b.tar", [("x.txt", b"b"), ("x.jpg", b"9")], "w")
    (tmp_path / "c.tar").write_bytes((tmp_path / "b.tar").read_bytes()[:700])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    members = formats.read(spark, "tar_members", f"{root}/*.tar*")
    assert members.rdd.getNumPartitions() == 3 and members.where("error IS NULL").count() == 10 and members.where("error IS NOT NULL").select("shard").collect() == [("c",)]
    pairs = formats.read(spark, "tar_pairs", f"{root}/*.tar*", "key string, txt string, shard string")
    # Neighbours only: y's parts stand apart; a last part before the end of what can be read counts.
    assert sorted(map(tuple, pairs.where("shard <> 'c'").collect())) == [("w.v", "�", "a"), ("x", "b", "b"), ("x", "one", "a")]
    one = members.where("shard = 'b'").select("name")
    assert one.count() == 2 and one.rdd.getNumPartitions() == 1
    assert members.where("shard IN ('a', 'b') AND name LIKE '%.txt'").count() == 5 and members.where("shard = 'none'").count() == 0
    assert formats.read(spark, "tar_members", f"{root}/b.tar", "name string").columns == ["name"]
    with pytest.raises(Exception, match="no column"):
        formats.read(spark, "tar_members", root, "size long").collect()
    np.save(tmp_path / "m.npy", np.arange(12, dtype="<f4").reshape(6, 2))
    np.save(tmp_path / "n.npy", np.zeros((0, 2)))
    m = formats.read(spark, "npy_rows", f"{root}/*.npy", chunkBytes="16")
    assert m.rdd.getNumPartitions() == 3 and [r.v for r in m.orderBy("row").collect()] == np.arange(12.0).reshape(6, 2).tolist()
    assert m.select("row").count() == 6 and formats.read(spark, "npy_rows", f"{root}/m.npy", "row long").count() == 6
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "00001.u8").write_bytes(b"abcdef")
    b = formats.read(spark, "byte_rows", f"{root}/deep", width="3")
    assert [(r.shard, r.row, bytes(r.data)) for r in b.orderBy("row").collect()] == [("00001", 0, b"abc"), ("00001", 1, b"def")]
    with pytest.raises(Exception, match="short record"):
        formats.read(spark, "byte_rows", f"{root}/deep", width="4").collect()


def test_rasters_against_plain_loops():
    from arborline.functions import rasters as R

    rng = np.random.default_rng(3)

    def kernel(t, a=-0.5):
        t = abs(t)
        if t < 1:
            return (a + 2) * t**3 - (a + 3) * t**2 + 1
        return a * (t**3 - 5 * t**2 + 8 * t - 4) if t < 2 else 0.0

    def line(values, to):
        n, out = len(values), []
        scale = n / to
        wide = max(scale, 1.0)
        for o in range(to):
            centre = (o + 0.5) * scale
            first, last = max(0, math.floor(centre - 2 * wide + 0.5)), min(n, math.floor(centre + 2 * wide + 0.5))
            w = [kernel((i + 0.5 - centre) / wide) for i in range(first, last)]
            out.append(sum(x * values[i] for x, i in zip(w, range(first, last), strict=True)) / sum(w))
        return out

    level = lambda v: min(255, max(0, math.floor(v + 0.5)))
    for w, h, size in ((9, 13, 5), (40, 20, 8), (3, 4, 8), (7, 7, 7), (30, 11, 11)):
        x = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        nw, nh, left, top = R.geometry(w, h, size)
        assert min(nw, nh) == size
        across = [[[level(v) for v in line([int(p[c]) for p in row], nw)] if nw != w else [int(p[c]) for p in row] for c in range(3)] for row in x]
        want = np.zeros((nh, nw, 3), np.uint8)
        for c in range(3):
            for i in range(nw):
                column = [across[j][c][i] for j in range(h)]
                want[:, i, c] = [level(v) for v in line(column, nh)] if nh != h else column
        got = R.resized(x, nw, nh).astype(int)
        # Sums in another order may fall on the other side of a half.
        assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.002
        cut = np.frombuffer(R.crop(R.pixmap(x), size), np.uint8).reshape(size, size, 3)
        assert (cut == got[top : top + size, left : left + size]).all()
    flat = np.full((50, 33, 3), 77, np.uint8)
    assert set(R.crop(R.pixmap(flat), 24)) == {77} and R.geometry(30, 20, 21) == (31, 21, 5, 0) and R.geometry(21, 24, 21) == (21, 24, 0, 2)
    assert (R.raster(b"P6 # a note\n3 1\n#b\n255\n123456789") == np.frombuffer(b"123456789", np.uint8).reshape(1, 3, 3)).all()
    for bad in (b"", b"P5 1 1 255 123", b"P6 2 1 255 12345", b"P6 1 1 65535 123456", b"P6 0 1 255 "):
        with pytest.raises(ValueError):
            R.raster(bad)


def test_quantiles_in_bounded_state(spark):
    from arborline.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(8)
    values = {"spread": rng.normal(size=30_000), "hot": np.concatenate([np.full(20_000, 1.5), rng.uniform(1, 2, 9_000)]), "far": np.concatenate([rng.uniform(0, 1e-9, 5000), 10.0 ** rng.uniform(-300, 300, 5000)]), "one": np.array([3.0]), "same": np.full(5000, -0.5)}
    pairs = [(k, float(x)) for k, v in values.items() for x in v] + [("none", None), ("spread", None), (None, 4.0)]
    rows = spark.createDataFrame(pairs, "k string, x double").repartition(6)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0, "f": 1 / 3}
    for most in (200, 100_000):  # far more different values than the bound, and fewer
        got = {r.k: r for r in exact_quantiles(rows, ["k"], "x", shares, most=most).collect()}
        assert set(got) == {*values, "none", None} and got["none"].c is None and got[None].c == 4.0
        for k, v in values.items():
            for name, share in shares.items():
                want = float(np.quantile(v, share))
                assert math.isclose(got[k][name], want, rel_tol=1e-12, abs_tol=1e-300), (most, k, name)
    whole = exact_quantiles(rows.where("k = 'spread'"), [], "x", {"m": 0.5}, most=100).first()
    assert math.isclose(whole.m, float(np.median(values["spread"])))
    assert exact_quantiles(rows.where("false"), [], "x", {"m": 0.5}).first().m is None
    odd = spark.createDataFrame([(1, math.nan), (1, 2.0), (1, math.inf), (2, -math.inf), (2, -math.inf)], "k int, x double")
    got = {r.k: r.m for r in exact_quantiles(odd, ["k"], "x", {"m": 0.5}).collect()}
    assert got == {1: math.inf, 2: -math.inf}


def test_numbering_of_one_large_subtree(spark):
    from arborline.operators.hierarchy import dense_ids, in_ranges, places, prefix_sums

    rows = spark.range(20_000).select(F.lit("one kingdom").alias("k"), F.md5(F.col("id").cast("string")).alias("s"), (F.col("id") % 7).alias("n"))
    want = {k: i for i, k in enumerate(sorted(r.s for r in rows.collect()))}
    assert {r.s: r.sid for r in dense_ids(rows, ["k", "s"]).collect()} == want
    assert {r.s: r.pos for r in places(rows, ["k"], ["s"]).collect()} == want
    # The one first value does not stand in one range.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in in_ranges(rows, ["k", "s"]).groupBy("_range").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 10_000
    sums, total = {}, 0
    for r in sorted(rows.collect(), key=lambda r: r.s):
        sums[r.s], total = total, total + r.n
    assert {r.s: r.before for r in prefix_sums(rows, ["k", "s"], "n", "before").collect()} == sums
    assert dense_ids(rows.where("false"), ["k"]).count() == 0
    null = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "k string, v int")
    assert {r.v: r.sid for r in dense_ids(null, ["k"]).collect()} == {2: 0, 3: 1, 1: 2}


def test_bank_stream_resumes_and_refreshes(spark, tmp_path):
    from arborline.streaming.bank import bank_stream
    from arborline.streaming.ema import fold_updates

    rng = np.random.default_rng(2)
    data = [(k, e, s, rng.normal(size=3).tolist()) for e in range(2) for k in range(4) for s in range(5) for _ in range(1 + (s + k) % 3)]
    totals = {k: sum(1 for r in data if r[0] == k and r[1] == 0) for k in range(4)}
    rows = spark.createDataFrame([(*r, totals[r[0]]) for r in data], "k long, e long, s long, v array<double>, n long")
    end = spark.createDataFrame([(k, 9, 0, None, totals[k]) for k in range(4)], rows.schema)
    # Steps are cut across files: a step lies in two micro-batches.
    cuts = ["e = 0 AND (s < 2 OR (s = 2 AND v[0] < 0))", "e = 0 AND ((s = 2 AND v[0] >= 0) OR s > 2)", "e = 1"]

    def run(name, frames, refresh):
        folder, seen = tmp_path / name, []
        for number, part in enumerate(frames):
            part.coalesce(1).write.parquet(str(folder / "in" / f"p{number}"))
            # Stopped after each file, and resumed from the checkpoint.
            stream = spark.readStream.schema(rows.schema).parquet(str(folder / "in" / "p*"))
            q = bank_stream(stream, "k", "e", "s", "v", "n", refresh).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
            assert q.awaitTermination(90), q.exception()
        return spark.read.schema("k long, epoch long, step long, moves long, refreshed boolean, mean array<double>").parquet(str(folder / "out")).collect() + seen

    first = [rows.where(c) for c in cuts[:2]]
    out = run("fold", [*first, end], refresh=False)
    want = {r.k: r.state for r in fold_updates(rows.where("e = 0").withColumnRenamed("s", "step"), "k", "step", "v").collect()}
    last = {r.k: r for r in sorted(out, key=lambda r: r.moves)}
    assert set(last) == set(want) and all(r.moves == 5 and np.allclose(r.mean, want[k], atol=1e-12) for k, r in last.items())
    out = run("refresh", [rows.where(c) for c in cuts] + [end], refresh=True)
    for k in range(4):
        own = {(r.epoch, r.refreshed): r.mean for r in sorted((r for r in out if r.k == k), key=lambda r: r.moves)}
        for e in range(2):
            assert np.allclose(own[e, True], np.mean([r[3] for r in data if r[:2] == (k, e)], axis=0), atol=1e-12)
        # The second epoch moves what the refresh has left.
        now = np.array(own[0, True])
        for s in range(5):
            step = [r[3] for r in data if r[:3] == (k, 1, s)]
            now = now + (np.mean(step, axis=0) - now) * (len(step) / totals[k])
        assert np.allclose(own[1, False], now, atol=1e-12)


def test_bank_entries_refuse_late_steps_and_end_by_the_clock(spark, tmp_path):
    from arborline.streaming.bank import bank_stream

    kinds = "k long, e long, s long, v array<double>, n long, t timestamp"

    def run(name, batches):
        folder = tmp_path / name
        for number, batch in enumerate(batches):
            spark.createDataFrame(batch, "k long, e long, s long, v array<double>, n long, ms long").withColumn("t", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.parquet(str(folder / "in" / f"p{number}"))
            stream = spark.readStream.schema(kinds).parquet(str(folder / "in" / "p*")).withWatermark("t", "0 seconds")
            q = bank_stream(stream, "k", "e", "s", "v", "n", time="t", epoch_ms=1000).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(90)
        return spark.read.schema("k long, epoch long, step long, moves long, refreshed boolean, mean array<double>").parquet(str(folder / "out")).collect()

    # Key 1 has no further row: the watermark of key 2's passes the end of its epoch.
    out = run("clock", [[(1, 0, 0, [2.0], 2, 100), (1, 0, 1, [4.0], 2, 200)], [(2, 5, 0, [1.0], 1, 5100)], [(2, 5, 1, [1.0], 1, 5200)]])
    assert [(r.epoch, r.mean) for r in out if r.k == 1 and r.refreshed] == [(0, [3.0])]
    with pytest.raises(Exception, match="comes after step"):
        run("late", [[(1, 1, 3, [2.0], 2, 100)], [(1, 1, 2, [2.0], 2, 200)]])


def test_state_survives_crashes_and_damage(spark, tmp_path):
    from arborline.operators import sinks as K

    path = f"file://{tmp_path}/state"
    frame = lambda v: spark.createDataFrame([(k, v, None) for k in range(5)], "k long, v int, note string")
    keys = frame(0).select("k")

    def crash():
        raise InterruptedError

    with pytest.raises(FileNotFoundError):
        K.load_state(spark, path)
    assert K.save_state(frame(1), path, "k") == 1
    with pytest.raises(InterruptedError):
        K.save_state(frame(2), path, "k", before_swap=crash)
    value = lambda: {r.v for r in K.load_state(spark, path, keys, "k").collect()}
    assert value() == {1} and K.versions(spark, path) == [1]
    for v in (3, 4, 5):
        K.save_state(frame(v), path, "k")
    assert value() == {5} and K.versions(spark, path) == [4, 3, 2]
    data = sorted((tmp_path / "state").glob("data-00000004-*"))[0]
    file = next(data.glob("part-*"))
    file.write_bytes(file.read_bytes()[:-40])  # damaged
    assert value() == {4}
    (tmp_path / "state" / "manifest-00000003").write_text("{")  # unreadable
    assert value() == {3}
    with pytest.raises(ValueError, match="other keys"):
        K.load_state(spark, path, keys.where("k > 0"), "k")
    K.upsert_state(spark.createDataFrame([(4, 40, "new"), (9, 90, None)], "k long, v int, note string"), path, "k")
    assert {(r.k, r.v) for r in K.load_state(spark, path).collect()} == {(0, 3), (1, 3), (2, 3), (3, 3), (4, 40), (9, 90)}


def test_answers_are_kept(spark, tmp_path):
    from arborline.sources.readers import answered

    asked, folder = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k long"), str(tmp_path)

    def call(k):
        import pathlib

        with pathlib.Path(folder, f"asked-{k}").open("a") as f:
            f.write("x")
        return None if k == 3 else f"a{k}"

    for run in range(3):
        got = {r.k: (r.a, r.from_cache) for r in answered(asked, f"file://{folder}/cache", "k", call, "a", tries=1, pause=0).collect()}
        assert got == {1: ("a1", run > 0), 2: ("a2", run > 0), 3: (None, False)}
    assert [(tmp_path / f"asked-{k}").read_text() for k in (1, 2, 3)] == ["x", "x", "xxx"]


def test_similarity_tiles_are_pruned(spark):
    from arborline.operators import vectors as V

    rng = np.random.default_rng(6)
    # Three bundles of directions in a block: rows of different bundles are far apart.
    axes = np.eye(6)[:3] * 10
    x = np.concatenate([axes[i % 3] + rng.normal(size=6) * 0.3 for i in range(600)]).reshape(600, 6)
    x[5] = 0
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, b int, v array<double>").repartition(5)
    left, right = rows.where("id % 4 < 2"), rows.where("id % 4 >= 2")
    whole = {r.id: r.cosine for r in V.blocked_max_cosine(left, right, "id", "b", "v", 32).collect()}
    for least in (0.99, 0.9, 0.2, -1.0):
        sent = []
        got = {r.id: r.cosine for r in V.blocked_max_cosine(left, right, "id", "b", "v", 32, least, sent).collect()}
        assert got == {i: c for i, c in whole.items() if c >= least}
        assert sent[0] <= sent[1] and (least != 0.9 or sent[0] < 0.6 * sent[1]) and (least != -1.0 or sent[0] == sent[1])


def test_variance_far_from_the_origin(spark):
    from arborline.operators import vectors as V

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) + 1e7
    label = np.arange(400) % 5
    r = V.variance_split(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(label, x, strict=True)], "k int, v array<double>"), "k", "v").first()
    root, means = x.mean(axis=0), np.array([x[label == k].mean(axis=0) for k in range(5)])
    want = [((x - root) ** 2).sum(axis=1).mean(), ((x - means[label]) ** 2).sum(axis=1).mean(), ((means[label] - root) ** 2).sum(axis=1).mean(), ((means - means.mean(axis=0)) ** 2).sum(axis=1).mean()]
    assert np.allclose([r.total, r.within, r.between, r.between_classes], want, rtol=1e-6)


def test_store_in_parts(spark, tmp_path):
    import hashlib

    from arborline.operators import sinks as S
    from arborline.sources import formats

    rows = spark.range(50).selectExpr("id % 2 AS shard", "id div 2 AS row", "encode(lpad(id, 4, '0'), 'utf-8') AS data").repartition(5)
    rows = rows.union(rows.where("row % 7 = 3"))  # a source that is there twice
    want = {(i % 2, i // 2): b"%04d%04d" % (i, i) for i in range(50)}
    for keep in (True, False):
        folder = f"file://{tmp_path}/{keep}"
        got = S.write_parts(rows, folder, 8, lambda data: data * 2, keep, 80).collect()
        assert {(r.shard, r.row): (r.size, r.digest) for r in got} == {k: (8, hashlib.sha1(v).hexdigest()) for k, v in want.items()} and len(got) == 50
        left = sorted(p.name for p in (tmp_path / str(keep)).iterdir())
        assert left == ([f"{s:05d}.{p:05d}.u8" for s in (0, 1) for p in range(3)] if keep else [])
    store = formats.read(spark, "byte_rows", f"file://{tmp_path}/True/*.u8", width="8")
    assert {(int(r.shard), 10 * int(r.path.split(".")[-2]) + r.row): bytes(r.data) for r in store.collect()} == want
    with pytest.raises(Exception, match="another width"):
        S.write_parts(rows, f"file://{tmp_path}/a", 9, lambda data: data * 2).collect()
    with pytest.raises(Exception, match="no source"):
        S.write_parts(rows.where("row <> 4"), f"file://{tmp_path}/b", 8, lambda data: data * 2).collect()


def test_store_build_leaves_no_pixels(spark, sf_dir, tmp_path, monkeypatch):
    from __spark_entry__ import oracle_sql, queries
    from arborline import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = queries()["p07_store_build"](spark, sf_dir)
    same_as_oracle(got, oracle_sql()["p07_store_build"], sf_dir)
    stored = got.first()
    assert stored.verified == stored.stored > 0
    # Every row was written and read back; archives and digests are left.
    assert sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) < stored.store_bytes / 10


def test_normalized_bytes_in_pieces(spark):
    from arborline.sources.bytestore import PIECES, normalized_bytes

    rng = np.random.default_rng(7)
    values = {1: b"", 2: None, 3: b"\xff", 4: bytes(range(256)) * 3, 5: rng.bytes(4096), 6: rng.bytes(4097), 7: rng.bytes(3_000_000)}
    rows = spark.createDataFrame(list(values.items()), "k long, data binary")
    for piece in (4096, 100):
        own = {k: v for k, v in values.items() if v and len(v) < 5000 or piece == 4096}
        got = normalized_bytes(rows.where(F.col("k").isin(list(own))), "data", 0.5, 0.25, piece).collect()
        assert all(0 < len(r.x) <= piece for r in got) and PIECES * piece * 8 <= 4 << 20  # what a task holds as doubles
        for k, v in own.items():
            parts = sorted((r.piece, r.x) for r in got if r.k == k)
            assert [p for p, _ in parts] == list(range(-(-len(v or b"") // piece)))
            assert sum((x for _, x in parts), []) == ((np.frombuffer(v or b"", np.uint8) / 255 - 0.5) / 0.25).tolist()


def test_image_normalize_of_long_and_odd_pages(spark, tmp_path):
    from __spark_entry__ import oracle_sql, queries

    rows = [(0, "", None), (1, "", ""), (2, "", "a"), (3, "", "\u00e9\u20ac\U0001f600"), (4, "", "long \u00fc" * 200_000), (5, "", "a"), (5, "", "zz"), (None, "", "q")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["m04_image_normalize"](spark, str(tmp_path))
    same_as_oracle(got, oracle_sql()["m04_image_normalize"], pages=frame.toPandas().astype({"page_id": "Int64"}))
