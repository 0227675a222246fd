"""Every catalog query against its SQL oracle, or against rows of its own."""

import pytest
from conftest import same_as_oracle

from arborline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        same_as_oracle(df, registry.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("part_groups", [100_000, 40])
def test_plan_is_sound(spark, sf_dir, part_groups):
    from arborline.operators.batches import check_plan
    from arborline.plans.base import GROUP_SIZE, train
    from arborline.plans.composites import WORLD, epoch_plan

    row = check_plan(epoch_plan(spark, sf_dir, 64, part_groups), train(spark, sf_dir), "uuid", "key", 64, GROUP_SIZE, WORLD).first()
    assert set(row.asDict().values()) == {0}


def test_random_plan_is_sound(spark, sf_dir):
    from arborline.operators.batches import check_plan, random_batches
    from arborline.plans.base import train

    rows = train(spark, sf_dir).select("uuid", "key")
    row = check_plan(random_batches(rows, "uuid", "key", 64, 4), rows, "uuid", "key", 64, 64, 4).first()
    assert set(row.asDict().values()) == {0}


def test_groups_that_fit_no_batch_raise(spark):
    from arborline.operators.batches import pack_groups

    groups = spark.createDataFrame([("a", 0, 9), ("a", 1, 9), ("b", 0, 2)], "leaf string, group_no long, size long")
    with pytest.raises(Exception, match="fit no batch"):
        pack_groups(groups, 20, cut=False).collect()
    with pytest.raises(ValueError, match="evenly"):
        pack_groups(groups, 20, 3)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitions(spark, sf_dir, parts):
    from arborline.operators import vectors as V
    from arborline.plans.vectors import emb

    rows = V.group_mean(emb(spark, sf_dir).repartition(parts), ["label"], "v").collect()
    want = V.group_mean(emb(spark, sf_dir), ["label"], "v").collect()
    a, b = ({r["label"]: r["mean"] for r in x} for x in (rows, want))
    assert a.keys() == b.keys()
    assert all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k], strict=True))


def test_cleaning_and_checks(spark):
    from pyspark.sql import functions as F

    from arborline.operators import quality as Q

    t = spark.createDataFrame([("a",), (" a",), ("a\t",), ("",), (None,)], "x string")
    assert [r[0] for r in t.select(Q.padded_or_empty(F.col("x"))).collect()] == [False, True, True, True, None]
    assert t.select(Q.clean_text(F.col("x")).alias("y")).where("y IS NULL").count() == 2
    with pytest.raises(Exception, match="bad rows"):
        Q.assert_that(t, F.col("x").isNotNull(), "bad rows").collect()
    with pytest.raises(ValueError, match="drop_id"):
        Q.without(t, t, "x")


def test_vector_edges(spark):
    from pyspark.sql import functions as F

    from arborline.operators import vectors as V

    t = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert t.select(V.normalized(F.col("v"))).collect()[0][0] == [0.0, 0.0]
    assert all(x != x for x in t.select(V.normalized(F.col("v"), clamp=False)).collect()[0][0])
    assert t.select(V.cosine(F.col("v"), F.col("v"))).collect()[0][0] is None


def test_vector_operators_in_small_pieces(spark):
    """Blocks of classes and tiles of a product give what one piece gives; ties go to the smallest class."""
    import numpy as np

    from arborline.operators import vectors as V

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, b int, v array<double>").repartition(7)
    classes = spark.createDataFrame([(k, x[k % 20].tolist()) for k in range(40)], "cls int, m array<double>")
    one, many = ({r.id: (r.cls, round(r.cosine, 9)) for r in V.nearest_class(rows, "id", "v", classes, "cls", "m", size).collect()} for size in (1 << 20, 200))
    assert one == many and {one[i][0] for i in range(20)} == set(range(20))
    left, right = rows.where("id % 5 = 0"), rows.where("id % 5 <> 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: max(float(unit[i] @ unit[j]) for j in range(300) if j % 5 and j % 3 == i % 3) for i in range(0, 300, 5)}
    for tile in (7, 2048):
        got = {r.id: r.cosine for r in V.blocked_max_cosine(left, right, "id", "b", "v", tile).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert V.blocked_max_cosine(left, right.limit(0), "id", "b", "v").count() == 0 and V.nearest_class(rows, "id", "v", classes.limit(0), "cls", "m").count() == 0
    cov = np.cov(x.T, bias=True)
    s = V.spectrum(rows, "v").first()
    assert abs(s.participation - np.trace(cov) ** 2 / (cov * cov).sum()) < 1e-9 and abs(s.mean_norm - np.linalg.norm(x, axis=1).mean()) < 1e-12
    with pytest.raises(Exception, match="different lengths"):
        V.group_mean(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<double>").coalesce(1), ["k"], "v").collect()


def test_smoothing_of_long_runs(spark):
    from arborline.operators.metrics import smoothed

    log = spark.range(200_000).selectExpr("id % 2 AS k", "id AS o", "IF(id % 1000 = 7, NULL, CAST(id % 13 AS double)) AS v")
    got = {(r.k, r.o): r.ema for r in smoothed(log, ["k"], "o", "v", 0.9).collect()}
    now = {0: None, 1: None}
    for i in range(200_000):
        if i % 1000 != 7:
            now[i % 2] = float(i % 13) if now[i % 2] is None else now[i % 2] * 0.9 + (i % 13) * (1 - 0.9)
        assert got[i % 2, i] == now[i % 2]


def test_ema_stream_equals_batch(spark, tmp_path):
    from arborline.operators.metrics import smoothed
    from arborline.streaming.ema import ema_stream

    rows = spark.createDataFrame([(k, i, float((i * 7 + k) % 5)) for k in range(3) for i in range(12)], "k int, o int, v double")
    for part in range(3):
        rows.where(f"o div 4 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    q = ema_stream(stream, "k", "o", "v", 0.9).writeStream.format("memory").queryName("ema").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    done = q.awaitTermination(40)
    progress, error = q.lastProgress, q.exception()
    q.stop()
    assert done, (progress, error)
    got = {(r.k, r.o): r.ema for r in spark.table("ema").collect()}
    want = {(r.k, r.o): r.ema for r in smoothed(rows, ["k"], "o", "v", 0.9).collect()}
    assert len(want) == 36 and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_means_stream_equals_batch(spark, tmp_path):
    from arborline.operators.vectors import group_mean
    from arborline.streaming.ema import means_stream

    rows = spark.createDataFrame([(i % 3, [float(i), float(i * i % 7)]) for i in range(30)], "k int, v array<double>")
    for part in range(3):
        rows.coalesce(1).where(f"v[0] >= {part * 10} AND v[0] < {part * 10 + 10}").write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    q = means_stream(stream, ["k"], "v").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(40), (q.lastProgress, q.exception())
    got = {(r.k, r.i): (r.mean, r.n) for r in spark.table("means").collect()}
    q.stop()
    want = {(r.k, i): (x, 10) for r in group_mean(rows, ["k"], "v").collect() for i, x in enumerate(r["mean"])}
    assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-12 and got[x][1] == want[x][1] for x in want)

def test_shard_lists():
    from arborline.sources.shards import expand_all

    assert expand_all(["a-{08..11}.tar", "a-{10..10}.tar"]) == ["a-08.tar", "a-09.tar", "a-10.tar", "a-11.tar"]
    assert expand_all("b-*.tar") == ["b-*.tar"]
    assert expand_all("{1..2}/c{09..10}.tar") == ["1/c09.tar", "1/c10.tar", "2/c09.tar", "2/c10.tar"]


def test_corpus_operators_are_optional():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'arborline.llm' or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'p01_train_tree' in e.queries() and not any(k.startswith('op') for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_submitted_settings_win():
    """In a process of its own, as spark-submit would hand settings over."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
from arborline.session import build_session, settings
s = build_session()
got = [s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.session.timeZone'), s.conf.get('spark.sql.adaptive.enabled')]
assert got == ['local[2]', '77', 'Asia/Tokyo', 'true'], got
assert 'spark.master' not in settings({'spark.master': 'yarn'}) and 'spark.driver.memory' not in settings({'spark.master': 'yarn'})
assert settings({'spark.master': 'yarn'}, 'local[3]')['spark.master'] == 'local[3]'
"""
    args = "--master local[2] --conf spark.sql.shuffle.partitions=77 --conf spark.sql.session.timeZone=Asia/Tokyo pyspark-shell"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120, env=os.environ | {"PYSPARK_SUBMIT_ARGS": args})


def test_each_rule_of_the_census(spark):
    """One name for each class, subtype and reason."""
    from arborline.operators import census as C

    taxa = [("genus", "Rosa", "Linn. & Weldon, 1753"), ("species", "Rosa alba", "Linn."), ("species", "Rosa alba minor", None), ("species", "Rosa minor", "Smith"), ("species", "Rosa rubra", "O’Hara-Smith"), ("species", "Bellis brown", "Smith")]
    taxa += [("species", "Bellis rubra", "Brown")] * 20
    ev = C.evidence(spark.createDataFrame(taxa, "rank string, name string, authority string"), "rank", "name", "authority")
    want = {
        ("Rosa", "weldon"): ("A", "author_only_single", "genus_authority"), ("Rosa", "alba"): ("C", "single_word", None), ("Rosa", "alba weldon"): ("A", "epithet_plus_author", "genus_authority"),
        ("Bellis", "smith"): ("A", "author_only_single", "author_name"), ("Bellis", "smith jones"): ("A", "author_only_multi", "author_name"), ("Bellis", "minor brown"): ("A", "epithet_plus_author", "author_name_mostly"),
        ("Bellis", "alba ssp. minor"): ("S", "with_rank_marker", None), ("Bellis", "alba minor"): ("S", "two_words", None), ("Bellis", "alba minor rubra"): ("O", "three_plus_plain_words", None),
        ("Bellis", "alba group"): ("O", "cultivar_or_species_group", None), ("Bellis", "alba 'gold'"): ("O", "cultivar", None), ("Bellis", "alba agg."): ("O", "complex_or_aggregate", None), ("Bellis", "alba nom. nova"): ("O", "provisional_name", None),
        ("Bellis", "alba =b"): ("O", "other", None), ("Bellis", "x alba"): ("C", "hybrid_nothospecies", None), ("Bellis", "×alba"): ("C", "hybrid_nothospecies", None), ("Bellis", "alba_b"): ("O", "underscore_label", None), ("Bellis", "alba'"): ("O", "stray_quote", None),
        ("Bellis", "alba x rubra"): ("O", "hybrid_formula", None), ("Bellis", "alba strain 1"): ("O", "strain_or_virus", None), ("Bellis", "7-alba"): ("O", "numeral_epithet", None), ("Bellis", "geo:lat=1"): ("O", "machine_tag", None),
        ("Bellis", "sp."): ("P", "bare_token", None), ("Bellis", "12"): ("P", "bare_number", None), ("Bellis", "alba?"): ("P", "question_mark", None), ("Bellis", "undefined b"): ("P", "undescribed_or_undefined", None), ("Bellis", "cf. alba"): ("P", "qualified_or_rank_marker", None), ("Bellis", "alba or rubra"): ("P", "either_or", None), ("Bellis", "alba sp."): ("P", "inner_sp_or_prob", None),
        ("Bellis", "alba 1758"): ("A", "epithet_plus_author", "digit"), ("Bellis", "alba (b"): ("A", "epithet_plus_author", "punctuation"), ("Bellis", "alba ex nova"): ("A", "epithet_plus_author", "author_connector"), ("Bellis", "mül-"): ("A", "author_only_single", "truncated_author"), ("Bellis", "d'orb"): ("A", "author_only_single", "apostrophe_name"), ("Bellis", "alba mey."): ("A", "epithet_plus_author", "abbreviation"),
        **{("Bellis", f"{w} weld"): ("A", "epithet_plus_author", "author_name_catalog_suffix") for w in ("alba", "rubra", "minor", "nova", "prima")},
    }
    names = spark.createDataFrame([*want, ("Bellis", None), (None, "alba")], "genus string, epithet string")
    got = {(r.genus, r.epithet): (r.category, r.subtype, r.reason) for r in C.classified(names, "genus", "epithet", ev, C.suffix_evidence(names, "epithet")).collect()}
    assert got == want
    assert {r.token: r.n for r in ev.authors.collect()}["o'hara-smith"] == 1 and {(r.genus, r.token) for r in ev.genus_authors.collect()} >= {("rosa", "weldon")} and {r.name for r in ev.binomials.collect()} >= {"rosa alba"} and {r.token for r in ev.authors.where("token IN ('hara-smith', 'linn.')").collect()} == {"hara-smith", "linn."}


def test_overrides_of_a_name_service(spark):
    from arborline.operators import census as C

    taxa = spark.createDataFrame([("genus", "Rosa", "Weldon")] + [("species", "Rosa alba", "Brown")] * 6, "rank string, name string, authority string")
    ev = C.evidence(taxa, "rank", "name", "authority")
    names = spark.createDataFrame([("Rosa", "weldon", "p", "A", "author_only_single", "genus_authority"), ("Bellis", "brown", "p", "C", "single_word", None), ("Rosa", "nova", "p", "C", "single_word", None)], "genus string, epithet string, kingdom string, category string, subtype string, reason string")
    answers = spark.createDataFrame([("Rosa weldon", None, "p", "EXACT", "SPECIES", "ACCEPTED", None, None), ("Bellis", "GENUS", "p", "EXACT", "GENUS", "ACCEPTED", "Bellis (Brown, 1800)", "Bellis")], "name string, rank string, kingdom string, match_type string, taxon_rank string, status string, scientific string, canonical string")
    got = {r.epithet: (r.category, r.subtype, r.reason) for r in C.overridden(names, ev, answers).collect()}
    assert got == {"weldon": ("C", "single_word", "gbif_exact_species"), "brown": ("A", "author_only_single", "gbif_genus_authority"), "nova": ("C", "single_word", None)}


def test_word_bpe_against_plain_merging(spark, tmp_path):
    import gzip
    import random

    from arborline.functions.wordbpe import END, WordBpe, decoder, encoder, read_merges

    r = random.Random(3)
    fixed = [("a", "s"), ("e", "r"), ("i", "n"), ("in", "g</w>"), ("o", "l"), ("b", "ol"), ("bol", "t</w>"), ("w", "i"), ("r", "e"), ("re", "d</w>")]

    def made():
        """Merges in any order, later pieces before earlier ones too."""
        known, out = [*"abc", *(x + END for x in "abc")], []
        for _ in range(14):
            p = (r.choice([k for k in known if not k.endswith(END)]), r.choice(known))
            if p not in out:
                out.append(p)
                known.append("".join(p))
        r.shuffle(out)
        return out

    def plain(word, merges):
        """The earliest pair, at all its places from the left, again and again."""
        parts = [*word[:-1], word[-1] + END]
        while True:
            best = min((p for p in zip(parts, parts[1:], strict=False) if p in merges), key=merges.index, default=None)
            if best is None:
                return parts
            joined = []
            while parts:
                n = 2 if tuple(parts[:2]) == best else 1
                joined.append("".join(parts[:n]))
                parts = parts[n:]
            parts = joined

    bpe = WordBpe(fixed)
    for word in ("bolt", "red", "reading", "as", "easing", "boltbolt", "x"):
        assert [bpe.tokens[i] for i in bpe.encode(word)] == plain(word, fixed)
    for _ in range(40):
        merges = made()
        own = WordBpe(merges)
        for _ in range(20):
            word = "".join(r.choices("abc", k=r.randint(1, 14)))
            assert own.pieces(word) == plain(word, merges)
    assert bpe.tokens[bpe.encode("bolt")[-1]] == "bolt</w>" and bpe.decode(bpe.encode("the red bolt's é漢")) == "the red bolt 's é漢 "
    assert bpe.encode("<start>a<end>")[0] == bpe.ids["<start>"] and bpe.encode("") == [] and len(set(bpe.tokens)) == len(bpe.tokens) == 256 * 2 + len(fixed) + 2
    text = "\n".join(["#version: 0.2", *(" ".join(p) for p in fixed), ""])
    (tmp_path / "m.txt").write_text(text)
    (tmp_path / "m.gz").write_bytes(gzip.compress(text.encode()))
    assert read_merges(f"file://{tmp_path}/m.txt") == read_merges(f"file://{tmp_path}/m.gz") == fixed
    (tmp_path / "bad.txt").write_text("a b c\n")
    with pytest.raises(ValueError, match="no pair"):
        read_merges(f"file://{tmp_path}/bad.txt")
    t = spark.createDataFrame([("red bolt",), (None,), ("",)], "t string")
    ids = t.select("t", encoder(f"file://{tmp_path}/m.gz")("t").alias("ids"))
    assert [r[0] for r in ids.select("ids").collect()] == [bpe.encode("red bolt"), None, []]
    assert [r[0] for r in ids.select(decoder(f"file://{tmp_path}/m.gz")("ids")).collect()] == ["red bolt ", None, ""]


def test_registry():
    from arborline.operators.plugins import Registry, collated, metric

    r = Registry("model")
    r.add("big", lambda size=1: ("big", size), "a")
    r.add("big", lambda size=1: ("big b", size), "b")
    r.add("small", lambda inner=None: ("small", inner))
    assert r.names() == ["big", "small"] and r.names("b*") == ["big"] and r.tags("big") == ["a", "b"] and r.by_tag("b") == ["big"]
    assert r.make({"name": "small", "inner": {"name": "big", "tag": "b", "size": 3}}) == ("small", ("big b", 3))
    for ask in (("none", None), ("big", None), ("big", "c")):
        with pytest.raises(KeyError):
            r.get(*ask)
    with pytest.raises(ValueError, match="there is a model"):
        r.add("small", dict)
    assert metric({"top1": 2.0}, "top1") == 2.0 and metric({}, None) is None
    with pytest.raises(KeyError, match="no metric"):
        metric({"top1": 2.0}, "top5")
    assert collated([{"a": 1}, {"b": 2}]) == {"a": [1, None], "b": [None, 2]}


def test_sources_and_sinks(spark, tmp_path):
    from arborline.operators import sinks as K
    from arborline.sources import bytestore, matrices, readers

    root = f"file://{tmp_path}"
    rows = spark.range(1000).selectExpr("id % 3 AS shard", "id AS page_id", "encode(rpad(id, 8, '.'), 'utf-8') AS data")
    done = K.write_bytes(rows, f"{root}/b", 8)
    assert sorted((r.shard, r.n) for r in done.collect()) == [(0, 334), (1, 333), (2, 333)]
    back = bytestore.byte_rows(spark, f"{root}/b/*.u8", 8, 100)
    assert back.rdd.getNumPartitions() == 28 * 3 and back.count() == 1000
    assert [bytes(r.data) for r in back.where("path LIKE '%00001.u8'").orderBy("row").limit(2).collect()] == [b"1.......", b"4......."]
    with pytest.raises(Exception, match="short record"):
        bytestore.byte_rows(spark, f"{root}/b/*.u8", 7).collect()
    with pytest.raises(Exception, match="another width"):
        K.write_bytes(rows, f"{root}/c", 9)
    (tmp_path / "bad.tar.gz").write_bytes(b"no archive")
    assert bytestore.tar_members(spark, f"{root}/bad.tar.gz").where("error IS NOT NULL").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.hub_dataset(spark, root, "none", "train")
    with pytest.raises(ValueError, match="lies under"):
        K.guard(f"{tmp_path}/a/../x/y", f"{tmp_path}/x")
    assert K.guard(f"{tmp_path}/xy", f"{tmp_path}/x")
    import numpy as np

    np.save(tmp_path / "m.npy", np.arange(12, dtype="<f2").reshape(4, 3))
    assert [r.v for r in matrices.read_npy(spark, f"{root}/m.npy", 12).orderBy("row").collect()] == np.arange(12.0).reshape(4, 3).tolist()


def test_image_sizes():
    import struct

    from arborline.sources.bytestore import image_size

    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03"
    assert image_size(jpeg) == (40, 30) and image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 8)) == (7, 8)
    assert image_size(b"BM" + bytes(16) + struct.pack("<ii", 9, -10)) == (9, 10)
    assert image_size(None) is image_size(b"") is image_size(b"\xff\xd8\xff") is image_size(b"text") is None


def test_cached_lookups_are_tried_again(spark, tmp_path):
    from arborline.sources.readers import looked_up

    folder = str(tmp_path)

    def call(k):
        import pathlib

        seen = pathlib.Path(folder, str(k))
        if k > 2 or not seen.exists():
            seen.touch()
            raise ConnectionError
        return f"a{k}"

    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "k long")
    cache = spark.createDataFrame([(9, "cached")], "k long, a string")
    got = {r.k: (r.a, r.from_cache) for r in looked_up(asked, cache, "k", call, "a", tries=3, pause=0).collect()}
    assert got == {1: ("a1", False), 2: ("a2", False), 3: (None, False), 9: ("cached", True)}
