"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit SimHash is taken of the word shingles of each text.  For radius r the 64 bit positions
are mapped to the vectors of GF(2)^(r+1); table v (one for each non-zero v) keeps the positions
whose vector has odd inner product with v.  Any r differing positions span at most r dimensions,
so some v is orthogonal to all of them and the two fingerprints agree on that table's key: every
pair within the radius collides in some table, with no chance involved.

Inside a bucket no pairs are listed.  Two fingerprints at distance 1 or 2 share a "midpoint" at
distance at most 1 from both, which differs from them only in positions the table leaves free; so
each bucket member names itself and its one-bit neighbours in free positions, and members that
name the same point (65 at most) are linked.  That is done in memory for many buckets at once,
which give each member's root only; buckets that a sample shows to be very large exchange the
named points instead.  Both ways are exact, so the sample decides no result.  Components come
from alternating large-star and small-star rounds, each written to the shared folder.

Near duplicates by 5-word shingles need more than one fingerprint to be found: for them several
independent fingerprints of the set of words propose links, and exact Jaccard similarity decides.
One edited word changes five shingles but one word, so such pairs are close in words: at a
similarity of 0.8 each fingerprint brings over a quarter of them within 2 bits.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, materialize, remove, scratch_scope, tidied

SEED = 42
RADIUS = 2
#: Fingerprints that share a call (250 bytes each), and a bucket's size, estimated from one in
#: SAMPLED of them, from which it is exchanged instead.
PART_ROWS, IN_MEMORY, SAMPLED = 50_000, 100_000, 64
#: Fingerprints that propose near copies by 5-word shingles.
FAMILY = 16
#: Shingle sets in a block of a group that is compared in full, cells in a task, and tasks at least.
BLOCK_BYTES, CELLS_PER_PART, LEAST_PARTS = 2 << 20, 64, 64
#: Ways in which the rows of one fingerprint are spread.
SALT = 16
#: Words hashed at a time, so that a text of any length needs bounded memory.
BLOCK_WORDS = 50_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of independent hashes from one; the 0th is the hash itself."""
    if k == 0:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int):
    """XXH64 (seed 42) of the word shingles, repeats included, in blocks: A-Z lower-cased, words
    split at ASCII white space; fewer words than a shingle: the whole sequence; none: nothing."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    for lo in range(0, n, BLOCK_WORDS):
        part = words[lo : min(lo + BLOCK_WORDS, n) + shingle - 1]
        grams = [b" ".join(part)] if len(part) < shingle else [b" ".join(g) for g in zip(*(part[i:] for i in range(shingle)), strict=False)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=len(grams))


def simhash(text: str | None, shingle: int = 3, family: int = 1, distinct: bool = False) -> list[int]:
    """Unsigned 64-bit SimHashes of a text, one for each hash of the family; no words: 0.
    distinct: shingles that repeat count once."""
    n, ones = 0, np.zeros((family, 64), dtype=np.int64)
    hashes = shingle_hashes(text, shingle)
    if distinct:
        hashes = [np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))]
    for h in hashes:
        n += len(h)
        for k in range(family):
            ones[k] += np.unpackbits(_spread(h, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(row * 2 > n).tobytes(), "big") for row in ones]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, family: int = 1, distinct: bool = False, digest: bool = False) -> DataFrame:
    """(doc_id, fps): one row per input row; fps are its SimHashes as signed longs.  distinct:
    repeated shingles count once.  digest: with sha, the SHA-256 of the text."""
    import hashlib

    def run(batches):
        for b in batches:
            fps = [[_signed(x) for x in simhash(t.as_py(), shingle, family, distinct)] for t in b.column(1)]
            cols, names = [b.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fps"]
            if digest:
                cols, names = [*cols, pa.array([hashlib.sha256((t.as_py() or "").encode()).digest() for t in b.column(1)], pa.binary())], [*names, "sha"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(tidied(run), "doc_id long, fps array<long>" + (", sha binary" if digest else ""))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks of kept bits, one for each table."""
    dims = radius + 1
    return [sum(1 << i for i in range(64) if bin((i % (1 << dims)) & v).count("1") % 2) for v in range(1, 1 << dims)]


def _free_bits(mask: int) -> list[int]:
    return [1 << i for i in range(64) if not mask >> i & 1]


def midpoint_roots(fps: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v), u > v, of the fingerprints (signed, distinct): for each its root among those that share
    midpoints in the free positions of a mask, directly or over others, and its smallest partner
    within 2 bits."""
    flips = np.array([0, *_free_bits(mask)], dtype=np.uint64)
    fps = np.sort(fps)
    points = (fps.view(np.uint64)[:, None] ^ flips).ravel()
    order = np.argsort(points, kind="stable")
    owner = order // len(flips)
    new = np.ones(len(order), dtype=bool)
    new[1:] = points[order[1:]] != points[order[:-1]]
    del points
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    some = size > 1  # only points that two or more have named
    owner, size = owner[np.repeat(some, size)], size[some]
    root = np.arange(len(fps))
    near = root.copy()
    if len(size):
        start = np.cumsum(size) - size
        np.minimum.at(near, owner, np.repeat(np.minimum.reduceat(owner, start), size))
        while True:
            low = np.minimum.reduceat(root[owner], start)
            before = root.copy()
            np.minimum.at(root, owner, np.repeat(low, size))
            root = np.minimum(root, root[root])
            if (root == before).all():
                break
    moved, other = np.flatnonzero(root < np.arange(len(fps))), np.flatnonzero((near > root) & (near < np.arange(len(fps))))
    return fps[np.concatenate([moved, other])], fps[np.concatenate([root[moved], near[other]])]


def _roots_of_part(key, table):
    fam, tab = key[0].as_py(), key[1].as_py()
    mask = covering_masks()[tab]
    fps = table["fp"].to_numpy()
    kept = fps.view(np.uint64) & np.uint64(mask)
    order = np.argsort(kept, kind="stable")
    same = kept[order[1:]] == kept[order[:-1]]
    twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    u, v = midpoint_roots(fps[order[twin]], mask)
    return pa.Table.from_arrays([pa.array(np.full(len(u), fam, np.int32)), pa.array(u), pa.array(v)], names=["family", "u", "v"])


def star_links(points: DataFrame) -> DataFrame:
    """(family, u, v), u > v: links between the distinct fingerprints (columns family, fp), whose
    transitive closure joins exactly those connected by steps of 2 differing bits or fewer."""
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = lambda p: p.select("family", "fp", F.explode(tables).alias("k")).select("family", "fp", "k.table", "k.key")
    bucket = ["family", "table", "key"]
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    large, large_path = materialize(keyed(sample).groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > IN_MEMORY).select(*bucket), "large-buckets")
    keys = keyed(points)
    any_large = large.limit(1).count() > 0
    most = points.groupBy("family").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // PART_ROWS))
    common = keys.join(large, bucket, "left_anti") if any_large else keys
    dealt = common.select("family", "table", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "fp")
    links = dealt.groupBy("family", "table", "part").applyInArrow(tidied(_roots_of_part), "family int, u long, v long")
    if any_large:
        free = F.element_at(F.array(*[F.array(F.lit(0), *[F.lit(_signed(x)) for x in _free_bits(m)]) for m in masks]), F.col("table") + 1)
        named = keys.join(large, bucket).select("family", "fp", F.explode(free).alias("flip")).select("family", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        stars = named.groupBy("family", "point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        links = links.union(stars.select("family", F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u > v").select("family", "u", "v"))
    else:
        remove(points.sparkSession, large_path)
    return links.distinct()


def components(edges: DataFrame, tag: str = "components") -> tuple[DataFrame, str | None]:
    """(u, root) for every non-root vertex of the undirected graph of (u, v), u > v; root is the
    smallest vertex of the component.  Large-star and small-star alternate until nothing moves."""
    spark = edges.sparkSession
    edges, path = materialize(edges, tag)
    mark = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or tuple(state) == mark:
            return edges.select("u", F.col("v").alias("root")), path
        mark = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2.select("u", F.col("m").alias("v"))).distinct()
        edges, new = materialize(small, tag)
        remove(spark, path)
        path = new


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), one row for each input row.

    component_id: the smallest doc_id among all documents reachable by links of at most two
    differing bits.  Null or empty texts have fingerprint zero and link like any other.  Rows with
    a null id take part in linking; a component of null ids only has a null component_id.
    Repeated rows are repeated in the result.  Other columns of the input are ignored.  An empty
    table gives an empty result.
    """
    with scratch_scope(docs.sparkSession) as scope:
        marked, _ = materialize(fingerprints(docs, id_col, text_col, shingle).select("doc_id", F.col("fps")[0].alias("fp")), "simhash")
        points, _ = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-points")
        roots, _ = components(star_links(points.select(F.lit(0).alias("family"), "fp")).select("u", "v"))
        owner = points.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        # A root's smallest id is aggregated first and joined back, so a huge component is never one group.
        first = owner.groupBy("root").agg(F.min("first_id").alias("component_id"))
        parts = F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("part")
        table = owner.join(first, "root").select("fp", "component_id", parts)
        # Many documents may share one fingerprint: their rows are spread.
        spread = marked.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
        return finished(spread.join(table, ["fp", "part"]).select("doc_id", "fp", "component_id"), "simhash-components", scope)


def jaccard(a: str | None, b: str | None, shingle: int) -> float:
    """Jaccard similarity of the sets of word shingles."""
    x, y = (np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, shingle)])) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _cell_links(ids: np.ndarray, comps: np.ndarray, left: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between documents on the left and any others that join different components: enough
    of them that no two components with a similar pair stay apart."""
    names, comp = np.unique(comps, return_inverse=True)
    if len(names) == 1:
        return []
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(shingle))]) if len(shingle) else np.zeros(1, np.int64)
    holders, first = owner[order], np.cumsum(size) - size
    out = []
    for x in np.flatnonzero(left):
        if (comp == comp[x]).all():
            continue
        mine = shingle[first[x] : first[x] + size[x]]
        lists = [holders[start[k] : start[k + 1]] for k in mine[start[mine + 1] - start[mine] > 1]] if len(mine) else []
        both = np.bincount(np.concatenate(lists), minlength=len(sets)) if lists else np.zeros(len(sets), np.int64)
        either = size[x] + size - both
        for y in np.flatnonzero(np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity):
            if comp[y] != comp[x]:
                out.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
                comp[comp == comp[y]] = comp[x]
    return out


def links_left(pairs: DataFrame, joined: DataFrame, text: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v), u > v: the similar pairs that verified proposals have not joined yet.

    Refused proposals (a, b) between different components of the verified links (u, root) connect these to
    groups, so any two fingerprints within 2 bits are in one component or one group.  Each document
    outside the largest component is compared with every document of its group.  The two sides are
    dealt in blocks of about BLOCK_BYTES, a cell for each two blocks, so no task holds a large group.
    """
    comp, _ = materialize(text.select("i").distinct().join(joined.select(F.col("u").alias("i"), "root"), "i", "left").select("i", F.coalesce("root", "i").alias("c")), "near-members")
    across = pairs.hint("merge").join(comp.toDF("a", "ca"), "a").hint("merge").join(comp.toDF("b", "cb"), "b").where("ca <> cb")
    groups, _ = components(across.select(F.greatest("ca", "cb").alias("u"), F.least("ca", "cb").alias("v")).distinct(), "proposed")
    group = groups.select(F.col("u").alias("c"), F.col("root").alias("g")).union(groups.select("root", "root").distinct())
    member = comp.join(group, "c")
    largest = member.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("largest"))
    open_ = member.join(largest, "g").select("i", "g", "c", (F.col("c") != F.col("largest")).alias("rest"))

    def hashed(batches):
        for b in batches:
            sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t.as_py(), shingle)])).tobytes() for t in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sets, pa.binary())], names=["i", "g", "c", "rest", "h"])

    sets, _ = materialize(open_.hint("merge").join(text, "i").select("i", "g", "c", "rest", "t").mapInArrow(tidied(hashed), "i long, g long, c long, rest boolean, h binary"), "shingle-sets")
    weight = lambda side: F.ceil(F.sum(F.when(side, F.octet_length("h") + 64).otherwise(0)) / BLOCK_BYTES)
    blocks = sets.groupBy("g").agg(weight(F.col("rest")).alias("kr"), weight(~F.col("rest")).alias("kd"))
    # Blocks 0..kr-1 are the rest, kr..kr+kd-1 the largest component; a cell is (left, right), left < kr.
    placed = sets.join(blocks, "g").withColumn("block", F.when(F.col("rest"), F.pmod(F.xxhash64("i"), "kr")).otherwise(F.col("kr") + F.pmod(F.xxhash64("i"), "kd")))
    lefts = placed.where("rest").select("i", "g", "c", "h", F.col("block").alias("x"), F.explode(F.expr("sequence(block, kr + kd - 1)")).alias("y"), F.lit(True).alias("left"))
    rights = placed.select("i", "g", "c", "h", F.explode(F.expr("sequence(0L, least(block, kr - 1))")).alias("x"), F.col("block").alias("y"), F.lit(False).alias("left")).where("x < y")
    sums = blocks.agg(F.sum((F.col("kr") + F.col("kd")) * F.col("kr"))).first()[0] or 0
    n = max(LEAST_PARTS, int(sums) // CELLS_PER_PART)
    cells = lefts.union(rights).withColumn("part", F.pmod(F.xxhash64("g", "x", "y"), F.lit(n)).cast("int"))

    def compare(table):
        keys = np.stack([table[k].to_numpy() for k in ("y", "x", "g")])
        order = np.lexsort(keys)
        keys = keys[:, order]
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        ids, comps, left, found = table["i"].to_numpy(), table["c"].to_numpy(), table["left"].to_numpy(), []
        for at in np.split(order, cuts):
            found += _cell_links(ids[at], comps[at], left[at], [np.frombuffer(table["h"][k].as_buffer(), np.uint64) for k in at], similarity)
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return cells.groupBy("part").applyInArrow(tidied(compare), "u long, v long").distinct()


def near_copies(marked: DataFrame, src: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, root): the documents near a smaller one, with the smallest id of their group.

    marked: (doc_id, fps) of different texts; src: (doc_id, text)."""
    by_family = marked.select("doc_id", F.posexplode("fps").alias("family", "fp"))
    points, _ = materialize(by_family.groupBy("family", "fp").agg(F.min("doc_id").alias("first_id")), "family-points")
    links = star_links(points.select("family", "fp"))
    to = lambda c, name: points.select("family", F.col("fp").alias(c), F.col("first_id").alias(name))
    across = links.join(to("u", "a"), ["family", "u"]).join(to("v", "b"), ["family", "v"]).select("a", "b")
    within = by_family.join(points, ["family", "fp"]).where("doc_id > first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    pairs, _ = materialize(across.union(within).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    # Merge joins keep the movement of texts in proportion at every size.
    wanted = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    text, _ = materialize(src.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).join(wanted.hint("merge"), "i", "left_semi").dropDuplicates(["i", "t"]), "near-texts")

    def verify(batches):
        for b in batches:
            ok = [jaccard(x.as_py(), y.as_py(), shingle) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    both = pairs.hint("merge").join(text.toDF("a", "x"), "a").hint("merge").join(text.toDF("b", "y"), "b").select("a", "b", "x", "y")
    verified, _ = materialize(both.mapInArrow(tidied(verify), "u long, v long, ok boolean").distinct(), "verified")
    joined, _ = components(verified.where("ok").select("u", "v"), "near")
    refused = verified.where("NOT ok").select(F.col("u").alias("a"), F.col("v").alias("b"))  # the others lie within components
    more, _ = materialize(links_left(refused, joined, text, similarity, shingle), "near-left")
    return components(joined.select("u", F.col("root").alias("v")).union(more).distinct(), "near")[0]


def first_of_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, family: int = FAMILY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the smallest id of each group of near copies, with their columns.

    Groups are connected by exact copies and by pairs whose sets of 5-word shingles have a Jaccard
    similarity of 0.8 or more.  Proposals come from `family` SimHashes of the distinct words, by
    covering LSH of radius 2.  Stars are verified first; where that leaves a group of proposals in
    several components, all its pairs across them are compared.  So a similar pair is missed only if
    no chain of fingerprints within 2 bits connects the two.  Rows that repeat an id and text are one
    document and all stay.  Documents with null ids come after all others and go only as exact copies
    of another one; null and empty texts are exact copies of one another.  An empty table gives an
    empty result.
    """
    key, names = ["none", "id", "sha"], ["_none", "_id", "_sha"]
    while set(names) & set(docs.columns):
        names = [f"{n}_" for n in names]
    with scratch_scope(docs.sparkSession) as scope:
        src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        marked = fingerprints(src, "doc_id", "text", 1, family, distinct=True, digest=True)
        # Of exact copies the first is taken before anything moves: copies combine on the map side.
        place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
        firsts = marked.groupBy("sha").agg(F.min(F.struct(place.alias("at"), "fps")).alias("f"))
        firsts, _ = materialize(firsts.select("sha", "f.at.none", "f.at.id", "f.fps"), "family")
        single = firsts.where("NOT none").select(F.col("id").alias("doc_id"), "fps")
        near = near_copies(single, src, similarity, shingle).select(F.col("u").alias("id"), F.lit(False).alias("none"))
        kept = finished(firsts.select(*key).join(near, ["id", "none"], "left_anti").select(*key), "kept", scope)
    own = docs.withColumns({names[0]: F.col(f"`{id_col}`").cast("long").isNull(), names[1]: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)), names[2]: F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))})
    return own.join(kept.toDF(*names).hint("merge"), names, "left_semi").drop(*names)
