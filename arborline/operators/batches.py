"""Batch plans: balanced groups of each leaf, batches of groups dealt to workers, and their checks."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import dense_ids

#: Groups that are dealt in one task; more are dealt in several, whose leftovers are dealt together.
PART_GROUPS = 100_000
#: Steps whose groups go to workers in one call.
STEPS_TOGETHER = 64


def hashed_order(seed: int, epoch: int, *parts) -> Column:
    """A reproducible random order: md5(seed-epoch-parts)."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def balanced_groups(rows: DataFrame, leaf: str, item: str, most: int, seed: int = 0, epoch: int = 1) -> DataFrame:
    """rows with group_no and place (in the group): each leaf's rows, shuffled by md5(seed-epoch-item), in
    ceil(n / most) groups whose sizes differ by one at most, the larger first."""
    w = Window.partitionBy(leaf)
    order = hashed_order(seed, epoch, item)
    p = rows.withColumns({"_pos": F.row_number().over(w.orderBy(order, item)) - 1, "_n": F.count("*").over(w)}).withColumn("_g", F.ceil(F.col("_n") / most).cast("long"))
    p = p.withColumns({"_small": F.expr("_n div _g"), "_extra": F.col("_n") % F.col("_g")}).withColumn("_head", F.col("_extra") * (F.col("_small") + 1))
    group = F.when(F.col("_pos") < F.col("_head"), F.expr("_pos div (_small + 1)")).otherwise(F.col("_extra") + F.expr("(_pos - _head) div _small"))
    place = F.when(F.col("_pos") < F.col("_head"), F.col("_pos") % (F.col("_small") + 1)).otherwise((F.col("_pos") - F.col("_head")) % F.col("_small"))
    return p.withColumns({"group_no": group, "place": place}).drop("_pos", "_n", "_g", "_small", "_extra", "_head")


class Batches:
    """Batches that are being filled: each has a number of workers with equal room, and takes a leaf
    with several groups once.  Groups are offered to the batches in turn."""

    def __init__(self, rooms: list[list[int]]):
        self.free = [list(r) for r in rooms]
        self.total = [sum(r) for r in rooms]
        self.leaves: list[set] = [set() for _ in rooms]
        self.open = [b for b, n in enumerate(self.total) if n]
        self.turn = 0

    def place(self, leaf, size: int, alone: bool) -> tuple[int, int] | None:
        """(batch, worker) for a group, on the worker with most room of the next batch that can take it."""
        for tried in range(len(self.open)):
            k = (self.turn + tried) % len(self.open)
            b = self.open[k]
            free = self.free[b]
            room = max(free)
            if room >= size and (alone or leaf not in self.leaves[b]):
                worker = free.index(room)
                free[worker] -= size
                self.total[b] -= size
                if not alone:
                    self.leaves[b].add(leaf)
                if self.total[b]:
                    self.turn = k + 1
                else:
                    self.open[k] = self.open[-1]  # its place goes to the last one
                    self.open.pop()
                    self.turn = k
                return b, worker
        return None


    def scatter(self, leaf, n: int) -> list[tuple[int, int]] | None:
        """(batch, worker) for n single rows of a leaf: the n batches with most room that do not have it.
        Taking the fullest needs first is what lets such rows fill any holes that they can fill."""
        best = heapq.nlargest(n, (b for b in range(len(self.total)) if self.total[b] and leaf not in self.leaves[b]), key=lambda b: (self.total[b], -b))
        if len(best) < n:
            return None
        out = []
        for b in best:
            worker = self.free[b].index(max(self.free[b]))
            self.free[b][worker] -= 1
            self.total[b] -= 1
            self.leaves[b].add(leaf)
            out.append((b, worker))
        return out


def _dealt(leaf: list, size: list, groups: list, rooms: list, cut: set) -> tuple[list, list, Batches]:
    """Pieces (group, start, size), their places (None: no room) and the batches, where the groups in
    `cut` are dealt row by row after all others."""
    bins = Batches(rooms)
    pieces = [(k, 0, size[k]) for k in range(len(size)) if k not in cut]
    places = [bins.place(leaf[k], s, groups[k] == 1) for k, _, s in pieces]
    if cut:
        for (k, _, _), place in zip(pieces, places, strict=True):
            if place:
                bins.leaves[place[0]].add(leaf[k])
        rows: dict = {}
        for k in [*sorted(cut), *(k for (k, _, _), place in zip(pieces, places, strict=True) if place is None)]:
            rows.setdefault(leaf[k], []).extend((k, i, 1) for i in range(size[k]))
        kept = [(p, place) for p, place in zip(pieces, places, strict=True) if place]
        pieces, places = [p for p, _ in kept], [place for _, place in kept]
        for x in sorted(rows, key=lambda x: -len(rows[x])):
            pieces += rows[x]
            places += bins.scatter(x, len(rows[x])) or [None] * len(rows[x])
    return pieces, places, bins


def _deal(g: pd.DataFrame, batch: int, world: int, last: bool, cut: bool) -> pd.DataFrame:
    """The groups of one part, or the pieces that they are cut in, with batch and worker.

    Where it is not the last part, batches that could not be filled are given up: their groups, like those
    that found no room, get batch -1.  In the last part all must find room: if not, as many groups are
    cut in single rows as there are holes to be expected, then twice as many, and so on.
    """
    g = g.sort_values(["size", "h"], ascending=[False, True], ignore_index=True)
    leaf, size, groups = g["leaf"].tolist(), g["size"].tolist(), g["groups"].tolist()
    total, by_hash = sum(size), g["h"].argsort().tolist()
    rooms = [[batch // world] * world for _ in range(total // batch)]
    short = total % batch if last else 0
    if short:
        rooms.append([short // world + (r < short % world) for r in range(world)])
    fillers, single = 0, set()
    while True:
        pieces, places, bins = _dealt(leaf, size, groups, rooms, single)
        lost = sum(x is None for x in places)
        if not last or not lost:
            break
        if not cut or len(single) == len(size):
            raise RuntimeError(f"{lost} groups fit no batch")
        fillers, n = max(2 * fillers, len(rooms) * world * max(size) // 4), 0
        single = set()
        for k in by_hash:
            if n >= fillers:
                break
            single.add(k)
            n += size[k]
    given_up = set() if last else set(bins.open)
    at, start, taken = zip(*pieces, strict=True)
    places = [(-1, -1) if x is None or x[0] in given_up else x for x in places]
    out = g.iloc[list(at)][["leaf", "group_no", "groups", "h", "part"]].reset_index(drop=True)
    return out.assign(start=start, size=taken, batch=[b for b, _ in places], worker=[w for _, w in places])[["leaf", "group_no", "start", "size", "groups", "h", "part", "batch", "worker"]]


def pack_groups(groups: DataFrame, batch: int, world: int = 1, seed: int = 0, epoch: int = 1, part_groups: int = PART_GROUPS, cut: bool = True) -> DataFrame:
    """(leaf, group_no, start, size, step, worker): every group in a batch of exactly `batch` rows, each
    worker with an equal share of them, and at most one group of a leaf in a batch; one last batch is short.

    Groups are dealt largest first, random among equals, so the smallest fill what is left.  Where they
    are too few, some groups are cut in single rows (row `start` of the group), which go to different
    batches; without `cut` that raises.  Of many groups about `part_groups` share a task; a leaf's
    groups go to different parts in turn.  What a part cannot fill whole is dealt with the other parts'
    leftovers in one more task (a batch or two for each part).
    """
    if batch % world:
        raise ValueError(f"{world} workers cannot share {batch} rows evenly")
    n = groups.count()
    parts = max(1, -(-n // part_groups))
    h = hashed_order(seed, epoch, "leaf", "group_no")
    dealt = groups.select("leaf", F.col("group_no").cast("long").alias("group_no"), F.col("size").cast("long").alias("size"), F.count("*").over(Window.partitionBy("leaf")).alias("groups"), h.alias("h"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("leaf") + F.col("group_no"), F.lit(parts)).cast("int"))
    kind = groups.schema["leaf"].dataType.simpleString()
    schema = f"leaf {kind}, group_no long, start long, size long, groups long, h string, part int, batch int, worker int"
    placed = dealt.groupBy("part").applyInPandas(lambda g: _deal(g, batch, world, parts == 1, cut), schema)
    if parts > 1:
        placed = placed.persist()  # read twice; the same input gives the same parts again
        rest = placed.where("batch < 0").withColumn("part", F.lit(parts)).groupBy("part").applyInPandas(lambda g: _deal(g, batch, world, True, cut), schema)
        placed = placed.where("batch >= 0").union(rest)
    # Batches in random order, the short one last.
    sizes = placed.groupBy("part", "batch").agg(F.sum("size").alias("rows"))
    order = hashed_order(seed, epoch, "part", "batch")
    steps = dense_ids(sizes.select("part", "batch", (F.col("rows") < batch).cast("int").alias("short"), order.alias("h")), ["short", "h"], "step")
    return placed.join(steps.select("part", "batch", "step"), ["part", "batch"]).select("leaf", "group_no", "start", "size", "step", "worker")


def random_batches(rows: DataFrame, item: str, leaf: str, size: int, world: int = 1, seed: int = 0, epoch: int = 1) -> DataFrame:
    """rows with group_no (0), step and worker: a uniformly random partition in batches of `size`, the last
    one short; rows of a leaf in a batch are one group.  In each batch groups go to the worker with
    most room, largest first, and single rows fill the rest.

    Numbering goes by ranges of the hash, so no task holds all rows; steps are shared out many at a time.
    """
    if size % world:
        raise ValueError(f"{world} workers cannot share {size} rows evenly")
    r = rows.withColumn("_h", hashed_order(seed, epoch, item))
    numbered = dense_ids(r, ["_h", item], "_pos").withColumn("step", F.expr(f"_pos div {size}")).drop("_pos")
    groups = numbered.groupBy("step", F.col(leaf).alias("leaf")).agg(F.count("*").alias("size"), F.min("_h").alias("h"))

    def share(steps: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([share_one(g) for _, g in steps.groupby("step")])

    def share_one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "h"], ascending=[False, True], ignore_index=True)
        n = int(g["size"].sum())
        bins = Batches([[n // world + (w < n % world) for w in range(world)]])
        found = [bins.place(x, k, True) for x, k in zip(g["leaf"], g["size"], strict=True)]
        if None in found:
            raise RuntimeError(f"step {g['step'].iloc[0]}: a group fits no worker")
        return g.assign(worker=[w for _, w in found])[["step", "leaf", "worker"]]

    kind = rows.schema[leaf].dataType.simpleString()
    workers = groups.groupBy(F.expr(f"step div {STEPS_TOGETHER}")).applyInPandas(share, f"step long, leaf {kind}, worker int")
    joined = numbered.join(workers, (numbered["step"] == workers["step"]) & numbered[leaf].eqNullSafe(workers["leaf"])).drop(workers["step"], workers["leaf"])
    return joined.withColumn("group_no", F.lit(0).cast("long")).drop("_h")


def check_plan(plan: DataFrame, rows: DataFrame, item: str, leaf: str, batch: int, most: int, world: int = 1) -> DataFrame:
    """One row of violations of a plan (item, leaf, group_no, step, worker) of rows (item, leaf), all zero
    if it is sound: items that are missing, repeated or unknown, or in a group of another leaf; groups
    that are too large; leaves with two groups in a batch; batches (but the last) and workers' shares
    that are not of the exact size."""
    planned = plan.groupBy(item).agg(F.count("*").alias("n"), F.first(leaf).alias("_leaf"))
    known = rows.select(item, F.col(leaf).alias("_own"))
    j = known.join(planned, item, "full_outer")
    items = j.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("_own").isNull()).alias("unknown"),
        F.count_if(F.col("n").isNotNull() & F.col("_own").isNotNull() & (F.col("_own") != F.col("_leaf"))).alias("strangers"),
    )
    groups = plan.groupBy("step", "worker", leaf, "group_no").agg(F.count("*").alias("size"))
    sizes = groups.agg(F.count_if(F.col("size") > most).alias("large_groups"))
    twice = groups.groupBy("step", leaf).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("leaf_twice"))
    shares = groups.groupBy("step", "worker").agg(F.sum("size").alias("rows")).groupBy("step").agg(F.sum("rows").alias("rows"), F.min("rows").alias("least"), F.max("rows").alias("most"), F.count("*").alias("workers"))
    last = plan.agg(F.max("step").alias("last"))
    full = shares.join(F.broadcast(last))  # one row
    even = (F.col("least") == batch // world) & (F.col("most") == batch // world) & (F.col("workers") == world)
    exact = full.agg(F.count_if((F.col("step") < F.col("last")) & (F.col("rows") != batch)).alias("wrong_batches"), F.count_if(F.when(F.col("rows") == batch, ~even).otherwise(F.col("most") - F.col("least") > 1)).alias("wrong_shares"))
    one = [t.withColumn("_j", F.lit(0)) for t in (items, sizes, twice, exact)]
    return one[0].join(one[1], "_j").join(one[2], "_j").join(one[3], "_j").drop("_j")
