"""URL filtering by a path-template tree, in DataFrame operations only.

Explicit rules decide first (the longest that fits).  Every other url is judged by the template
tree of its host.  The tree goes down the path segment by segment, as deep as paths go:

- the segments below a node become one wildcard where the node has many children for its rows;
- of the branches that then hold labels, those whose blocked share does not differ significantly
  from the node's are merged into one; the others are compared with what lies on their side of
  it, and merged or kept alone;
- a branch without labels joins the merged one that it resembles most, if the two send at least
  RESEMBLANCE of their urls to the same next segments and each has RESEMBLING_ROWS urls to show it;
- each branch has an estimate of its blocked share: its labels, its urls without a label (which count
  half a label each, at the prior), and the estimate of the branch above it (which counts
  PARENT_WEIGHT labels): one without labels that resembles none goes by the prior the more urls it
  has, and by what is known around it the fewer it has;
- a template is rejected when the estimate of its deepest branch reaches one half.

Labels are the rules' own verdicts and, where it is named, a column of labels.  The tree is not
built on below a node that holds one path only, no blocked label or nothing else: all templates there
go by the node's estimate.  Levels on which all paths go the same way are no branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import finished, materialize, scratch_scope

# Fixed values: (verdict, host, path) of the rules; one fits its host and all subdomains where the path starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A position is variable with at least so many children and fewer rows than ROWS_PER_CHILD each.
MIN_CHILDREN, ROWS_PER_CHILD = 8, 4
#: The prior of the blocked share, what an unlabelled url counts in labels, and what the estimate above counts.
PRIOR, UNLABELLED_WEIGHT, PARENT_WEIGHT = 0.2, 0.5, 4
#: Tenths of the urls of two branches that go on alike where these resemble each other, and the least urls of each.
RESEMBLANCE, RESEMBLING_ROWS = 9, 10
#: Merged branches, by how their blocked share compares with the node's.
SIDES = ("~=", "~+", "~-")
#: Ways in which a hot host, node or url is spread.
SALT = 16
#: Rows of a level up to which their statistics (no more rows than they) are broadcast.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule as text, its verdict), both null where no rule fits; of equally long rules the first
    in text order."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segment_class(s: Column) -> Column:
    """Numbers and long hexadecimal names are variable wherever they stand."""
    return (
        F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), F.regexp_replace(s, r"^[0-9]+", "{n}"))
        .when(s.rlike(r"^[0-9A-Fa-f-]{12,}$"), F.lit("{x}"))
        .otherwise(s)
    )


def with_stats(rows: DataFrame, stats: DataFrame, keys: list[str], spread: list[str], few: bool = False) -> DataFrame:
    """rows joined with the one row of stats for their keys; rows of a hot key are spread by the
    hash of other columns, and the (narrow) stats repeated for each part.  few: there are at most
    BROADCAST_ROWS rows, and so of stats, which then go to all tasks."""
    if few:
        return rows.join(F.broadcast(stats), keys)
    parts = F.explode(F.array(*[F.lit(i) for i in range(SALT)]))
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(SALT)).cast("int"))
    return salted.join(stats.withColumn("_part", parts), [*keys, "_part"]).drop("_part")


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _alike(l: str, b: str, pl: str, pb: str) -> Column:  # noqa: E741
    """Whether b of l blocked labels are within two standard errors of pb of pl."""
    d = lambda c: F.col(c).cast("double")
    gap = d(b) * d(pl) - d(pb) * d(l)
    return gap * gap <= F.lit(4.0) * d(l) * d(pb) * (d(pl) - d(pb))


def branches(open_: DataFrame, few: bool = False) -> DataFrame:
    """(node, c, m, mn, ml, mb): for each child c of each node (null: the paths that end there) the
    merged branch m that it belongs to, and the branch's rows and labels.

    open_: (node, c, x, n, l, b), x being the segment after c."""
    kids = open_.groupBy("node", "c").agg(*_sums("n", "l", "b"))
    inner = F.col("c").isNotNull()
    nodes = kids.groupBy("node").agg(F.count("c").alias("k"), F.sum(F.when(inner, F.col("n")).otherwise(0)).alias("kn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    wide = (F.col("k") >= MIN_CHILDREN) & (F.col("kn") < ROWS_PER_CHILD * F.col("k"))
    name = F.when(~inner, F.lit("$")).when(wide & (F.col("c") != ""), F.lit("*")).otherwise(F.concat(F.lit("="), "c"))
    named, _ = materialize(with_stats(kids, nodes, ["node"], ["c"], few).select("node", "c", name.alias("g"), "n", "l", "b", "pl", "pb"), "named")
    groups = named.groupBy("node", "g").agg(*_sums("n", "l", "b"), F.first("pl").alias("pl"), F.first("pb").alias("pb"))
    above = F.col("b").cast("double") * F.col("pl") > F.col("pb").cast("double") * F.col("l")
    side = F.when(F.col("l") == 0, None).when(_alike("l", "b", "pl", "pb"), F.lit("~=")).when(above, F.lit("~+")).otherwise(F.lit("~-"))
    sided = groups.select("node", "g", "n", "l", "b", side.alias("side"))
    sides = sided.where("side IS NOT NULL").groupBy("node", "side").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"))
    near = with_stats(sided.where("side IS NOT NULL"), sides, ["node", "side"], ["g"], few)
    merged = near.select("node", "g", "n", "l", "b", F.when((F.col("side") == "~=") | _alike("l", "b", "sl", "sb"), F.col("side")).otherwise(F.col("g")).alias("m"))
    merged = merged.union(sided.where("side IS NULL").select("node", "g", "n", "l", "b", F.col("g").alias("m")))
    merged, _ = materialize(merged, "merged")
    free = merged.where((F.col("l") == 0) & (F.col("g") != "$"))
    # What the urls of each branch go on with: (node, g, x, n), narrow.
    tails = with_stats(open_.where(inner).groupBy("node", "c", "x").agg(*_sums("n")), named.select("node", "c", "g"), ["node", "c"], ["x"], few).groupBy("node", "g", "x").agg(*_sums("n"))
    tails, _ = materialize(with_stats(tails, merged.select("node", "g", "l", "m"), ["node", "g"], ["x"], few), "tails")
    of = [F.sum(F.when(F.col("m") == side, F.col("n")).otherwise(0)).alias(f"p{i}") for i, side in enumerate(SIDES)]
    pools = tails.groupBy("node", "x").agg(*of)
    sizes = tails.groupBy("node").agg(*[p.alias(f"s{i}") for i, p in enumerate(of)])
    own = tails.where("l = 0").groupBy("node", "g").agg(F.sum("n").alias("own"))
    alike = with_stats(with_stats(tails.where("l = 0").select("node", "g", "x", F.col("n").alias("u")), pools, ["node", "x"], ["g"], few), sizes, ["node"], ["g", "x"], few)
    alike = with_stats(alike, own, ["node", "g"], ["x"], few)
    d = lambda c: F.col(c).cast("double")
    # Products of counts are exact in doubles below 2^53.
    alike = alike.groupBy("node", "g").agg(F.first("own").alias("own"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(3)], *[F.sum(F.least(d("u") * d(f"s{i}"), d(f"p{i}") * d("own"))).alias(f"o{i}") for i in range(3)])
    near = lambda i: (F.col("own") >= RESEMBLING_ROWS) & (F.col(f"s{i}") >= RESEMBLING_ROWS) & (F.lit(10.0) * F.col(f"o{i}") >= F.lit(float(RESEMBLANCE)) * d("own") * d(f"s{i}"))
    share = [F.when(near(i), F.col(f"o{i}") / d(f"s{i}")).otherwise(-1.0) for i in range(3)]
    best = F.greatest(*share)
    joined = F.when(best < 0, F.col("g")).when(share[0] == best, SIDES[0]).when(share[1] == best, SIDES[1]).otherwise(SIDES[2])
    moved = with_stats(free, alike.select("node", "g", joined.alias("to")), ["node", "g"], ["n"], few).select("node", "g", "n", "l", "b", F.col("to").alias("m"))
    merged = merged.where((F.col("l") > 0) | (F.col("g") == "$")).union(moved)
    totals = merged.groupBy("node", "m").agg(F.sum("n").alias("mn"), F.sum("l").alias("ml"), F.sum("b").alias("mb"))
    found = with_stats(merged.select("node", "g", "m"), totals, ["node", "m"], ["g"], few)
    return with_stats(named.select("node", "c", "g"), found, ["node", "g"], ["c"], few).select("node", "c", "m", "mn", "ml", "mb")


def estimate(n: Column, labels: Column, blocked: Column, above: Column) -> Column:
    free = (n - labels) * F.lit(UNLABELLED_WEIGHT)
    return (blocked + free * F.lit(PRIOR) + above * F.lit(PARENT_WEIGHT)) / (labels + free + F.lit(PARENT_WEIGHT))


def shape_estimates(shapes: DataFrame, levels: list | None = None) -> DataFrame:
    """(host, shape, e): for each shape (host, shape, n rows, l labels, b blocked) the estimate of the
    deepest branch on its way down the tree.  levels: a list that gets the number of levels built."""
    segments = F.split("shape", "/")

    def measured(rows: DataFrame, key: str, few: bool) -> DataFrame:
        """rows with their node's labels, its number of shapes, and how many segments these share next; more:
        whether any goes on."""
        rest = F.slice(segments, F.col("at") + 2, F.greatest(F.size(segments) - F.col("at") - 1, F.lit(0)))
        size = rows.groupBy(key).agg(F.count("*").alias("kinds"), F.sum("n").alias("n_node"), F.sum("l").alias("l_node"), F.sum("b").alias("b_node"), F.min(rest).alias("lo"), F.max(rest).alias("hi"))
        # What the first and the last in order have in common, all between them have.
        apart = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False)
        shared = F.when(apart > 0, apart - 1).otherwise(F.size("lo")).cast("int")
        return with_stats(rows, size.select(key, "kinds", "n_node", "l_node", "b_node", shared.alias("shared"), (F.size("hi") > 0).alias("more")), [key], ["shape"], few)

    few = shapes.count() <= BROADCAST_ROWS
    state = measured(shapes.withColumn("at", F.lit(0)), "host", few).withColumns({"node": F.md5("host"), "e": estimate(F.col("n_node"), F.col("l_node"), F.col("b_node"), F.lit(PRIOR))})
    # A node is built on while some of its urls are known to be blocked, some are not, and it has several shapes that go on.
    further = F.col("more") & (F.col("b_node") > 0) & (F.col("b_node") < F.col("n_node")) & (F.col("kinds") > 1)
    done, i = None, 0
    while True:
        state, _ = materialize(state, f"templates{i}")
        settled = state.where(~further).select("host", "shape", "e")
        done = settled if done is None else done.unionByName(settled)
        left = state.where(further).count()
        few = left <= BROADCAST_ROWS
        if not left:
            if levels is not None:
                levels.append(i)
            return done
        i += 1
        # Levels on which all go the same way are passed at once.
        open_ = state.where(further).withColumn("at", F.col("at") + F.col("shared"))
        open_ = open_.withColumns({"c": F.get(segments, F.col("at") + 1), "x": F.coalesce(F.get(segments, F.col("at") + 2), F.lit("/"))})  # no segment is a slash
        kids = branches(open_.select("node", "c", "x", "n", "l", "b"), few)
        end = F.coalesce("c", F.lit("/"))
        down = with_stats(open_.withColumn("c", end), kids.withColumn("c", end), ["node", "c"], ["shape"], few)
        e = estimate(F.col("mn"), F.col("ml"), F.col("mb"), F.col("e"))
        down, _ = materialize(down.select("host", "shape", "n", "l", "b", (F.col("at") + 1).alias("at"), F.md5(F.concat_ws("/", "node", "m")).alias("node"), (F.col("c") == "/").alias("ends"), e.alias("e")), f"below{i}")
        done = done.unionByName(down.where("ends").select("host", "shape", "e"))
        state = measured(down.where("NOT ends").drop("ends"), "node", few)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label_col: str | None = None, levels: list | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each input row.

    label_col: a column of known verdicts (allow, block; anything else is none), from which the tree
    learns where no rule fits; the verdict stays the tree's.  A null url, or one without "://", has
    empty host and path and no rule; hosts without any label are allowed.  Ids pass through, null or
    repeated; repeated rows count as often as they occur; other columns are ignored; an empty table
    gives an empty result.
    """
    with scratch_scope(pages.sparkSession) as scope:
        host, path = host_and_path(F.col(url_col).cast("string"))
        known = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), known.alias("label"))
        name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
        rows = rows.withColumns({"rule": name, "ruled": verdict, "shape": F.array_join(F.transform(F.split("path", "/"), segment_class), "/")})
        label = F.coalesce("ruled", F.when(F.col("label").isin("allow", "block"), F.col("label")))
        counts = rows.select("host", "shape", "ruled", label.alias("label")).groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("l"), F.count_if(F.col("label") == "block").alias("b"), F.count_if(F.col("ruled").isNull()).alias("asked"))
        shapes, _ = materialize(counts, "shapes")
        judged = shape_estimates(shapes.drop("asked"), levels).where("e >= 0.5")
        # Only urls without a rule ask for the tree's verdict; the others, and a hot url, are spread.
        bad = judged.join(shapes.where("asked > 0").select("host", "shape"), ["host", "shape"]).select("host", "shape", F.lit(True).alias("bad"), F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("_part"))
        part = F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)).cast("int")
        asked = rows.withColumn("_part", F.when(F.col("ruled").isNull(), part % SALT).otherwise(-1 - part))
        out = asked.join(bad, ["host", "shape", "_part"], "left")
        return finished(out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")), "url-verdicts", scope)
