"""Connected components and verified links between sets, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.stage import stage

c = F.col
#: Open sets of a bucket that meet in one group.
CELL = 1000


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` -> ``node``, ``component``: the smallest node that each node reaches.

    Large-star and small-star rounds (Kiveris et al. 2014): every round reduces the neighbours of a
    node to their minimum with a map-side part and joins it back to the edges, so a node with many
    neighbours is never gathered.  Each round is written to the shared folder.
    """
    e = stage(edges.select("a", "b").where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(c("b").alias("a"), c("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # every neighbour above the node points at the node's smallest neighbour
        e = both.join(low, "a").where("b > a").select(c("b").alias("a"), c("m").alias("b")).distinct()
        e = stage(e, "large-star")
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        # the smaller neighbours and the node itself point at the smallest of them
        e = e.join(low, "a").select(F.explode(F.array(F.struct(c("b").alias("a"), c("m").alias("b")), F.struct("a", c("m").alias("b")))).alias("s")).select("s.*")
        e = stage(e.where("a != b").distinct(), "small-star")
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == seen:
            break
        seen = now
    return e.select(c("a").alias("node"), c("b").alias("component")).union(e.select(c("b").alias("node"), c("b").alias("component")).distinct())


def labels(links: DataFrame) -> DataFrame:
    """``a`` < ``b`` links -> ``node``, ``component``: the smallest neighbour, and that one's smallest neighbour if
    it has a smaller one.  Nodes with one label are connected; connected nodes may still have two.  One
    aggregation and one join, for steps that only want to skip what is merged already."""
    low = links.groupBy(c("b").alias("node")).agg(F.min("a").alias("m"))
    low = stage(low, "labels")
    up = low.select(c("node").alias("m"), c("m").alias("mm"))
    return low.join(up, "m", "left").select("node", F.coalesce("mm", "m").alias("component"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b`` pairs with ``overlap`` and ``total`` (sizes of intersection and union), ``gap_a``, ``gap_b`` (which of
    64 hash cells hold what one set has and the other lacks) and ``linked``: 100 * overlap >= percent * total.
    ``sets``: ``node``, ``shingles``."""
    cells = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda bits, s: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int"))))
    one = sets.select(c("node").alias("a"), c("shingles").alias("_sa"))
    two = sets.select(c("node").alias("b"), c("shingles").alias("_sb"))
    j = pairs.select("a", "b").join(one, "a").join(two, "b")
    j = j.select(
        "a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("overlap"), (F.size("_sa") + F.size("_sb")).alias("_n"),
        cells(F.array_except("_sa", "_sb")).alias("gap_a"), cells(F.array_except("_sb", "_sa")).alias("gap_b"),
    )
    return j.select("a", "b", "overlap", (c("_n") - c("overlap")).alias("total"), "gap_a", "gap_b").withColumn("linked", 100 * c("overlap").cast("long") >= percent * c("total").cast("long"))


def most_shared() -> Column:
    """How many shingles x and y can share at most, told by their comparisons with one set o: ``original`` (size of o), ``lacks``
    and ``gap`` (how much of o is lacking, and its cells), ``over`` and ``more`` (how much is not in o, and its cells), ``extra`` (so much
    of ``over`` as some other set has) and ``common`` (so much of the set)."""
    only = lambda x, y: F.bit_count(c(x).bitwiseAND(F.bitwise_not(c(y))))
    apart = F.when(c("x.gap").bitwiseAND(c("y.gap")) == 0, c("x.lacks") + c("y.lacks")).otherwise(0)
    lacking = F.greatest(apart, c("x.lacks") + only("y.gap", "x.gap"), c("y.lacks") + only("x.gap", "y.gap"))
    outside = F.least("x.extra", "y.extra", c("x.over") - only("x.more", "y.more"), c("y.over") - only("y.more", "x.more"))
    return F.least(c("x.original") - lacking + outside, "x.common", "y.common")


def linked_classes(keys: DataFrame, sizes: DataFrame, sets_of, percent: int, known: DataFrame | None = None) -> DataFrame:
    """Verified components of sets that meet in hash tables: ``node``, ``component`` of all linked nodes.

    ``keys``: ``key``, ``node``, one row per table a set is in; ``sizes``: ``node``, ``n``; ``sets_of(nodes)``
    gives ``node``, ``shingles`` of the asked nodes; ``known``: ``a``, ``b`` links that hold anyway.  No link between two sets that meet in a bucket is lost:

    1. each set is compared with the smallest set of each of its buckets (a star, linear in the rows) and
       what is verified is merged;
    2. where a bucket still holds several components, shingles that none of the sets in question shares
       are counted: they are in no intersection, so a set with too many of them has no link left.  The
       others are compared with the set of their bucket that has the smallest share of such shingles,
       the likeliest original of a family of copies, and merged again;
    3. in buckets that are still mixed every pair of different components is compared, unless it cannot be
       linked.  With o the set of step 2, which both were compared with, x and y share at most what o
       has less what either lacks of it, and outside of o at most what neither has for itself.  Hash cells
       bound both from the two comparisons alone: a cell that only one gap fills is at least one more
       that is lacking, a cell that only one set's own shingles fill at least one that is not shared.  A
       bucket of more than ``CELL`` open sets is cut into parts, and each pair of parts is a group of its own.
    """
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    lead = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("_top")).where("lead != _top").drop("_top")
    shared = stage(keys.join(lead, "key"), "buckets")  # rows of buckets with two sets or more
    star = stage(shared.where("lead != node").select(*ordered(c("lead"), c("node"))).distinct(), "star")
    nodes = star.select(c("a").alias("node")).union(star.select(c("b").alias("node"))).distinct()
    sets = stage(sets_of(nodes), "sets")
    first = stage(verified(star, sets, percent), "verified")
    comp = labels(first.where("linked"))

    def mixed(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """Rows of buckets with two components or more, with their components."""
        rows = rows.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = rows.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("held")).where("_lo != _hi").select("key", "held")
        return rows.join(several, "key")

    left = stage(mixed(shared.select("key", "node"), comp).drop("component", "held").join(sizes, "node"), "mixed")
    own = sets.join(left.select("node").distinct(), "node").select("node", F.explode("shingles").alias("s"))
    private = own.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("_top")).where("node = _top").groupBy("node").agg(F.count("*").alias("u"))
    left = left.join(private, "node", "left").withColumn("common", c("n") - F.coalesce("u", F.lit(0)))
    left = stage(left.where(100 * c("common") >= percent * c("n")).drop("u"), "open")
    best = left.groupBy("key").agg(F.min(F.struct((1 - c("common") / c("n")).alias("share"), c("node").alias("near"))).alias("_b")).select("key", "_b.near")
    left = stage(left.join(best, "key"), "led")
    star = left.where("near != node").select(*ordered(c("near"), c("node"))).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = stage(verified(star, sets, percent), "verified")
    tested = first.union(second)
    comp = labels(tested.where("linked"))
    seen = tested.select("a", "b", "overlap", "total", "gap_a", "gap_b").dropDuplicates(["a", "b"])
    # the set all others were compared with has no open pair in its bucket
    left = left.where("near != node").select("*", *ordered(c("near"), c("node"))).join(seen, ["a", "b"])
    left = left.withColumns(
        {
            "original": c("total") + c("overlap") - c("n"), "lacks": c("total") - c("n"), "gap": F.when(c("near") == c("a"), c("gap_a")).otherwise(c("gap_b")),
            "extra": c("common") - c("overlap"), "over": c("n") - c("overlap"), "more": F.when(c("near") == c("a"), c("gap_b")).otherwise(c("gap_a")),
        }
    ).select("key", "node", "n", "common", "original", "lacks", "gap", "extra", "over", "more")
    left = mixed(left, comp)
    # a pair is emitted in the first of the buckets its sets share; a set is in one bucket per table
    left = stage(left.join(left.groupBy("node").agg(F.collect_list("key").alias("keys")), "node"), "mixed")
    # every set meets its bucket part by part: one part, and no copy of a row, up to CELL sets
    parts = F.ceil(c("held") / CELL).cast("int")
    left = left.withColumns({"part": F.pmod(F.xxhash64("node"), parts).cast("int"), "each": F.sequence(F.lit(0), parts - 1)})
    x = left.withColumn("other", F.explode("each")).alias("x")
    y = left.withColumnRenamed("part", "other").withColumn("part", F.explode("each")).alias("y")
    near = (
        (c("x.key") == c("y.key")) & (c("x.part") == c("y.part")) & (c("x.other") == c("y.other")) & (c("x.component") < c("y.component"))
        & (100 * most_shared() >= percent * (c("x.n") + c("y.n") - most_shared())) & (c("x.key") == F.array_min(F.array_intersect("x.keys", "y.keys")))
    )
    rest = x.join(y, near).select(*ordered(c("x.node"), c("y.node"))).distinct()
    third = verified(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, percent)
    links = tested.where("linked").select("a", "b").union(third.where("linked").select("a", "b"))
    return components(links if known is None else links.union(known.select("a", "b")))
