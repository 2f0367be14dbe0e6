"""Order statistics of everything known so far, for series of any length.

The distinct values of a series are numbered in order.  Read as digits of ``BITS`` bits the numbers form a
tree, and the k-th smallest value of a prefix of time is found by going down that tree: at every level
the known values of each child up to the row's time are counted, and the rank says which child to go on
with.  The counts are running sums per (series, node) over chunks of time with one carried row of
counts per chunk, so no task holds a series, a node or a group of equal values, and the number of levels
grows with the logarithm of the distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.panel import Panel, Running
from tidemark.stage import stage

c = F.col
BITS, EDGES = 4, 256


def numbered_values(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """``by``, ``_v``, ``_r``: the distinct values of each group and their numbers from 0, in order.

    Edges of a sketch cut a group's values into intervals of about equal size; each is numbered by itself and
    starts after those below.  The numbers are exact whatever the edges are.
    """
    v = rows.where(c(x).isNotNull()).groupBy(*by, c(x).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    cut = F.array(*[F.lit(i / EDGES) for i in range(1, EDGES)])
    edges = v.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", cut, F.lit(20 * EDGES))).alias("_edges"))
    v = v.join(edges, by).select(*by, "_v", F.size(F.filter("_edges", lambda e: e < c("_v"))).alias("_k"))
    # a group has at most EDGES intervals
    size = v.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(*by, "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_k").orderBy("_v")) - 1
    return v.join(size, [*by, "_k"]).select(*by, "_v", (c("_before") + place).alias("_r"))


def _child_counts(rows: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """Adds ``_c0`` .. to the rows of each (``by``, ``_node``): how many values of each child stand at ``_o`` or before."""
    names = [f"_c{d}" for d in range(1 << BITS)]
    rows = rows.withColumn("_chunk", F.floor(c("_o") / chunk)).withColumns({x: (F.coalesce(c("_child") == d, F.lit(False))).cast("long") for d, x in enumerate(names)})
    rows = rows.repartition(*by, "_node", "_chunk")
    part = rows.groupBy(*by, "_node", "_chunk").agg(*[F.sum(x).alias(x) for x in names])
    before = Window.partitionBy(*by, "_node").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    seeds = part.withColumns({x: F.coalesce(F.sum(x).over(before), F.lit(0)) for x in names}).repartition(*by, "_node", "_chunk")
    # the carried counts stand before the first row of the chunk
    both = rows.unionByName(seeds.withColumn("_o", F.lit(None).cast("long")), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_node", "_chunk").orderBy(c("_o").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({x: F.sum(x).over(w) for x in names}).drop("_chunk")


def expanding_ranked(df: DataFrame, panel: Panel, x: str, ranks: Column, out: str) -> DataFrame:
    """Adds ``out``: the mean of the values whose ranks (from 0, among the known values of ``x`` up to the row) ``ranks`` lists;
    ``_n`` stands for the number of known values.  Null where nothing is known yet.  One row per key and time."""
    by = list(panel.keys)
    rows = df.select(*by, panel.ts, c(x).cast("double").alias("_v")).withColumn("_v", F.when(~F.isnan("_v"), c("_v")))
    counted = panel.running(rows, {"_n": Running(c("_v"), "count")})
    numbers = stage(numbered_values(rows, by, "_v"), "numbered")
    known = counted.join(numbers, [*by, "_v"], "left").select(*by, panel.ts, "_n", "_r", panel.pos().alias("_pos"))
    known = stage(known, "ranked")
    levels = max(1, -(-int(numbers.agg(F.max("_r")).first()[0] or 0).bit_length() // BITS))
    wanted = known.where("_n > 0").select(*by, panel.ts, "_pos", F.explode(F.array_distinct(ranks)).alias("_k"))
    wanted = wanted.withColumn("_node", F.lit(0).cast("long"))
    names = [c(f"_c{d}") for d in range(1 << BITS)]
    upto = [reduce(lambda a, b: a + b, names[: d + 1]) for d in range(1 << BITS)]
    for level in reversed(range(levels)):
        r = c("_r").cast("long")
        values = known.where("_r is not null").select(
            *by, F.shiftright(r, BITS * (level + 1)).alias("_node"), F.shiftright(r, BITS * level).bitwiseAND((1 << BITS) - 1).alias("_child"), (2 * c("_pos")).alias("_o")
        )
        # a value counts for its own row: the question stands right after it
        asked = wanted.withColumn("_o", 2 * c("_pos") + 1)
        found = _child_counts(values.unionByName(asked, allowMissingColumns=True), by, 2 * panel.chunk_rows).where(c("_k").isNotNull())
        below = [F.when(s <= c("_k"), s).otherwise(0) for s in upto]
        child = reduce(lambda a, b: a + b, [(s <= c("_k")).cast("long") for s in upto])
        wanted = found.select(*by, panel.ts, "_pos", (c("_k") - F.greatest(*below)).alias("_k"), (F.shiftleft(c("_node"), BITS) + child).alias("_node"))
    got = wanted.join(numbers.withColumnRenamed("_r", "_node"), [*by, "_node"]).groupBy(*by, panel.ts).agg(F.avg("_v").alias(out))
    return df.join(got, [*by, panel.ts], "left")


def expanding_median(df: DataFrame, panel: Panel, x: str, out: str) -> DataFrame:
    """Median of all known values up to and with each row."""
    n = c("_n").cast("long")
    return expanding_ranked(df, panel, x, F.array(F.floor((n - 1) / 2), F.floor(n / 2)), out)
