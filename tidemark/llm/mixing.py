"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in one order; each has the same expected number of copies,
target / size of the source.  The prefix sum of these expectations plus one random offset per source
crosses an integer once for every copy to emit.  The order is by size, so neighbours are alike and a
source's words come out near its target: the copies of any run of the order differ from the expected
number by less than one.

The prefix sum needs no window over a source: ranks come from counts per (source, size), counts per
(source, size, part of the ids) and a position inside such a part, so a source with a third of all
rows is split like any other.

Rows: a null source is a source of its own and comes last; a null or empty text has size 0 and is
taken with 0 words; rows with the same id are separate documents in an arbitrary but fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
PARTS = 997


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` (one row per source) with ``target``: shares by weight, none above ``most``
    times the source's size.

    Handing the excess on until none is above ends where every source below its limit gets the same
    amount per unit of weight; sorted by limit per weight, that level is found by prefix sums."""
    order = W.orderBy(c("source").asc_nulls_last())
    s = sizes.withColumn("_k", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_k", F.lit(len(weights))) + 1))
    s = s.withColumns({"_cap": c("source_size") * F.lit(most), "_all": F.sum("source_size").over(W.partitionBy()) * F.lit(share)})
    up = W.orderBy(c("_cap") / c("weight"), "_k")
    s = s.withColumns(
        {
            "_below": F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "_w": F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    # the level if this source and all after it stay below their limits
    s = s.withColumn("_level", (c("_all") - c("_below")) / c("_w"))
    s = s.withColumn("_level", F.max(F.when(c("_level") * c("weight") <= c("_cap"), c("_level"))).over(W.partitionBy()))
    return s.select("source", "source_size", "weight", F.least(c("_cap"), F.coalesce(c("_level") * c("weight"), c("_cap"))).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) for each source."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST, parts: int = PARTS) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``) -> ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``."""
    d = docs.select(c("doc_id").cast("long").alias("doc_id"), "source", n_words(c("text")).alias("size"))
    part = F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(parts))
    d = d.withColumn("_p", part)
    cells = d.groupBy("source", "size", "_p").agg(F.count("*").alias("_n"))
    sized = cells.groupBy("source", "size").agg(F.sum("_n").alias("_n"))
    aim = targets(sized.groupBy("source").agg(F.sum(c("size") * c("_n")).alias("source_size")), weights, share, most)
    past = lambda key, by: F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumn("_a", past(["source"], "size")).drop("_n")
    cells = cells.withColumn("_b", past(["source", "size"], "_p")).drop("_n")
    same = lambda x, y, *keys: [c(f"{x}.{k}").eqNullSafe(c(f"{y}.{k}")) for k in keys]
    cells = cells.alias("x").join(sized.alias("y"), same("x", "y", "source", "size")).join(aim.alias("t"), same("x", "t", "source"))
    rate = F.when(c("t.source_size") > 0, c("t.target") / c("t.source_size")).otherwise(0.0)
    cells = cells.select("x.source", "x.size", "x._p", (c("_a") + c("_b")).alias("_before"), "t.source_size", "t.target", rate.alias("_rate"))
    d = d.withColumn("_in", F.row_number().over(W.partitionBy("source", "size", "_p").orderBy("doc_id")))
    d = d.alias("d").join(cells.alias("e"), same("d", "e", "source", "size", "_p"))
    d = d.select("d.doc_id", "d.source", "d.size", "e.source_size", "e.target", "e._rate", (c("e._before") + c("d._in")).alias("_rank"), offset(c("d.source"), seed).alias("_u"))
    copies = F.floor(c("_rank") * c("_rate") + c("_u")) - F.floor((c("_rank") - 1) * c("_rate") + c("_u"))
    return d.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the number of the copy in ``copy`` (from 1).

    Rows that agree in id, source and size share their copies out in the order of their texts."""
    d = docs.drop("copy", "_size", "_turn").withColumn("_size", n_words(c("text")))
    alike = W.partitionBy("doc_id", "source", "_size")
    d = d.withColumn("_turn", F.row_number().over(alike.orderBy("text")))
    m = mixed(docs, **options).select(c("doc_id").alias("_i"), c("source").alias("_src"), c("size").alias("_n"), "copies")
    m = m.withColumn("_at", F.row_number().over(W.partitionBy("_i", "_src", "_n").orderBy(F.desc("copies")))).where("copies > 0")
    same = c("doc_id").eqNullSafe(c("_i")) & c("source").eqNullSafe(c("_src")) & (c("_size") == c("_n")) & (c("_turn") == c("_at"))
    out = d.join(m, same).withColumn("copy", F.explode(F.sequence(F.lit(1), c("copies").cast("int"))))
    return out.drop("_size", "_turn", "_i", "_src", "_n", "_at", "copies")
