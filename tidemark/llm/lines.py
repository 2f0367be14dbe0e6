"""Site-relative line frequency: lines that a large part of a host's pages carry are boilerplate.

A line is what stands between \\n; its key is the line without outer white space, A-Z lower-cased, so
case and indentation do not hide a repetition.  Per host the pages that contain a key are counted
(once per page) and divided by the host's pages; keys above ``ratio`` that at least ``least`` pages
carry are dropped wherever they stand.  Pages with the same keys in the same order are copies and count
as one page in both numbers: a text that is there many times is not boilerplate of itself.

Skew: copies are made one by their keys, with a map-side part, before lines are counted; (host, key)
counts have one as well, so a host or a line with a third of all rows is only partial sums.  A host has fewer than (distinct lines per page) / ratio boilerplate keys, whatever its
number of pages, so they travel as one array per host.  If the table of arrays is too large for Spark
to broadcast, both sides are salted.

Rows: a null host is a host of its own; a null or empty text stays as it is; empty lines are never
dropped; repeated rows are one page for the counts and keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
RATIO, LEAST, SALTS = 0.05, 5, 16
OUTER = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    ascii_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(OUTER)), ascii_upper, ascii_upper.lower())


def _hash(line: Column) -> Column:
    return F.xxhash64(line_key(line))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``host``, ``lines``: hashes of the lines to drop, one row per host that has any."""
    d = docs.select(c(host).alias("host"), F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(OUTER)) != ""), _hash)).alias("k")).distinct()
    total = d.groupBy("host").agg(F.count("*").alias("pages"))
    n = d.select("host", F.explode("k").alias("k")).groupBy("host", "k").agg(F.count("*").alias("n")).where(c("n") >= least)
    n = n.alias("n").join(total.alias("t"), c("n.host").eqNullSafe(c("t.host"))).where(c("n") > F.lit(ratio) * c("pages"))
    return n.groupBy("n.host").agg(F.collect_list("k").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``docs`` with ``text`` without boilerplate lines, ``n_lines`` and ``n_dropped``."""
    found = boilerplate(docs, host, ratio, least).select(c("host").alias("_h"), c("lines").alias("_drop"))
    found = found.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    d = docs.withColumn("_s", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    d = d.join(found, (c(host).eqNullSafe(c("_h"))) & (d["_s"] == found["_s"]), "left").drop("_h", "_s")
    lines = F.split("text", "\n")
    keep = F.filter(lines, lambda x: ~((F.btrim(x, F.lit(OUTER)) != "") & F.array_contains("_drop", _hash(x))))
    d = d.withColumn("_keep", F.when(c("_drop").isNull(), lines).otherwise(keep))
    n = F.coalesce(F.size(lines), F.lit(0))
    d = d.withColumns({"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size(lines) - F.size("_keep"), F.lit(0)).cast("long"), "text": F.array_join("_keep", "\n")})
    return d.drop("_drop", "_keep")
