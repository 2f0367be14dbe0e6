"""Recursive averages over whole series, exact and without a series in one task.

y follows the known values of x.  The first known value starts it; a row without a value keeps y; and a
value that comes k rows after the one before weighs in as (d^k y + alpha x) / (d^k + alpha) with
d = 1 - alpha, which is d y + alpha x where no row is missing: what was averaged fades with every row,
known or not.  Each known row is thus an affine step y -> a y + b, and affine steps can be merged:

1. inside a block of rows whose factors a multiply to no less than e^-30 the recursion has the closed
   form p * sum(b_j / p_j) with p the running product of the factors, a power of d but for gaps;
2. the blocks of a chunk are folded in order, as seen from the chunk's first known row, because only
   the chunks before tell how far back the last known value of that row lies;
3. chunks are folded in groups of ``GROUP``, groups in order, and every row adds what its block starts
   from.  Nothing is cut off, so a value keeps its digits however long the rows after it are zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.panel import CHUNK, Panel
from tidemark.stage import stage

c = F.col
NATS, GROUP = 30.0, 128
_GROUP = "_group"


def _decay(d: float, alpha: float, k: Column) -> tuple[Column, Column]:
    """Log of the factor of y and the factor of x, where the value before is k > 1 rows back."""
    far = F.pow(F.lit(d), k) + alpha
    return k * math.log(d) - F.ln(far), alpha / far


def _starts(steps: Column, first: Column, m: str, v: str) -> Column:
    """What each of the steps (m, v) starts from: the first value and the results of the steps before."""
    last = lambda ys, e: F.element_at(ys, -1) * e[m] + e[v]
    return F.aggregate(steps, F.array(first), lambda ys, e: F.concat(ys, F.array(last(ys, e))))


def _fold(steps: Column, first: Column, m: str, v: str) -> Column:
    return F.aggregate(steps, first, lambda y, e: y * e[m] + e[v])


def affine(df: DataFrame, panel: Panel, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds the recursive average of x for each name: (x, alpha).  Null and NaN are no values; rows before the
    first value of a series are null.  Rows are written once with what their block adds; a chunk is one small row after that."""
    keys, names = list(panel.keys), list(specs)
    inputs = sorted({x for x, _ in specs.values()})
    w = Window.partitionBy(*keys, CHUNK).orderBy(panel.ts)
    past, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({CHUNK: panel.chunk(), "_at": panel.pos()}).repartition(*keys, CHUNK)
    value = {x: F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")) for x in inputs}
    rows = rows.withColumns({f"_x_{x}": v for x, v in value.items()})
    rows = rows.withColumns({f"_k_{x}": c("_at") - F.last(F.when(c(f"_x_{x}").isNotNull(), c("_at")), ignorenulls=True).over(before) for x in inputs})
    # of a known row that is not the first of its chunk: _u is 1 for a plain step, whose factor stays a power of d, _a the
    # log of the factor after a gap; _b is what the row adds
    steps = {}
    for n, (x, alpha) in specs.items():
        k = c(f"_k_{x}")
        moves = c(f"_x_{x}").isNotNull() & k.isNotNull()
        a, b = _decay(1.0 - alpha, alpha, k)
        steps |= {
            f"_u_{n}": F.when(moves & (k == 1), 1).otherwise(0), f"_a_{n}": F.when(moves & (k > 1), a).otherwise(0.0),
            f"_b_{n}": F.when(moves, F.when(k == 1, F.lit(alpha)).otherwise(b) * c(f"_x_{x}")).otherwise(0.0),
        }
    rows = rows.withColumns(steps).withColumns({f"_{k}_{n}": F.sum(f"_{z}_{n}").over(past) for n in names for k, z in (("i", "u"), ("l", "a"))})
    power = lambda n, i, l: F.pow(F.lit(1.0 - specs[n][1]), i) * F.exp(l)  # noqa: E731, E741
    rows = rows.withColumns({f"_n_{n}": F.floor(-(c(f"_i_{n}") * math.log(1.0 - alpha) + c(f"_l_{n}")) / NATS) for n, (_, alpha) in specs.items()})
    inner = {n: Window.partitionBy(*keys, CHUNK, f"_n_{n}").orderBy(panel.ts).rowsBetween(Window.unboundedPreceding, 0) for n in names}
    # the running sums at the block's first row, and before it
    rows = rows.withColumns({f"_0{k}_{n}": F.first(f"_{k}_{n}").over(inner[n]) for n in names for k in "il"} | {f"_1{k}_{n}": F.first(c(f"_{k}_{n}") - c(f"_{z}_{n}")).over(inner[n]) for n in names for k, z in (("i", "u"), ("l", "a"))})
    since = {n: (c(f"_i_{n}") - c(f"_0i_{n}"), c(f"_l_{n}") - c(f"_0l_{n}")) for n in names}
    rows = rows.withColumns({f"_v_{n}": power(n, *since[n]) * F.sum(c(f"_b_{n}") * power(n, -since[n][0], -since[n][1])).over(inner[n]) for n in names})
    rows = rows.withColumns({f"_m_{n}": power(n, c(f"_i_{n}") - c(f"_1i_{n}"), c(f"_l_{n}") - c(f"_1l_{n}")) for n in names})
    # whether the next row of the chunk is of another block
    rows = rows.withColumns({f"_e_{n}": ~F.lead(f"_n_{n}").over(w).eqNullSafe(c(f"_n_{n}")) for n in names})
    rows = rows.drop(*[f"_{k}_{n}" for k in ("u", "a", "b", "i", "l", "0i", "0l", "1i", "1l") for n in names])

    # written: chunk summaries and rows both follow from it, and recursive columns of recursive columns would plan it again and again
    rows = stage(rows.drop(*[f"_k_{x}" for x in inputs]), "recursive")

    known = {x: c(f"_x_{x}").isNotNull() for x in inputs}
    chunks = rows.groupBy(*keys, CHUNK).agg(
        *[F.min_by(f"_x_{x}", F.when(known[x], c("_at"))).alias(f"_x_{x}") for x in inputs],
        *[F.min(F.when(known[x], c("_at"))).alias(f"_lo_{x}") for x in inputs], *[F.max(F.when(known[x], c("_at"))).alias(f"_hi_{x}") for x in inputs],
        *[F.sort_array(F.collect_list(F.when(c(f"_e_{n}"), F.struct(c(f"_n_{n}").alias("n"), c(f"_m_{n}").alias("m"), c(f"_v_{n}").alias("v"))))).alias(f"_e_{n}") for n in names],
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({f"_k_{x}": c(f"_lo_{x}") - F.last(f"_hi_{x}", ignorenulls=True).over(earlier) for x in inputs})
    chunks = chunks.withColumns({f"_any_{x}": F.coalesce(F.max(F.col(f"_hi_{x}").isNotNull()).over(earlier), F.lit(False)) for x in inputs})
    whole, entry = {}, {}
    for n, (x, alpha) in specs.items():
        k = c(f"_k_{x}")
        a, b = _decay(1.0 - alpha, alpha, k)
        # the first known row as a step from what the chunk starts with
        entry[n] = (
            F.when(k.isNull(), F.lit(0.0)).when(k == 1, F.lit(1.0 - alpha)).otherwise(F.exp(a)),
            F.when(k.isNull(), c(f"_x_{x}")).when(k == 1, F.lit(alpha) * c(f"_x_{x}")).otherwise(b * c(f"_x_{x}")),
        )
        none = c(f"_x_{x}").isNull()
        rest = F.aggregate(f"_e_{n}", F.lit(1.0), lambda y, e: y * e["m"])
        whole[f"_m_{n}"] = F.when(none, F.lit(1.0)).otherwise(entry[n][0] * rest)
        whole[f"_v_{n}"] = F.when(none, F.lit(0.0)).otherwise(_fold(c(f"_e_{n}"), entry[n][1], "m", "v"))
    chunks = chunks.withColumns(whole).withColumn(_GROUP, F.floor(c(CHUNK) / GROUP))
    pairs = [f"_{k}_{n}" for n in names for k in "mv"]
    groups = chunks.groupBy(*keys, _GROUP).agg(F.sort_array(F.collect_list(F.struct(CHUNK, *pairs))).alias("_chunks"))
    ones = lambda i: F.aggregate(c("_chunks"), F.lit(1.0), lambda y, e: y * e[i])
    totals = [z for n in names for z in (ones(f"_m_{n}").alias(f"_m_{n}"), _fold(c("_chunks"), F.lit(0.0), f"_m_{n}", f"_v_{n}").alias(f"_v_{n}"))]
    series = groups.select(*keys, _GROUP, *totals).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(_GROUP, *pairs))).alias("_groups"))
    series = series.withColumns({f"_s_{n}": _starts(c("_groups"), F.lit(0.0), f"_m_{n}", f"_v_{n}") for n in names})
    series = series.select(*keys, F.posexplode("_groups").alias("_i", "_g"), *[f"_s_{n}" for n in names])
    series = series.select(*keys, c(f"_g.{_GROUP}").alias(_GROUP), *[F.get(f"_s_{n}", c("_i")).alias(f"_s_{n}") for n in names])
    begin = groups.join(series, [*keys, _GROUP]).withColumns({f"_s_{n}": _starts(c("_chunks"), c(f"_s_{n}"), f"_m_{n}", f"_v_{n}") for n in names})
    begin = begin.select(*keys, F.posexplode("_chunks").alias("_i", "_g"), *[f"_s_{n}" for n in names])
    begin = begin.select(*keys, c(f"_g.{CHUNK}").alias(CHUNK), *[F.get(f"_s_{n}", c("_i")).alias(f"_s_{n}") for n in names])

    chunks = chunks.join(begin, [*keys, CHUNK])
    # what each block starts from; the first one begins at the chunk's first known row
    chunks = chunks.withColumns({f"_c_{n}": _starts(c(f"_e_{n}"), c(f"_s_{n}") * entry[n][0] + entry[n][1], "m", "v") for n in names})
    chunks = chunks.withColumns({f"_e_{n}": F.map_from_arrays(F.transform(f"_e_{n}", lambda e: e["n"]), F.slice(f"_c_{n}", 1, F.size(f"_e_{n}"))) for n in names})
    chunks = chunks.select(*keys, CHUNK, *[f"_{k}_{x}" for x in inputs for k in ("lo", "any")], *[f"_s_{n}" for n in names], *[c(f"_e_{n}").alias(f"_c_{n}") for n in names])
    out = rows.select(*df.columns, CHUNK, "_at", *[f"_{k}_{n}" for n in names for k in "nmv"]).join(chunks, [*keys, CHUNK])
    made = {}
    for n, (x, _) in specs.items():
        inside = F.element_at(f"_c_{n}", c(f"_n_{n}")) * c(f"_m_{n}") + c(f"_v_{n}")
        made[n] = F.when(c("_at") >= c(f"_lo_{x}"), inside).when(c(f"_any_{x}"), c(f"_s_{n}"))
    return out.withColumns(made).select(*df.columns, *names)
