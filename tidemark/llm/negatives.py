"""Hard negatives by exact inner products in a residue number system.

Components become whole numbers (256 steps to one).  A product of two matrices of them is taken modulo
several small primes: centred residues are so small that float32 adds a whole block of their products
exactly (every partial sum stays within 2^24), so the work is plain single-precision matrix
multiplication.  Chinese remaindering in balanced mixed radix then gives the signed score itself; the
number of primes follows from the Cauchy-Schwarz bound of the data.

Anchors, a stated set of rows, meet all rows in blocks: every pair of (block of anchors, group of rows) is
one cogroup of bounded size, whatever labels or copies the rows have.  It returns what can still be
among the first of each anchor, and a window over these few rows selects.  Two rounds: the first
rows of an anchor's own label are its positives; their scores bound the windows of the negatives.

Rows: a null label, a null vector or any null or non-finite component takes a row out; so does a vector
whose squared length in steps is 2^60 or more, as its scores would leave the range of a long.  A shorter
vector counts as followed by zeros, an empty one has score 0 with every other.  A row without an id is
nobody's anchor and comes last among ties; rows that share an id are rows of their own (several anchors
of one id repeat the result) but never partners of an anchor with that id.  Other columns are not looked
at and not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.stage import stage

c = F.col
STEPS, EXACT, SPAN = 256, 1 << 24, 1024
MOST = float(1 << 60)
#: Bytes of whole numbers in a block of anchors and in a group of rows, and cells of a matrix of scores.
ANCHOR_BYTES, ROW_BYTES, CELLS = 16 << 20, 8 << 20, 1 << 22


def primes_for(width: int, bound: int) -> list[int]:
    """Odd primes, largest first, whose centred residues multiply exactly in float32 over ``width`` components at
    once, and whose product exceeds twice ``bound``."""
    half = math.isqrt(EXACT // max(1, min(width, SPAN)))
    out, product, p = [], 1, 2 * min(half, 1 << 10) + 1
    while product <= 2 * bound:
        if p < 3:
            raise ValueError("no primes are left for this width")
        if all(p % x for x in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(q: np.ndarray, p: int) -> np.ndarray:
    """Centred residues as float32."""
    r = np.mod(q, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact scores of rows of ``a`` with rows of ``b``, both given as their residues by prime."""
    total = np.zeros((len(a[0]), len(b[0])), np.int64)
    scale = 1
    for p, x, y in zip(primes, a, b):
        r = np.zeros(total.shape, np.int64)
        for at in range(0, x.shape[1], SPAN):
            r += (x[:, at : at + SPAN] @ y[:, at : at + SPAN].T).astype(np.int64)
        # the next digit in balanced mixed radix: what is missing of the residue, divided by the primes so far
        digit = np.mod((np.mod(r, p) - np.mod(total, p)) * pow(scale, -1, p), p)
        digit[digit > p // 2] -= p
        total += digit * scale
        scale *= p
    return total


def prepared(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``label``, ``q`` (whole components) of the rows that take part."""
    d = vectors.select(c("vec_id").cast("long").alias("vec_id"), c("label").cast("long").alias("label"), c(vector).cast("array<double>").alias("x"))
    # a component of 2^22 or more alone has a square of 2^60 in steps
    small = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 22)))
    d = d.where(c("label").isNotNull() & c("x").isNotNull() & F.coalesce(small, F.lit(False)))
    d = d.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * STEPS).cast("int")).alias("q"))
    return d.withColumn("norm", F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).where(c("norm") < MOST)


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose id is divisible by ``every`` get the next of ``labels`` labels."""
    return vectors.withColumn("label", F.when(c("vec_id") % every == 0, (c("label") + 1) % labels).otherwise(c("label")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = column.flatten().to_numpy()
    return out


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and which are null."""
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def _by_id(rows: pa.Table) -> pa.Table:
    """Ascending ids, those without one last; then in the order of rows."""
    return rows.take(pc.sort_indices(rows, sort_keys=[("vec_id", "ascending"), ("row", "ascending")], null_placement="at_end"))


def _scores(anchors: pa.Table, rows: pa.Table, primes: list[int], width: int):
    """Chunks of anchors: their place, scores, and which rows have their label and may be partners."""
    ids, none = _numbers(rows.column("vec_id"))
    label = rows.column("label").to_numpy()
    q = _matrix(rows.column("q"), width)
    right = [residues(q, p) for p in primes]
    step = max(1, CELLS // max(1, len(label)))
    for at in range(0, anchors.num_rows, step):
        part = anchors.slice(at, step)
        q = _matrix(part.column("q"), width)
        score = products([residues(q, p) for p in primes], right, primes)
        own = part.column("vec_id").to_numpy()[:, None] == ids[None, :]
        own[:, none] = False
        yield part, score, part.column("label").to_numpy()[:, None] == label[None, :], ~own


def _positives(primes: list[int], width: int, most: int):
    """The first rows of an anchor's label in one group of rows."""
    schema = pa.schema([("anchor", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, out = _by_id(rows), [schema.empty_table()]
        ids, places = rows.column("vec_id").combine_chunks(), rows.column("row").combine_chunks()
        none = np.iinfo(np.int64).min
        for part, score, same, other in _scores(anchors, rows, primes, width) if rows.num_rows else ():
            score[~(same & other)] = none
            line = np.arange(len(score))
            for _ in range(min(most, score.shape[1])):
                best = score.argmax(axis=1)  # the first of equal scores: the smallest id
                found = score[line, best]
                some = found != none
                if not some.any():
                    break
                at = pa.array(best[some])
                out.append(pa.table([part.column("row").combine_chunks().filter(pa.array(some)), ids.take(at), places.take(at), pa.array(found[some])], schema=schema))
                score[line, best] = none
        return pa.concat_tables(out)

    return run


def _negatives(primes: list[int], width: int, most: int, low: int, high: int):
    """The first rows of other labels in one group of rows, within the window of each positive."""
    fields = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "vec_id", "row", "score"]
    schema = pa.schema([(x, pa.int64()) for x in fields])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows, out = _by_id(rows), [schema.empty_table()]
        ids, places = rows.column("vec_id").combine_chunks(), rows.column("row").combine_chunks()
        for part, score, same, other in _scores(anchors, rows, primes, width) if rows.num_rows else ():
            positives = part.column("positives").combine_chunks()
            of = pc.list_parent_indices(positives).to_numpy()
            flat = positives.flatten()
            p = flat.field("score").to_numpy()
            # low * p <= high * n and n <= p, as whole numbers
            least = -((-low * p) // high)
            floor, top = np.full(len(score), np.iinfo(np.int64).max), np.full(len(score), np.iinfo(np.int64).min)
            np.minimum.at(floor, of, least)
            np.maximum.at(top, of, p)
            line, at = np.nonzero((score >= floor[:, None]) & (score <= top[:, None]) & ~same & other)
            n = score[line, at]
            # by anchor, the highest first, then the smallest id
            order = np.lexsort((at, -n, line))
            line, at, n = line[order], at[order], n[order]
            begin = np.searchsorted(line, of)
            end = np.searchsorted(line, of, "right")
            for k in range(len(p)):
                own = slice(begin[k], end[k])
                # scores fall within an anchor's rows: those in the window stand together
                first = np.searchsorted(-n[own], -p[k])
                last = min(np.searchsorted(-n[own], -least[k], "right"), first + most)
                if first < last:
                    hit = np.arange(begin[k] + first, begin[k] + last)
                    m = len(hit)
                    i = int(of[k])
                    fixed = [part.column("row")[i], part.column("vec_id")[i], flat.field("place")[k], flat.field("vec_id")[k], flat.field("score")[k]]
                    some = pa.array(at[hit])
                    out.append(pa.table([*[pa.repeat(x.cast(pa.int64()), m) for x in fixed], ids.take(some), places.take(some), pa.array(n[hit])], schema=schema))
        return pa.concat_tables(out)

    return run


def hard_negatives(vectors: DataFrame, anchors_every: int = 100, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``vectors`` (``vec_id``, ``label``, ``q``, as ``prepared`` gives) -> ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    Anchors are the rows whose id is divisible by ``anchors_every``; their positives the first ``n_positives`` other rows
    of their label; for each, the first ``n_negatives`` rows of other labels with low * positive_score <= high * score
    <= high * positive_score.  Higher scores come first, ties by smaller id.
    """
    # written with its numbers, so that they stay what they are
    rows = stage(vectors.select("vec_id", "label", "q", "norm").withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_anchor = c("vec_id") % anchors_every == 0
    n, n_anchors, width, norm, anchor_norm = rows.agg(
        F.count("*"), F.count_if(is_anchor), F.max(F.size("q")), F.max("norm"), F.max(F.when(is_anchor, c("norm")))
    ).first()
    width = max(1, width or 0)
    primes = primes_for(width, int(math.sqrt((norm or 0.0) * (anchor_norm or 0.0)) * 1.000001) + 1)
    spark = rows.sparkSession
    # groups are small enough for a task and many enough for the cores
    per_group = min(max(1, ROW_BYTES // (4 * width)), max(2048, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    groups, blocks = max(1, -(-n // per_group)), max(1, -(-n_anchors * 4 * width // ANCHOR_BYTES))
    deal = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")

    def meet(anchors: DataFrame, run, schema: str) -> DataFrame:
        one = anchors.select("*", deal(blocks).alias("a_block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("a_group"))
        two = rows.select("row", "vec_id", "label", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("r_block"), deal(groups).alias("r_group"))
        return one.groupBy("a_block", "a_group").cogroup(two.groupBy("r_block", "r_group")).applyInArrow(run, schema)

    anchors = rows.where(is_anchor).select("row", "vec_id", "label", "q")
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(c("score").desc(), c("vec_id").asc_nulls_last(), "row"))
    near = meet(anchors, _positives(primes, width, n_positives), "anchor long, vec_id long, row long, score long")
    near = near.withColumn("place", first("anchor")).where(c("place") <= n_positives)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    with_positives = stage(anchors.join(near.withColumnRenamed("anchor", "row"), "row"), "positives")
    fields = "anchor long, anchor_id long, place long, positive_id long, positive_score long, vec_id long, row long, score long"
    out = meet(with_positives, _negatives(primes, width, n_negatives, low, high), fields)
    out = out.withColumn("rank", first("anchor", "place")).where(c("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", c("vec_id").alias("negative_id"), "positive_score", c("score").alias("negative_score"))
