"""How a panel of series is laid out over a cluster.

A panel is a DataFrame keyed by ``keys`` with one row per grid step in ``ts``.  Every step has an
integer *position* (days or hours since the epoch), so the *chunk* a row belongs to is plain
arithmetic: no sort and no global row number is needed to cut one very long series into pieces that
run on different executors.

Two patterns follow from that and everything else is built on them:

* ``halo``: bounded look-back.  Each row is also sent to the later chunks that need it as history,
  so row windows over ``(keys, chunk)`` see full frames.  One shuffle, no hot key.
* ``running``: unbounded frames (forward fill, cumulative max / sum / product).  One pre-aggregated
  summary per chunk is turned into one seed row per chunk, and the running window inside the
  chunk starts from that seed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
OWN = "_own"
_SEED = "_seed"

_STEP_SECONDS = {"day": 86400, "hour": 3600, "minute": 60}


@dataclass(frozen=True)
class Panel:
    """Layout of a panel: key columns, time column, grid step and chunk length in steps."""

    keys: tuple[str, ...] = ("series_id",)
    ts: str = "ts"
    step: str = "day"
    chunk_rows: int = 4096

    def by(self, *extra: str) -> "Panel":
        """The same layout with more key columns (scenario, seed, ...)."""
        return replace(self, keys=self.keys + tuple(extra))

    def pos(self, ts: Column | None = None) -> Column:
        ts = F.col(self.ts) if ts is None else ts
        if self.step == "day":
            return F.unix_date(ts.cast("date")).cast("long")
        seconds = F.unix_seconds(ts.cast("timestamp"))
        return F.floor(seconds / _STEP_SECONDS[self.step]).cast("long")

    def at(self, pos: Column) -> Column:
        """Inverse of ``pos``."""
        if self.step == "day":
            return F.date_from_unix_date(pos.cast("int"))
        return F.timestamp_seconds(pos * _STEP_SECONDS[self.step])

    def chunk(self, pos: Column | None = None) -> Column:
        return F.floor((self.pos() if pos is None else pos) / self.chunk_rows).cast("long")

    # -- bounded look-back -------------------------------------------------------------------

    def halo(self, df: DataFrame, back: int, ahead: int = 0) -> DataFrame:
        """Copy each row into every chunk whose rows look at it.

        ``back`` / ``ahead`` are the longest look-back and look-ahead in grid steps.  The copy
        factor is ``1 + (back + ahead) / chunk_rows``.
        """
        p = self.pos()
        chunks = F.sequence(self.chunk(p - ahead), self.chunk(p + back))
        return df.withColumn(CHUNK, F.explode(chunks)).withColumn(OWN, F.col(CHUNK) == self.chunk())

    def window(self, *more: str) -> WindowSpec:
        """Row order inside a chunk of a ``halo`` frame."""
        return Window.partitionBy(*self.keys, CHUNK, *more).orderBy(self.ts)

    def owned(self, df: DataFrame) -> DataFrame:
        """Drop the history copies again."""
        return df.filter(F.col(OWN)).drop(CHUNK, OWN)

    # -- unbounded look-back -----------------------------------------------------------------

    def with_origin(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """Adds ``_o_x``, the first known value of each series, for sums of squares of ``x - _o_x``: they keep
        their digits where the level of a series is far larger than its spread."""
        first = [F.min_by(x, F.when(F.col(x).isNotNull(), F.col(self.ts))).cast("double").alias(f"_o_{x}") for x in cols]
        return df.join(df.groupBy(*self.keys).agg(*first), list(self.keys))


    def running(
        self,
        df: DataFrame,
        specs: Mapping[str, "Running"],
        reverse: bool = False,
        levels: int = 1,
    ) -> DataFrame:
        """Add cumulative columns without putting a whole series into one window partition.

        ``levels=2`` scans the chunk summaries in chunks as well, for series of many billions of
        rows.  Rows need not be dense on the grid.
        """
        order_ts = F.col(self.ts).desc() if reverse else F.col(self.ts).asc()
        vals = {f"_v_{n}": s.packed() for n, s in specs.items()}
        # rows and chunk summaries hang off the same shuffle.  The summary takes along one value of
        # every column, so both branches prune to the same columns and Spark reuses the exchange
        # instead of computing everything upstream once more.
        base = df.withColumns({CHUNK: self.chunk(), **vals}).repartition(*self.keys, CHUNK)
        by = [F.col(k) for k in self.keys]
        rest = [x for x in df.columns if x not in self.keys]
        part = base.groupBy(*by, CHUNK).agg(
            *[F.first(x).alias(x) for x in rest],
            *[s.total(F.col(f"_v_{n}"), F.col(self.ts), reverse).alias(f"_v_{n}") for n, s in specs.items()],
        )
        seeds = self._carry(part, specs, reverse, levels).repartition(*self.keys, CHUNK)
        rows = base.withColumn(_SEED, F.lit(1)).unionByName(seeds.withColumn(_SEED, F.lit(0)))
        w = Window.partitionBy(*self.keys, CHUNK).orderBy(F.col(_SEED), order_ts)
        out = rows.withColumns({n: s.over(F.col(f"_v_{n}"), w) for n, s in specs.items()})
        return out.filter(F.col(_SEED) == 1).drop(CHUNK, _SEED, *vals)

    def _carry(self, part: DataFrame, specs, reverse: bool, levels: int) -> DataFrame:
        """Exclusive running value per chunk, from the chunk totals."""
        order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
        if levels <= 1:
            w = Window.partitionBy(*self.keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            return part.withColumns({f"_v_{n}": s.merge(F.col(f"_v_{n}"), w) for n, s in specs.items()})
        sup = "_super"
        base = part.withColumn(sup, F.floor(F.col(CHUNK) / self.chunk_rows).cast("long"))
        rest = [x for x in part.columns if x not in {*self.keys, CHUNK} and x[3:] not in specs]
        top = base.groupBy(*self.keys, sup).agg(
            *[F.first(x).alias(x) for x in rest],
            *[s.total(F.col(f"_v_{n}"), F.col(CHUNK), reverse, packed=True).alias(f"_v_{n}") for n, s in specs.items()]
        )
        sorder = F.col(sup).desc() if reverse else F.col(sup).asc()
        w = Window.partitionBy(*self.keys).orderBy(sorder).rowsBetween(Window.unboundedPreceding, -1)
        top = top.withColumns({f"_v_{n}": s.merge(F.col(f"_v_{n}"), w) for n, s in specs.items()})
        top = top.withColumn(CHUNK, F.lit(None).cast("long")).withColumn(_SEED, F.lit(0))
        rows = base.withColumn(_SEED, F.lit(1)).unionByName(top)
        w = (
            Window.partitionBy(*self.keys, sup)
            .orderBy(F.col(_SEED), order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        rows = rows.withColumns({f"_v_{n}": s.merge(F.col(f"_v_{n}"), w) for n, s in specs.items()})
        return rows.filter(F.col(_SEED) == 1).drop(sup, _SEED)

    # -- calendar ----------------------------------------------------------------------------

    def fill_grid(
        self,
        df: DataFrame,
        carry: Sequence[str] = (),
        zero: Sequence[str] = (),
        until: Column | None = None,
    ) -> DataFrame:
        """One row per grid step from the first to the last row of each series.

        ``carry`` columns take the last known value, ``zero`` columns take 0, the rest stay null.
        ``series_start`` gives the first step.  The missing steps are made inside each chunk, so
        the calendar of a long series is built in parallel, and the values carried over a chunk
        border come from the chunk summaries.
        """
        cols = [c for c in df.columns if c not in self.keys and c != self.ts]
        by = [F.col(k) for k in self.keys]
        # data rows and chunk summaries share one shuffle (see ``running``): every column is used by
        # both branches, so they prune alike and the exchange below is reused
        base = df.withColumns({"_pos": self.pos(), CHUNK: self.chunk()}).repartition(*self.keys, CHUNK)
        last = [F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col("_pos"))).alias(x) for x in cols]
        part = base.groupBy(*by, CHUNK).agg(F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"), *last)
        ws = Window.partitionBy(*self.keys)
        wn = ws.orderBy(CHUNK)
        prev = wn.rowsBetween(Window.unboundedPreceding, -1)
        hi = F.max("_hi").over(ws)
        if until is not None:
            hi = F.greatest(hi, self.pos(until))
        part = part.withColumns(
            {
                "_end": hi,
                "_start": F.min("_lo").over(ws),
                "_next": F.coalesce(F.lead(CHUNK).over(wn), self.chunk(hi) + 1),
                **{f"_c_{x}": F.last(x, ignorenulls=True).over(prev) for x in cols},
            }
        )
        # a chunk summary also answers for the empty chunks up to the next one
        part = part.withColumn("_fill", F.explode(F.sequence(F.col(CHUNK), F.col("_next") - 1)))
        own = F.col("_fill") == F.col(CHUNK)
        carried = [
            F.when(own, F.col(f"_c_{x}")).otherwise(F.coalesce(F.col(x), F.col(f"_c_{x}"))).alias(f"_c_{x}")
            for x in cols
        ]
        spine = part.select(
            *by,
            F.col("_fill").alias(CHUNK),
            F.greatest(F.col("_fill") * self.chunk_rows, F.col("_start")).alias("_lo"),
            F.least((F.col("_fill") + 1) * self.chunk_rows - 1, F.col("_end")).alias("_hi"),
            F.col("_start"),
            *carried,
        ).repartition(*self.keys, CHUNK)
        rows = base.select(*by, CHUNK, F.col("_pos").alias("_lo"), F.col("_pos").alias("_hi"), *cols)
        # the calendar pieces are unrolled after the shuffle, inside their chunk
        rows = rows.unionByName(spine, allowMissingColumns=True)
        rest = cols + ["_start"] + [f"_c_{x}" for x in cols]
        rows = rows.select(*by, CHUNK, F.explode(F.sequence("_lo", "_hi")).alias("_pos"), *rest)
        rows = rows.groupBy(*by, CHUNK, "_pos").agg(*[F.first(x, ignorenulls=True).alias(x) for x in rest])
        wf = Window.partitionBy(*self.keys, CHUNK).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        before = F.col("_pos") < F.col("_start")  # never true; keeps the carried column in use
        filled = []
        for x in cols:
            if x in carry:
                filled.append(F.coalesce(F.last(x, ignorenulls=True).over(wf), F.col(f"_c_{x}")).alias(x))
            else:
                v = F.coalesce(F.col(x), F.lit(0)) if x in zero else F.col(x)
                filled.append(F.when(before, F.col(f"_c_{x}")).otherwise(v).alias(x))
        return rows.select(
            *by, self.at(F.col("_pos")).alias(self.ts), *filled, self.at(F.col("_start")).alias("series_start")
        )


ROW_DAY = "_row_day"


def numbered(df: DataFrame, panel: Panel) -> tuple[DataFrame, Panel]:
    """Row windows over rows that are not on the grid (decisions, closed periods).

    Rows are numbered by a running count and the number becomes the grid position, so ``halo``
    works on them.  The helper column is ``ROW_DAY``.
    """
    df = panel.running(df, {ROW_DAY: Running(F.lit(1), "count")})
    df = df.withColumn(ROW_DAY, F.date_from_unix_date(F.col(ROW_DAY).cast("int")))
    return df, Panel(panel.keys, ROW_DAY, "day", panel.chunk_rows)


@dataclass(frozen=True)
class Running:
    """One cumulative column: ``kind`` of (value) over everything up to the row.

    kinds: first, last, sum, max, min, product, count, prev.  ``prev`` is the value of the row before
    (nulls kept), the rest include the current row unless ``exclusive``.
    """

    value: Column
    kind: str
    exclusive: bool = False

    def packed(self) -> Column:
        if self.kind == "prev":
            return F.struct(self.value.alias("x"))
        if self.kind == "count":
            return F.when(self.value.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
        if self.kind == "product":
            return self.value.cast("double")
        return self.value

    def total(self, v: Column, ts: Column, reverse: bool, packed: bool = False) -> Column:
        if self.kind in ("last", "prev"):
            pick = F.min_by if reverse else F.max_by
            return pick(v, F.when(v.isNotNull(), ts))
        if self.kind == "first":
            pick = F.max_by if reverse else F.min_by
            return pick(v, F.when(v.isNotNull(), ts))
        return self._agg(v)

    def _agg(self, v: Column) -> Column:
        return {
            "sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "product": F.product,
        }[self.kind](v)

    def merge(self, v: Column, w: WindowSpec) -> Column:
        if self.kind in ("last", "prev"):
            return F.last(v, ignorenulls=True).over(w)
        if self.kind == "first":
            return F.first(v, ignorenulls=True).over(w)
        return self._agg(v).over(w)

    def over(self, v: Column, w: WindowSpec) -> Column:
        stop = -1 if self.exclusive or self.kind == "prev" else 0
        wf = w.rowsBetween(Window.unboundedPreceding, stop)
        out = self.merge(v, wf)
        if self.kind == "prev":
            return out.getField("x")
        if self.kind == "count":
            return F.coalesce(out, F.lit(0).cast("long"))
        return out


DAILY = Panel()
HOURLY = Panel(step="hour")
