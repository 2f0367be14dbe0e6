"""Row-window expressions with the min-count rule: null until enough non-null values are in frame."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


class Shared:
    """Window columns asked for while active, each kept once.

    Spark evaluates a window expression as often as it is written, and formulas write the same mean
    or count several times.  Inside ``with Shared() as s`` every request becomes a named column;
    ``s.columns`` holds them, to be added before the expressions that use them.
    """

    _active: "Shared | None" = None

    def __init__(self, prefix: str = "_w"):
        self.prefix, self.columns, self._names = prefix, {}, {}

    def __enter__(self):
        Shared._active = self
        return self

    def __exit__(self, *exc):
        Shared._active = None

    def get(self, agg: Column, w: WindowSpec, n: int) -> Column:
        key = (str(agg), id(w), n)
        if key not in self._names:
            self._names[key] = name = f"{self.prefix}{len(self._names)}"
            self.columns[name] = agg.over(frame(w, n))
        return F.col(self._names[key])


def over(agg: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over the last n rows, shared with equal requests where sharing is on."""
    return Shared._active.get(agg, w, n) if Shared._active else agg.over(frame(w, n))


def gated(agg: Column, x, w: WindowSpec, n: int, min_count: int | None = None) -> Column:
    return F.when(over(F.count(_c(x)), w, n) >= (n if min_count is None else min_count), over(agg, w, n))


def mean(x, w, n, m=None):
    return gated(F.avg(_c(x)), x, w, n, m)


def total(x, w, n, m=None):
    return gated(F.sum(_c(x)), x, w, n, m)


def std(x, w, n, m=None):
    """Sample deviation; one value gives null."""
    return gated(F.stddev_samp(_c(x)), x, w, n, m)


def std_pop(x, w, n, m=None):
    return gated(F.stddev_pop(_c(x)), x, w, n, m)


def low(x, w, n, m=None):
    return gated(F.min(_c(x)), x, w, n, m)


def high(x, w, n, m=None):
    return gated(F.max(_c(x)), x, w, n, m)


def quantile(x, q: float, w, n, m=None):
    """Exact, linearly interpolated."""
    return gated(F.percentile(_c(x), q), x, w, n, m)


def median(x, w, n, m=None):
    return quantile(x, 0.5, w, n, m)


def corr(x, y, w, n, m=None):
    """Pearson correlation over complete pairs; null when either side does not vary."""
    at = lambda e: over(e, w, n)
    return F.when(at(F.count(_pair(x, y, _c(x)))) >= (n if m is None else m), pearson(x, y, at))


def _pair(x, y, v):
    return F.when(_c(x).isNotNull() & _c(y).isNotNull(), v)


def pearson(x, y, at=lambda e: e) -> Column:
    """corr() fails on a constant input under ANSI arithmetic, so the ratio is written out."""
    cov = at(F.covar_pop(_c(x), _c(y)))
    return F.try_divide(cov, at(F.stddev_pop(_pair(x, y, _c(x)))) * at(F.stddev_pop(_pair(x, y, _c(y)))))


def quantiles(x, qs, w, n, m=None) -> Column:
    """Several quantiles of one frame as an array: the frame is sorted once."""
    return gated(F.percentile(_c(x), F.array(*[F.lit(q) for q in qs])), x, w, n, m)


def _let(x: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def percent_rank(x, w, n, m=None) -> Column:
    """Rank of the last known value among those of the frame, ties averaged, as a share.  The frame is an array that is
    passed once: work and memory of a row are those of its frame, whatever the series holds."""
    frame = values(x, w, n)
    below = lambda last: F.aggregate(frame, F.lit(0.0), lambda s, v: s + F.when(v < last, 1.0).when(v == last, 0.5).otherwise(0.0))
    share = (_let(F.element_at(frame, -1), below) + 0.5) / F.size(frame)
    return F.when(over(F.count(_c(x)), w, n) >= (n if m is None else m), share)


def tail_mean(x, q: float, w, n, m=None) -> Column:
    """Mean of the frame's values at or below its q quantile (linearly interpolated)."""

    def cut(frame: Column) -> Column:
        at = F.lit(float(q)) * (F.size(frame) - 1)
        low, high = F.get(frame, F.floor(at).cast("int")), F.get(frame, F.ceil(at).cast("int"))
        return low + (at - F.floor(at)) * (high - low)

    total = lambda tail: F.aggregate(tail, F.lit(0.0), lambda s, v: s + v) / F.size(tail)
    tail = lambda frame: _let(cut(frame), lambda top: _let(F.filter(frame, lambda v: v <= top), total))
    enough = over(F.count(_c(x)), w, n) >= (n if m is None else m)
    return F.when(enough, _let(F.sort_array(values(x, w, n)), tail))


def zscore(x, w, n, m=None):
    return F.try_divide(_c(x) - mean(x, w, n, m), std(x, w, n, m))


def values(x, w, n) -> Column:
    """The frame as an array (nulls dropped); for short frames only."""
    return over(F.collect_list(_c(x)), w, n)


def pct_change(x, w, k: int) -> Column:
    """Change over k rows; null when the base is missing or zero."""
    return F.try_divide(_c(x), F.lag(_c(x), k).over(w)) - 1


def log_change(x, w, k: int) -> Column:
    return F.ln(F.try_divide(_c(x), F.lag(_c(x), k).over(w)))
