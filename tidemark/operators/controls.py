"""Risk controls, drift measures and retrain triggers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.accounting import equity
from tidemark.operators.quantiles import exact_quantiles
from tidemark.panel import ROW_DAY, Panel, Running, numbered

c = F.col

# fixed values: control settings
KILL_DD, KILL_FLOOR = -0.12, 0.15
ACC_WINDOW, ACC_LOW, CONF_HIGH, ACC_MULT = 12, 0.48, 0.80, 0.5


def hit(pred: Column, ret: Column) -> Column:
    """Strict same sign; a zero forecast is a miss."""
    return ((pred > 0) & (ret > 0)) | ((pred < 0) & (ret < 0))


def current_drawdown(history: DataFrame, panel: Panel, ret: str = "strat_ret") -> DataFrame:
    """Drawdown of each series at its last closed period; the peak starts at the first closed value.
    0 with fewer than two closed periods."""
    closed = equity(history.filter(c(ret).isNotNull()), panel, ret, leading_one=False)
    last = closed.groupBy(*panel.keys).agg(F.count(F.lit(1)).alias("n_closed"), F.max_by("drawdown", panel.ts).alias("_dd"))
    every = history.select(*panel.keys).distinct().join(last, list(panel.keys), "left")
    dd = F.when(c("n_closed") >= 2, c("_dd")).otherwise(0.0)
    return every.select(*panel.keys, F.coalesce("n_closed", F.lit(0)).alias("n_closed"), dd.alias("current_dd"))


def rolling_quality(history: DataFrame, panel: Panel, window: int = ACC_WINDOW, lag: int = 0,
                    pred: str = "pred", ret: str = "asset_ret", conf: str = "conf") -> DataFrame:
    """Hit rate and mean confidence of the last ``window`` closed rows, ``lag`` rows back; null while
    there are fewer."""
    df, rows = numbered(history.filter(c(ret).isNotNull()), panel)
    f = rows.halo(df, window + lag)
    w = rows.window().rowsBetween(1 - window - lag, -lag)
    full = F.count(F.lit(1)).over(w) >= window
    f = f.withColumn("_hit", hit(c(pred), c(ret)).cast("double"))
    f = f.withColumns({"rolling_acc": F.when(full, F.avg("_hit").over(w)), "rolling_conf": F.when(full, F.avg(conf).over(w))})
    return rows.owned(f).drop("_hit", ROW_DAY)


def apply_controls(alloc: Column, dd: Column, acc: Column, conf: Column, derisk: bool = False) -> dict[str, Column]:
    """Kill switch, then the confidence-gated halving (off unless asked for); with status and text."""
    kill = F.coalesce(dd <= KILL_DD, F.lit(False))
    weak = F.coalesce((acc < ACC_LOW) & (conf > CONF_HIGH), F.lit(False))
    cut = weak & F.lit(derisk)
    after_kill = F.when(kill, F.least(alloc, F.lit(KILL_FLOOR))).otherwise(alloc)
    notes = F.array_compact(
        F.array(
            F.when(kill, F.format_string("KILL SWITCH: drawdown %.1f%%", dd * 100)),
            F.when(cut, F.format_string("ACCURACY: %.1f%% with confidence %.0f%%, halved", acc * 100, conf * 100)),
            F.when(weak & ~F.lit(derisk), F.format_string("ACCURACY: %.1f%%, rule is off", acc * 100)),
            F.when(F.coalesce((acc < ACC_LOW) & (conf <= CONF_HIGH), F.lit(False)), F.format_string("ACCURACY: %.1f%% but uncertain", acc * 100)),
        )
    )
    return {
        "controlled_alloc": F.when(cut, after_kill * ACC_MULT).otherwise(after_kill),
        "kill_active": kill,
        "derisked": cut,
        "warnings": notes,
    }


# -- drift -------------------------------------------------------------------------------------


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(features), "feature", "x").withColumn("x", c("x").cast("double"))


def psi(baseline: DataFrame, current: DataFrame, by: Sequence[str], bins: int = 10, min_base: int = 50, min_cur: int = 10) -> DataFrame:
    """Population stability index per group of long rows (``by``, x).

    Inner quantile edges of the baseline, equal edges merged, open ends, left-closed bins, empty
    bins counted as 1e-6; 0 when either side is too small.
    """
    by = list(by)
    edges = exact_quantiles(baseline, by, "x", [i / bins for i in range(1, bins)], "_edges")
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    both = baseline.select(*by, "x", F.lit(0).alias("_side")).unionByName(current.select(*by, "x", F.lit(1).alias("_side")))
    both = both.filter(c("x").isNotNull()).join(edges, by)
    bin_no = F.size(F.filter("_edges", lambda e: e <= c("x")))
    counts = both.groupBy(*by, F.size("_edges").alias("_n_edges"), bin_no.alias("_bin")).agg(
        F.count_if(c("_side") == 0).alias("_b"), F.count_if(c("_side") == 1).alias("_c")
    )
    totals = counts.groupBy(*by).agg(
        F.sum("_b").alias("_nb"), F.sum("_c").alias("_nc"), F.count(F.lit(1)).alias("_seen"), F.max("_n_edges").alias("_ne")
    )
    j = counts.join(totals, by)
    share = lambda n, d: F.when(n == 0, F.lit(1e-6)).otherwise(n / F.greatest(d, F.lit(1)))
    pb, pc = share(c("_b"), c("_nb")), share(c("_c"), c("_nc"))
    # bins empty on both sides contribute (1e-6 - 1e-6) * ln 1 = 0
    val = F.sum((pc - pb) * F.ln(pc / pb))
    enough = (F.max("_nb") >= min_base) & (F.max("_nc") >= min_cur)
    return j.groupBy(*by).agg(F.when(enough, val).otherwise(0.0).alias("psi"), F.max("_nb").alias("n_base"), F.max("_nc").alias("n_cur"))


def psi_panel(df: DataFrame, panel: Panel, features: Sequence[str], months: int = 12, offset: int = 2, current_rows: int = 60) -> DataFrame:
    """Per series and feature: the ``months`` ending ``offset`` months before the last row against the
    last ``current_rows`` rows."""
    keys = list(panel.keys)
    end = df.groupBy(*keys).agg(F.max(panel.ts).alias("_end"))
    j = df.join(end, keys)
    b_end = F.add_months("_end", -offset)
    base = j.filter((c(panel.ts) >= F.add_months(b_end, -months)) & (c(panel.ts) <= b_end))
    tail = panel.running(df, {"_r": Running(F.lit(1), "count")}, reverse=True).filter(c("_r") <= current_rows)
    long = lambda d: unpivot(d.select(*keys, *features), keys, features)
    return psi(long(base), long(tail), [*keys, "feature"])


def mean_shift(df: DataFrame, by: Sequence[str], features: Sequence[str], is_current: Column, top: int = 10) -> DataFrame:
    """z of the current mean against history per feature, largest first."""
    long = unpivot(df.select(*by, *features, is_current.alias("_cur")), [*by, "_cur"], features)
    h, k = F.when(~c("_cur"), c("x")), F.when(c("_cur"), c("x"))
    z = F.try_divide(F.avg(k) - F.avg(h), F.nullif(F.stddev_samp(h), F.lit(0.0)))
    out = long.groupBy(*by, "feature").agg(F.avg(h).alias("hist_mean"), F.avg(k).alias("cur_mean"), z.alias("z"))
    return out.orderBy(F.abs("z").desc(), "feature").limit(top) if top else out


# -- path-dependent controls -------------------------------------------------------------------


def path_controls(df: DataFrame, panel: Panel, raw: str = "alloc", factor: str = "conf", derisk: str = "derisk") -> DataFrame:
    """Controls whose input is the equity they have already changed.

    Decision i sees the periods closed by i - 2.  Halving on poor accuracy depends on what is known
    anyway, so windows give it.  Then every decision has just two possible returns, with the switch off
    and on, and only which one it takes depends on the path: a fold over these pairs, oldest first,
    that carries growth, peak and the two periods that are still open.  ``derisk`` is a column with
    none / plain48 / confgate.
    """
    # a period without a return is no hit and earns nothing
    filled = df.withColumns({"_conf": c("conf"), "_ret": c("asset_ret")}).withColumns({"conf": c(factor), "asset_ret": F.coalesce("asset_ret", F.lit(0.0))})
    q = rolling_quality(filled, panel, lag=2)
    gate = (c(derisk) == "plain48") | ((c(derisk) == "confgate") & (c("rolling_conf") > CONF_HIGH))
    cut = F.coalesce((c("rolling_acc") < ACC_LOW) & gate, F.lit(False))
    part = F.when(cut, F.lit(ACC_MULT)).otherwise(F.lit(1.0))
    q = q.withColumns({"derisk_fired": cut, "_off": c(raw) * part, "_on": F.least(c(raw), F.lit(KILL_FLOOR)) * part})
    q = q.withColumns({"conf": c("_conf"), "asset_ret": c("_ret")}).drop("_conf", "_ret", *[x for x in q.columns if x not in df.columns and x not in ("derisk_fired", "_off", "_on")])
    earned = lambda a: F.coalesce(c(a) * c("asset_ret") + (1 - c(a)) * c("cash_ret"), F.lit(0.0))
    q = q.withColumns({"_roff": earned("_off"), "_ron": earned("_on")})
    logs = q.groupBy(*panel.keys).agg(F.sort_array(F.collect_list(F.struct(c(panel.ts).alias("t"), c("_roff").alias("off"), c("_ron").alias("on")))).alias("_log"))
    start = F.struct(
        F.lit(1.0).alias("growth"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("open2"), F.lit(0.0).alias("open1"), F.lit(0).alias("n"), F.lit("").alias("fired"),
    )

    def step(s: Column, x: Column) -> Column:
        growth = s["growth"] * (1 + s["open2"])
        peak = F.when(s["n"] >= 2, F.greatest(s["peak"], growth)).otherwise(s["peak"])
        fires = (s["n"] >= 3) & (growth / peak - 1 <= KILL_DD)
        return F.struct(
            growth.alias("growth"), peak.alias("peak"), s["open1"].alias("open2"), F.when(fires, x["on"]).otherwise(x["off"]).alias("open1"),
            (s["n"] + 1).alias("n"), F.concat(s["fired"], F.when(fires, "1").otherwise("0")).alias("fired"),
        )

    logs = logs.withColumn("_fired", F.aggregate("_log", start, step)["fired"])
    fired = logs.select(*panel.keys, F.explode(F.transform("_log", lambda x, i: F.struct(x["t"].alias(panel.ts), (F.substring(c("_fired"), i + 1, F.lit(1)) == "1").alias("kill_fired")))).alias("_x"))
    q = q.join(fired.select(*panel.keys, "_x.*"), [*panel.keys, panel.ts])
    pick = lambda on, off: F.when(c("kill_fired"), c(on)).otherwise(c(off))
    q = q.withColumns({"controlled_alloc": pick("_on", "_off"), "controlled_ret": pick("_ron", "_roff")})
    return q.select(*df.columns, "controlled_alloc", "controlled_ret", "kill_fired", "derisk_fired")


def one_pass_controls(df: DataFrame, panel: Panel, kill: bool = True, derisk: bool = True) -> DataFrame:
    """The simpler variant: the drawdown is that of the uncontrolled equity one row earlier, so windows
    are enough."""
    g = equity(df, panel, "strat_ret", leading_one=False)
    g = panel.running(g, {"_dd": Running(c("drawdown"), "prev")})
    q = rolling_quality(g, panel, lag=1)
    a = c("alloc")
    if kill:
        a = F.when(c("_dd") <= KILL_DD, F.least(a, F.lit(KILL_FLOOR))).otherwise(a)
    if derisk:
        a = F.when(c("rolling_acc") < ACC_LOW, a * ACC_MULT).otherwise(a)
    return q.withColumn("controlled_alloc", a).drop("_dd")


def derisk_rule(rule: Column, alloc: Column, acc: Column, conf: Column, vol: Column, threshold: Column | float = ACC_LOW,
                ramp: tuple[float, float] = (0.40, 0.55), vol_limit: float = 0.8) -> Column:
    """Alternatives to the halving rule: plain threshold, linear ramp, confidence gate, volatility gate."""
    low = acc < threshold
    lo, hi = ramp
    slope = F.least(F.greatest((acc - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * 0.5 + 0.5
    mult = (
        F.when(rule == "threshold", F.when(low, ACC_MULT).otherwise(1.0))
        .when(rule == "ramp", slope)
        .when(rule == "conf_gate", F.when(low & (conf > CONF_HIGH), ACC_MULT).otherwise(1.0))
        .when(rule == "vol_gate", F.when(low & (vol > vol_limit), ACC_MULT).otherwise(1.0))
        .otherwise(1.0)
    )
    return alloc * F.coalesce(mult, F.lit(1.0))


# -- retrain triggers --------------------------------------------------------------------------

TRIGGERS = {
    "drawdown": lambda p: c("drawdown_since") <= -p,
    "accuracy": lambda p: c("rolling_acc") < p,
    "volatility": lambda p: (c("vol_ratio") > p) | (c("vol_ratio") < 1 / p),
    "big_move": lambda p: F.abs("asset_ret") > p,
}


def since_retrain(df: DataFrame, panel: Panel, cutoff: str, equity: str = "equity", vol: str = "vol30") -> DataFrame:
    """``drawdown_since``: equity against its peak since the retrain in ``cutoff``; ``vol_ratio``: volatility
    over the first one known after it.  The rows between two retrains are one bounded group."""
    w = Window.partitionBy(*panel.keys, cutoff).orderBy(panel.ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(
        {"drawdown_since": c(equity) / F.max(equity).over(w) - 1, "vol_ratio": F.try_divide(c(vol), F.first(vol, ignorenulls=True).over(w))}
    )


def trained_regime(daily: DataFrame, panel: Panel, regime: str, cutoff: Column, days: int = 30, out: str = "trained") -> DataFrame:
    """Keys, ``cutoff_ts``, ``out``: the most frequent regime of the ``days`` before each retrain (of equally
    frequent ones the first by name).  ``cutoff`` gives the first retrain after a day."""
    d = daily.withColumn("cutoff_ts", cutoff).where(F.datediff("cutoff_ts", c(panel.ts)) <= days)
    n = d.groupBy(*panel.keys, "cutoff_ts", c(regime).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*panel.keys, "cutoff_ts").agg(F.min(F.struct(-c("_n"), c("_r").alias("r"))).getField("r").alias(out))


def trigger(spec: Mapping[str, float]) -> Column:
    """Any of the named conditions."""
    out = F.lit(False)
    for name, p in spec.items():
        out = out | F.coalesce(TRIGGERS[name](p), F.lit(False))
    return out


def spaced_events(df: DataFrame, keys: Sequence[str], ts: str, fired: Column, min_days: int = 30) -> DataFrame:
    """Keep a firing only if ``min_days`` passed since the last kept one.

    A fold over the firing dates of one series, oldest first; dates only, so the arrays are short.
    """
    dates = df.filter(fired).groupBy(*keys).agg(F.array_sort(F.collect_set(ts)).alias("_d"))
    start = F.array().cast("array<date>")
    keep = F.aggregate(
        "_d", start,
        lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.try_element_at(acc, F.lit(-1))) >= min_days), F.concat(acc, F.array(d))).otherwise(acc),
    )
    return dates.select(*keys, F.explode(keep).alias(ts))


def regime_shift(df: DataFrame, panel: Panel, trained: str, current: str, n: int, out: str = "shift_fired") -> DataFrame:
    """n decisions in a row in a regime other than the one trained on."""
    from tidemark.operators.regimes import run_length

    df = df.withColumn("_other", c(current) != c(trained))
    df = run_length(df, panel, "_other", "_len")
    return df.withColumn(out, F.coalesce(c("_other") & (c("_len") >= n), F.lit(False))).drop("_other", "_len")


def health(df: DataFrame, panel: Panel, price: str = "price", pred: str = "pred", rows: int = 60, least: int = 10) -> DataFrame:
    """Direction accuracy over the last rows, judged by the next price change."""
    nxt = panel.running(df, {"_np": Running(c(price), "prev"), "_r": Running(F.lit(1), "count")}, reverse=True)
    tail = nxt.filter((c("_r") <= rows) & c("_np").isNotNull())
    ok = F.count(F.lit(1)) >= least
    return tail.groupBy(*panel.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(ok, F.avg(hit(c(pred), c("_np") - c(price)).cast("double"))).alias("accuracy"),
    )


def outlying_now(df: DataFrame, panel: Panel, features: Sequence[str], gap: int = 30, limit: float = 4.0) -> DataFrame:
    """Features whose last value lies far from their history without the last ``gap`` rows."""
    keys = list(panel.keys)
    t = panel.running(df, {"_r": Running(F.lit(1), "count")}, reverse=True)
    long = unpivot(t.select(*keys, "_r", *features), [*keys, "_r"], features)
    h = F.when(c("_r") > gap, c("x"))
    z = F.try_divide(F.max(F.when(c("_r") == 1, c("x"))) - F.avg(h), F.nullif(F.stddev_samp(h), F.lit(0.0)))
    out = long.groupBy(*keys, "feature").agg(z.alias("z"))
    return out.withColumn("alert", F.coalesce(F.abs("z") > limit, F.lit(False)))
