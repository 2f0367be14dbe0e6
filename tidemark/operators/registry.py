"""Declared features, resolved into one pass over the panel.

A feature names its inputs and how far it looks back.  ``build`` takes the closure of the requested
names, adds up look-backs along each dependency path, makes one halo copy of the panel (one
shuffle) and stacks the expressions stage by stage on the same partitioning and order, so Spark
sorts once.  Features whose inputs are absent are skipped and reported.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.rolling import Shared
from tidemark.operators.recursive import affine
from tidemark.panel import Panel


@dataclass(frozen=True)
class Feature:
    name: str
    inputs: tuple[str, ...]
    back: int
    make: Callable[["Scope"], Column]
    ahead: int = 0
    doc: str = ""


@dataclass
class Scope:
    """What an expression can see: the row window inside a chunk and the panel layout."""

    panel: Panel

    @cached_property
    def w(self) -> WindowSpec:
        return self.panel.window()



def _not_a_window(s: Scope) -> Column:
    raise ValueError("a recursive column is made by build, not by a window")


@dataclass
class Registry:
    items: dict[str, Feature] = field(default_factory=dict)
    recursive: dict[str, tuple[str, float]] = field(default_factory=dict)

    def add(self, name: str, inputs: str | Sequence[str], make, back: int = 0, ahead: int = 0, doc: str = "") -> None:
        ins = tuple(inputs.split()) if isinstance(inputs, str) else tuple(inputs)
        self.items[name] = Feature(name, ins, back, make, ahead, doc)

    def ewm(self, name: str, x: str, alpha: float, doc: str = "") -> None:
        """y[0] = x[0], y[t] = (1-alpha) y[t-1] + alpha x[t] where no value is missing; see ``recursive`` for gaps.

        ``build`` computes such columns exactly over the whole series (``affine``) before the features
        that read them.  ``back`` is only what an incremental build has to read again: the rows after
        which an old value no longer changes the last digits of a value of the same size.
        """
        self.recursive[name] = (x, alpha)
        self.add(name, [x], _not_a_window, back=math.ceil(math.log(1e17) / -math.log(1.0 - alpha)), doc=doc)

    def _recursive_in(self, have: Iterable[str], names: Sequence[str]) -> list[str]:
        """Recursive columns that the names need and that are not there yet, inputs before users."""
        have, found, seen = set(have), [], set()

        def visit(n: str) -> None:
            if n in have or n in seen or n not in self.items:
                return
            seen.add(n)
            for i in self.items[n].inputs:
                visit(i)
            if n in self.recursive:
                found.append(n)

        for n in names:
            visit(n)
        return found

    # -- resolution ----------------------------------------------------------------------------

    def plan(self, have: Iterable[str], names: Sequence[str]):
        """(stages, back, ahead, skipped) for the requested names."""
        have = set(have)
        depth: dict[str, int] = {}
        span: dict[str, tuple[int, int]] = {}
        missing: dict[str, set[str]] = {}

        def visit(n: str) -> None:
            if n in depth or n in missing:
                return
            f = self.items.get(n)
            if f is None:
                missing[n] = {n}
                return
            # a column the caller already has is an input, not something to recompute
            gaps: set[str] = set()
            level, back, ahead = 0, 0, 0
            for i in f.inputs:
                if i in have:
                    continue
                visit(i)
                if i in missing:
                    gaps |= missing[i]
                    continue
                level = max(level, depth[i] + 1)
                back, ahead = max(back, span[i][0]), max(ahead, span[i][1])
            if gaps:
                missing[n] = gaps
                return
            depth[n] = level
            span[n] = (back + f.back, ahead + f.ahead)

        for n in names:
            if n not in have:
                visit(n)
        stages: list[list[str]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
        for n, lv in depth.items():
            stages[lv].append(n)
        back = max((s[0] for s in span.values()), default=0)
        ahead = max((s[1] for s in span.values()), default=0)
        skipped = {n: sorted(missing[n]) for n in names if n in missing}
        return stages, back, ahead, skipped

    def stack(self, frame: DataFrame, panel: Panel, stages: Sequence[Sequence[str]]) -> DataFrame:
        scope = Scope(panel)
        for i, stage in enumerate(stages):
            with Shared(f"_w{i}_") as shared:
                made = {n: self.items[n].make(scope) for n in stage}
            if shared.columns:
                frame = frame.withColumns(shared.columns)
            frame = frame.withColumns(made).drop(*shared.columns)
        return frame

    def build(
        self, df: DataFrame, panel: Panel, names: Sequence[str], keep: Sequence[str] = ()
    ) -> tuple[DataFrame, dict[str, list[str]]]:
        """Keys, ts, ``keep`` and the requested features; plus {skipped feature: absent inputs}."""
        pending = [n for n in self._recursive_in(df.columns, names) if not self.plan(df.columns, [n])[3]]
        if pending:
            ready = [n for n in pending if self._recursive_in(df.columns, [self.recursive[n][0]]) == []]
            inputs = sorted({self.recursive[n][0] for n in ready} - set(df.columns))
            given = [x for x in df.columns if x not in (*panel.keys, panel.ts)]
            base, _ = self.build(df, panel, inputs, keep=given)
            base = affine(base, panel, {n: self.recursive[n] for n in ready}).drop(*inputs)
            return self.build(base, panel, names, keep)
        stages, back, ahead, skipped = self.plan(df.columns, names)
        done = [n for n in names if n not in skipped]
        need = {i for st in stages for n in st for i in self.items[n].inputs} | set(done)
        cols = [c for c in df.columns if c in need | set(panel.keys) | {panel.ts, "series_start"} | set(keep)]
        frame = panel.halo(df.select(*cols), back, ahead)
        frame = panel.owned(self.stack(frame, panel, stages))
        return frame.select(*panel.keys, panel.ts, *keep, *done), skipped


FEATURES = Registry()
