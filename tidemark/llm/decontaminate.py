"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage of a document by k = floor(rate * n) edits.  Cut
into k + 1 pieces, at least one piece is then in the passage unchanged.  All pieces of a block of
items are searched in one pass over each whole text (Aho-Corasick); around every hit, Myers'
bit-parallel algorithm finds the smallest edit distance of the item to any passage.

Both sides are compared in a plain form: lower case, ASCII marks and control characters as blanks,
runs of blanks as one, so letter case and decoration cost no edits.

The benchmark goes to the tasks in blocks of at most ``block_chars`` characters, each with its own pass
over the documents, so what a task holds does not grow with the benchmark.

Rows: a null or empty text holds nothing; items without letters, digits or non-ASCII characters match
nothing; a null ``item_id`` or ``doc_id`` stays null in the result; a repeated item or document gives
repeated rows.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
RATE, BLOCK_CHARS = 0.06, 2_000_000

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def plain(text: str | None) -> str:
    """The compared form; one character stands for one byte of UTF-8."""
    if not text:
        return ""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()).decode("latin-1")


def budget(item: str, rate: float) -> int:
    return int(rate * len(item) + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, x in enumerate(item):
        out[x] = out.get(x, 0) | 1 << i
    return out


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """Smallest edit distance of a pattern to any passage of ``text`` and where the first best passage
    ends; (k + 1, -1) if it is above k.  (Myers 1999, one machine word of m bits.)"""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, k + 1, -1
    for j, x in enumerate(text):
        eq = masks.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """The pieces of one block of items as an automaton, and the masks of the items."""

    def __init__(self, items: list[str], rate: float):
        self.items = [(x, budget(x, rate), peq(x)) for x in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (x, k, _) in enumerate(self.items):
            if x:
                for at, piece in pieces(x, k):
                    places.setdefault(piece, []).append((i, at))
        self.tree = ahocorasick.Automaton()
        for piece, where in places.items():
            self.tree.add_word(piece, (len(piece), where))
        if places:
            self.tree.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of each item that is in the text, its best passage."""
        if self.empty or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.tree.iter(text):
            for i, at in where:
                x, k, _ = self.items[i]
                start = end + 1 - n - at
                a, b = max(0, start - k), min(len(text), start + len(x) + k)
                own = spans.setdefault(i, [])
                if own and a <= own[-1][1] and b >= own[-1][0]:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        out = []
        for i, own in spans.items():
            x, k, masks = self.items[i]
            best = (k + 1, -1)
            for a, b in own:
                d, e = myers(masks, len(x), text[a:b], k)
                if d < best[0]:
                    best = (d, a + e)
            if best[0] <= k:
                out.append((i, *best))
        return out


def _search(items: list[str], ids: list, rate: float):
    def run(batches):
        matcher = Matcher(items, rate)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                for i, d, end in matcher.find(plain(text.as_py())):
                    rows.append((doc.as_py(), ids[i], d, len(matcher.items[i][0]), end))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["doc_id", "item_id", "distance", "item_chars", "end"])

    return run


def _blocks(benchmark: DataFrame, block_chars: int):
    """Items in blocks of bounded size, one block on the driver at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(c("item_id").cast("long").alias("i"), "text").toLocalIterator():
        x = plain(row.text)
        if texts and size + len(x) > block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(x)
        size += len(x)
    yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and test item found in it: ``doc_id``, ``item_id``, ``distance``, ``item_chars``, ``end``
    (where the best passage ends in the plain form)."""
    d = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance long, item_chars long, end long"
    found = [d.mapInArrow(_search(texts, ids, rate), schema) for ids, texts in _blocks(benchmark, block_chars)]
    return reduce(DataFrame.unionByName, found)
