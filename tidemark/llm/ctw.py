"""Code lengths of texts by context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 decision nodes has its own context tree over the
preceding bytes (nearest first, up to ``depth``).  A tree node with counts (a, b) codes its bits with
the Krichevsky-Trofimov estimate Pe(a, b); the weighted probability mixes all depths,

    Pw = Pe at full depth, else Pw = Pe / 2 + (product of the children's Pw) / 2,

(Willems, Shtarkov and Tjalkens 1995).  The trees are learned from the training documents' counts; a
text is then scored with the trees as they are: along its context path the prediction is
w KT + (1 - w) (prediction of the child), w = Pe / (2 Pw), KT = (b + 1/2) / (a + b + 1).

Before a text stand, and after it stands, bytes 0xFF, which UTF-8 does not use: the end is one more
symbol, so probabilities of texts of all lengths add up to one.

Spark's part: texts become blocks of some megabytes, a block its distinct (context, byte) grams with
training counts.  Grams meet by hash, so a common gram is one entry per block and no more; distinct
grams are then grouped by their two nearest bytes, which bounds a group by 256^(depth - 1) whatever
the corpus, and each group computes its subtrees.  The two top levels are at most 65,535 nodes, summed
in Spark and handed to the tasks.  Grams of documents that are not trained on take part with count 0,
so every gram of every text gets its exact value, which goes back to the blocks that have it.

The word baseline (add-one over words and one end per document) travels the same way.

Rows: a null or empty text is an end alone; a null ``doc_id`` counts as training (checksum of nothing);
without training documents all counts are 0; repeated rows are counted and scored each.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import packed, packed_ascending, unpacked, unpacked_ascending
from tidemark.llm.words import _LOWER, mix, slices, text_bytes
from tidemark.stage import stage

c = F.col
DEPTH = 5
BLOCK_BYTES, BUCKET_BYTES, SLICE_BYTES = 16 << 20, 64 << 20, 2 << 20
END = 255
LN2, LN10 = np.log(2.0), np.log(10.0)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


# -- grams --------------------------------------------------------------------------------------


def grams(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every position, (c1, .., c_depth, byte) from the nearest context byte on, and where each
    text begins; a text of n bytes has n + 1 positions."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(raw) + (depth + 1) * n, END, np.uint8)
    lead = depth + (depth + 1) * np.arange(n)
    padded[np.arange(len(raw)) + np.repeat(lead, lengths)] = _LOWER[raw]
    key = np.zeros(len(padded) - depth, np.int64)
    for d in range(1, depth + 1):
        key |= padded[depth - d : len(padded) - d].astype(np.int64) << (8 * (depth + 1 - d))
    key |= padded[depth:]
    # what is left of the padding between two texts is no position
    keep = np.ones(len(key), bool)
    starts = offsets[:-1] + (depth + 1) * np.arange(n)
    for d in range(depth):
        keep[starts[1:] - 1 - d] = False
    return key[keep], offsets + np.arange(n + 1)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    u, at = np.unique(k, return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts) if counts else None, len(u)).astype(np.int64)


# -- trees --------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = x * (x + 1) * (x + 2) * (x + 3)
    shift = np.log(shift) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _weigh(zeros, ones, children):
    """log Pw of inner nodes, the weight of stopping there and the probability of a one."""
    pe = log_kt(zeros, ones)
    pw = np.logaddexp(pe, children) - LN2
    return pw, np.exp(pe - LN2 - pw), (ones + 0.5) / (zeros + ones + 1.0)


def _parents(nodes: np.ndarray, zeros, ones, pw):
    """Nodes are context << 8 | decision; the parent's context lacks the farthest byte."""
    up, at = np.unique((nodes >> 16 << 8) | (nodes & 255), return_inverse=True)
    return up, at, np.bincount(at, zeros, len(up)), np.bincount(at, ones, len(up)), np.bincount(at, pw, len(up))


def _leaves(keys: np.ndarray, counts: np.ndarray):
    """Full-depth nodes of sorted grams; ``at[k]`` is the node of each gram's k-th decision."""
    b, context = keys & 255, keys >> 8
    bits = [(b >> (7 - k)) & 1 for k in range(8)]
    nodes, at = np.unique(np.concatenate([context << 8 | (1 << k) | (b >> (8 - k)) for k in range(8)]), return_inverse=True)
    n = np.tile(counts, 8)
    bit = np.concatenate(bits)
    return nodes, at.reshape(8, -1), bits, np.bincount(at, n * (1 - bit), len(nodes)), np.bincount(at, n * bit, len(nodes))


def _subtrees(keys, counts, depth):
    """Levels ``depth`` .. 2 of the trees under one group of grams: (nodes, zeros, ones, log Pw, link to parent)."""
    nodes, at, bits, zeros, ones = _leaves(keys, counts)
    levels = [[nodes, zeros, ones, log_kt(zeros, ones), None]]
    for _ in range(depth - 2):
        nodes, zeros, ones, pw, _n = levels[-1]
        up, link, z, o, children = _parents(nodes, zeros, ones, pw)
        levels[-1][4] = link
        levels.append([up, z, o, _weigh(z, o, children)[0], None])
    return levels, at, bits


def _tops(nodes, zeros, ones, children):
    """(nodes of depth 1, A, B): after the two top levels a prediction is A + B * (prediction below)."""
    pw, w1, kt1 = _weigh(zeros, ones, children)
    _up, link, z, o, below = _parents(nodes, zeros, ones, pw)
    _pw, w0, kt0 = _weigh(z, o, below)
    a, b = (w0 * kt0)[link], (1 - w0)[link]
    return nodes, a + b * w1 * kt1, b * (1 - w1)


def _log10_of(keys, counts, depth, top):
    """log10 of the probability of each gram's byte after its context."""
    levels, at, bits = _subtrees(keys, counts, depth)
    nodes, a, b = top
    if depth == 2:
        place = np.searchsorted(nodes, (levels[0][0] >> 16 << 8) | (levels[0][0] & 255))
        a, b = a[place], b[place]
    else:
        first = levels[-1][0]
        place = np.searchsorted(nodes, (first >> 16 << 8) | (first & 255))
        a, b = a[place], b[place]
        for up, own in zip(levels[:0:-1], levels[-2::-1]):
            # ``up``: the node whose estimate is mixed in here; ``own``: the level below it
            _nodes, zeros, ones, pw, _link = up
            w = np.exp(log_kt(zeros, ones) - LN2 - pw)
            a, b = a + b * w * (ones + 0.5) / (zeros + ones + 1.0), b * (1 - w)
            a, b = a[own[4]], b[own[4]]
    _nodes, zeros, ones, _pw, _link = levels[0]
    one = a + b * (ones + 0.5) / (zeros + ones + 1.0)
    total = np.zeros(len(keys))
    for k in range(8):
        p = one[at[k]]
        total += np.log(np.where(bits[k] == 1, p, 1 - p))
    return total / LN10


# -- Spark's part -------------------------------------------------------------------------------

_MADE = "kind string, block string, bucket int, doc_id long, held_out boolean, text string, keys binary, counts binary"
_PA = pa.schema([("kind", pa.string()), ("block", pa.string()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])


def _deal(where: np.ndarray, buckets: int):
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


class _Block:
    def __init__(self):
        self.name, self.size, self.words, self.keys, self.counts = uuid.uuid4().hex[:16], 0, Counter(), [], []

    def add(self, keys, counts):
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys)) > 2_000_000:
            u, n = _merge(self.keys, self.counts)
            self.keys, self.counts = [u], [n]

    def rows(self, buckets: int):
        u, n = _merge(self.keys, self.counts)
        for b, own in _deal(_hash(u, buckets), buckets):
            yield {"kind": "grams", "block": self.name, "bucket": b, "keys": packed_ascending(u[own]), "counts": packed(n[own])}
        words = list(self.words)
        n = np.fromiter(self.words.values(), np.int64, len(words))
        where = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        for b, own in _deal(where, buckets):
            yield {"kind": "words", "block": self.name, "bucket": b, "keys": zlib.compress(b" ".join([words[i] for i in own]), 1), "counts": packed(n[own])}


def _blocks(depth: int, buckets: int):
    def run(batches):
        block = _Block()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            out = np.array([held_out(i) for i in ids], bool)
            for a, b in slices(offsets, SLICE_BYTES):
                part = raw[offsets[a] : offsets[b]]
                keys, first = grams(part, offsets[a : b + 1] - offsets[a], depth)
                trained = np.repeat(~out[a:b], np.diff(first))
                for some, weight in ((keys[trained], 1), (keys[~trained], 0)):
                    u, n = np.unique(some, return_counts=True)
                    block.add(u, n * weight)
                data, at = _LOWER[part].tobytes(), offsets[a : b + 1] - offsets[a]
                for i in range(a, b):
                    w = data[at[i - a] : at[i - a + 1]].split()
                    block.words.update(dict.fromkeys(w, 0) if out[i] else w)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["text"] * n), pa.array([block.name] * n), pa.nulls(n, pa.int32()), batch.column(0).slice(a, n).cast(pa.int64()), pa.array(out[a:b]),
                        batch.column(1).slice(a, n).cast(pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                    ],
                    schema=_PA,
                )
                block.size += len(part)
                if block.size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(list(block.rows(buckets)), _PA)
                    block = _Block()
        yield pa.RecordBatch.from_pylist(list(block.rows(buckets)), _PA)

    return run


def _keys(column) -> list[np.ndarray]:
    return [unpacked_ascending(x) for x in column.to_pylist()]


def _counts(column) -> list[np.ndarray]:
    return [unpacked(x) for x in column.to_pylist()]


def _words(packed_words: bytes) -> list[bytes]:
    return zlib.decompress(packed_words).split(b" ")


def _distinct(buckets: int):
    """Grams of one hash bucket over all blocks, dealt out anew by their two nearest context bytes."""

    def run(depth):
        def go(group: pa.Table) -> pa.Table:
            u, n = _merge(_keys(group.column("keys")), _counts(group.column("counts")))
            rows = [(b, packed_ascending(u[own]), packed(n[own])) for b, own in _deal(_hash(u >> (8 * (depth - 1)), buckets), buckets)]
            cols = list(zip(*rows)) or [[]] * 3
            return pa.table({"bucket": pa.array(cols[0], pa.int32()), "keys": pa.array(cols[1], pa.binary()), "counts": pa.array(cols[2], pa.binary())})

        return go

    return run


def _roots(depth: int):
    def go(group: pa.Table) -> pa.Table:
        keys, counts = _merge(_keys(group.column("keys")), _counts(group.column("counts")))
        nodes, zeros, ones, pw, _link = _subtrees(keys, counts, depth)[0][-1]
        up, _at, z, o, below = _parents(nodes, zeros, ones, pw)
        return pa.table({"node": up, "zeros": z, "ones": o, "children": below})

    return go


def _scored(depth: int, top, buckets: int):
    def go(group: pa.Table) -> pa.Table:
        keys, counts = _merge(_keys(group.column("keys")), _counts(group.column("counts")))
        p = _log10_of(keys, counts, depth, top)
        rows = [(b, packed_ascending(keys[own]), p[own].tobytes()) for b, own in _deal(_hash(keys, buckets), buckets)]
        cols = list(zip(*rows)) or [[]] * 3
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "keys": pa.array(cols[1], pa.binary()), "values": pa.array(cols[2], pa.binary())})

    return go


def _returned(asked: pa.Table, known: pa.Table) -> pa.Table:
    """One hash bucket: the values of the grams of each block."""
    keys = _keys(known.column("keys"))
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    values = [np.frombuffer(x, np.float64) for x in known.column("values").to_pylist()]
    values = np.concatenate(values) if values else np.zeros(0)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    out = [values[np.searchsorted(keys, own)].tobytes() for own in _keys(asked.column("keys"))]
    n = asked.num_rows
    return pa.table({"kind": pa.array(["grams"] * n), "block": asked.column("block"), "keys": asked.column("keys"), "values": pa.array(out, pa.binary()), "n": pa.nulls(n, pa.int64()), "types": pa.nulls(n, pa.int64())})


def _word_totals(group: pa.Table) -> pa.Table:
    """One bucket of words: corpus counts for each block, and one row with the bucket's totals."""
    total: dict[bytes, int] = {}
    lists = [_words(k) for k in group.column("keys").to_pylist()]
    for words, n in zip(lists, _counts(group.column("counts"))):
        for w, x in zip(words, n.tolist()):
            total[w] = total.get(w, 0) + x
    out = [packed(np.fromiter([total[w] for w in words], np.int64, len(words))) for words in lists]
    n = len(lists)
    return pa.table(
        {
            "kind": pa.array(["words"] * n + ["total"]), "block": pa.array([*group.column("block").to_pylist(), None], pa.string()),
            "keys": pa.array([*group.column("keys").to_pylist(), None], pa.binary()), "values": pa.array([*out, None], pa.binary()),
            "n": pa.array([None] * n + [sum(total.values())], pa.int64()), "types": pa.array([None] * n + [sum(x > 0 for x in total.values())], pa.int64()),
        }
    )


_FACTS = "kind string, block string, keys binary, values binary, n long, types long"


class _Lookup:
    """Places of keys in a sorted array: two hash tables, and bisection for the few that meet in both."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.tables, rest = [], np.arange(len(keys), dtype=np.int32)
        for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            table = np.zeros(1 << self.bits, np.int32)
            slot = self._slot(keys[rest], f)
            table[slot] = rest
            self.tables.append((f, table))
            rest = rest[table[slot] != rest]

    def _slot(self, keys, f):
        return (keys.astype(np.uint64) * np.uint64(f)) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        (f, one), (g, two) = self.tables
        at = one[self._slot(keys, f)]
        bad = np.flatnonzero(self.keys[at] != keys)
        if len(bad):
            at[bad] = two[self._slot(keys[bad], g)]
            bad = bad[self.keys[at[bad]] != keys[bad]]
            at[bad] = np.searchsorted(self.keys, keys[bad])
        return at


def _scores(depth: int, n_train: int, n_types: int, ends: int):
    def go(docs: pa.Table, facts: pa.Table) -> pa.Table:
        kind = facts.column("kind").to_pylist()
        blobs = list(zip(kind, facts.column("keys").to_pylist(), facts.column("values").to_pylist()))
        keys = np.concatenate([np.zeros(0, np.int64), *[unpacked_ascending(k) for x, k, _ in blobs if x == "grams"]])
        values = np.concatenate([np.zeros(0), *[np.frombuffer(v, np.float64) for x, _, v in blobs if x == "grams"]])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        count: dict[bytes, int] = {}
        for x, k, v in blobs:
            if x == "words":
                count.update(zip(_words(k), unpacked(v).tolist()))
        find = _Lookup(keys)
        whole = np.log10(n_train + n_types + 1)
        rows = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for chunk in docs.column("text").chunks:
            raw, offsets = text_bytes(chunk)
            for a, b in slices(offsets, SLICE_BYTES):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                own, first = grams(part, at, depth)
                rows["score"].append(np.add.reduceat(values[find(own)], first[:-1]))
                data = _LOWER[part].tobytes()
                for i in range(b - a):
                    words = data[at[i] : at[i + 1]].split()
                    n = np.fromiter(map(count.__getitem__, words), np.int64, len(words))
                    rows["n_tokens"].append(len(words) + 1)
                    rows["n_known"].append(int((n > 0).sum()) + (ends > 0))
                    rows["base_score"].append(float(np.log10(n + 1.0).sum() + np.log10(ends + 1.0) - (len(words) + 1) * whole))
        score = np.concatenate([np.zeros(0), *rows["score"]])
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "n_known": pa.array(rows["n_known"], pa.int64()),
                "base_score": pa.array(rows["base_score"], pa.float64()), "score": pa.array(score, pa.float64()), "n_bytes": pa.array(docs.column("text").to_pandas().fillna("").str.encode("utf-8").str.len().astype("int64")),
            }
        )

    return go


def scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) -> ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` (log10), ``bits_per_byte`` (code length over bytes with the end)."""
    if not 2 <= depth <= 6:
        raise ValueError("a gram has to fit into 64 bits: depth 2 to 6")
    d = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    made = stage(d.mapInArrow(_blocks(depth, buckets), _MADE), "blocks")
    asked = made.where("kind = 'grams'").select("block", "bucket", "keys", "counts")
    packed = "bucket int, keys binary, counts binary"
    distinct = stage(asked.groupBy("bucket").applyInArrow(_distinct(buckets)(depth), packed), "grams")
    roots = distinct.groupBy("bucket").applyInArrow(_roots(depth), "node long, zeros double, ones double, children double")
    # at most 255 * 257 rows: one per decision and nearest byte
    root = roots.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("children")).orderBy("node").toPandas()
    top = _tops(*[root.iloc[:, i].to_numpy() for i in range(4)])
    scored = distinct.groupBy("bucket").applyInArrow(_scored(depth, top, buckets), "bucket int, keys binary, values binary")
    grams_back = asked.groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(_returned, _FACTS)
    words = made.where("kind = 'words'").select("block", "bucket", "keys", "counts")
    words_back = stage(words.groupBy("bucket").applyInArrow(_word_totals, _FACTS), "words")
    totals = words_back.where("kind = 'total'").agg(F.sum("n"), F.sum("types")).first()
    texts = made.where("kind = 'text'").select("block", "doc_id", "held_out", "text")
    ends = texts.where("not held_out").count()
    n_train, n_types = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    facts = grams_back.union(words_back.where("kind = 'words'"))
    out = texts.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(
        _scores(depth, n_train, n_types, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    )
    out = out.withColumn("train_tokens", F.lit(n_train).cast("long")).withColumn("bits_per_byte", -c("score") / F.lit(np.log10(2.0)) / (c("n_bytes") + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
