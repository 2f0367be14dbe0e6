"""Near-duplicate documents by MinHash with tensored banding.

A banding scheme with m * m tables of 2r rows each needs 2rm^2 minhashes.  Tensoring (Andoni and Indyk
2006) keeps two collections of m smaller hashes of r minhashes and forms a table key from every pair
of them, so 2rm minhashes give the same number of tables: with m = 8, r = 3 that is 48 instead of 384.
Two sets of Jaccard similarity s share a table when a hash of each collection agrees, with
probability (1 - (1 - s^r)^m)^2: 0.999 at 0.85.

Rows: a null or empty text (or one without words) has no shingles and is linked with nothing; rows
that share a ``doc_id`` are one document; a null ``doc_id`` is never linked and stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.links import linked_classes
from tidemark.llm.words import mix, shingle_hashes, slices, text_bytes, word_hashes
from tidemark.stage import stage

c = F.col
M, R = 8, 3


def _signatures(m: int, r: int, k: int):
    factors = np.random.default_rng(7).integers(1, 2**63, 2 * m * r, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                words, first = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets = [shingle_hashes(words[first[i] : first[i + 1]], k) for i in range(b - a)]
                n = np.array([len(s) for s in sets])
                out = np.zeros((2 + 2 * m, b - a), np.uint64)
                some = n > 0
                if some.any():
                    x = np.concatenate(sets)
                    at = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                    out[0, some] = np.add.reduceat(mix(x ^ np.uint64(0x5BF03635)), at)
                    out[1, some] = np.add.reduceat(mix(x * np.uint64(0xC2B2AE3D27D4EB4F)), at)
                    for i, f in enumerate(factors):
                        low = np.minimum.reduceat(x * f, at)
                        j = 2 + i // r
                        out[j, some] = mix(out[j, some] + low)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array(n.astype(np.int64)), *[pa.array(row.view(np.int64)) for row in out]],
                    names=["doc_id", "n_shingles", "f1", "f2", *[f"h{i}" for i in range(2 * m)]],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                words, first = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets = [shingle_hashes(words[first[i] : first[i + 1]], k).view(np.int64) for i in range(b - a)]
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.ListArray.from_arrays(at, flat)], names=["node", "shingles"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, m: int = M, r: int = R) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= percent * union of their distinct k-word shingles.
    Equal sets are one class first; only one document of each class goes into the tables.
    """
    texts = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
    columns = ", ".join(f"h{i} long" for i in range(2 * m))
    sig = stage(texts.mapInArrow(_signatures(m, r, k), f"doc_id long, n_shingles long, f1 long, f2 long, {columns}"), "signatures")
    hashes = [f"h{i}" for i in range(2 * m)]
    some = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stage(some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("node"), *[F.min(h).alias(h) for h in hashes]), "classes")
    pairs = [F.xxhash64(F.lit(i * m + j), c(f"h{i}"), c(f"h{m + j}")) for i in range(m) for j in range(m)]
    keys = classes.select("node", F.explode(F.array(*pairs)).alias("key"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = texts.join(nodes.select(c("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
        return asked.mapInArrow(_sets(k), "node long, shingles array<long>").distinct()

    sizes = classes.groupBy("node").agg(F.max("n_shingles").alias("n"))
    of = some.select("doc_id", "n_shingles", "f1", "f2").join(classes.select("n_shingles", "f1", "f2", "node"), ["n_shingles", "f1", "f2"])
    of = stage(of.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("top")), "class-of")
    # a document id that stands for several texts joins their classes
    comp = linked_classes(keys, sizes, sets_of, percent, of.where("node != top").select(c("node").alias("a"), c("top").alias("b")))
    own = of.join(comp, "node", "left").select("doc_id", F.coalesce("component", "node").alias("_c"))
    out = sig.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", c("doc_id").eqNullSafe(c("component_id")).alias("kept"))
