"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

The vocabulary's splitter never joins what white space parts, so a text's tokens are the sum over its
white-space-delimited pre-tokens, each encoded by the library on its own.  No ids are kept.

1. One pass over the texts turns every document into (code, frequency) pairs over a dictionary of its
   block (some megabytes of text), and deals each block's dictionary out by the hash of the pre-token.
2. Every bucket of the deal holds all occurrences of its pre-tokens: each is encoded once, and the
   number of pieces goes back to the blocks that have it.
3. Block by block, frequencies times pieces are summed per document.

A frequent pre-token comes once per block, so no key is hot, and buckets and blocks have a bounded
size whatever the input's.

Rows: a null text counts like an empty one (0 bytes, 0 tokens); repeated rows are counted each; special
strings inside texts are handled as the library does by default (one token each).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import packed, packed_ascending, unpacked, unpacked_ascending
from tidemark.llm.words import slices, text_bytes
from tidemark.stage import stage

c = F.col
BLOCK_BYTES, BUCKET_BYTES, AT_ONCE = 12 << 20, 32 << 20, 2_000
LIMIT = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(path: str):
    """Number of pieces of each given text."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no white-space pre-tokens are known for {path}")


_SCHEMA = "block string, bucket int, doc_id long, n_bytes long, codes binary, counts binary, tokens binary"
_PA = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])


def _bucket(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets


def _frequencies(buckets: int):
    def run(batches):
        block, codes, size = uuid.uuid4().hex[:16], {}, 0

        def dictionary():
            words = list(codes)
            where = _bucket(words, buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    own = order[cuts[b] : cuts[b + 1]]
                    yield {"block": block, "bucket": b, "codes": packed_ascending(own), "tokens": zlib.compress(b" ".join([words[i] for i in own]), 1)}

        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            data, ids = raw.tobytes(), batch.column(0).to_pylist()
            for a, b in slices(offsets):
                rows = []
                for i in range(a, b):
                    n = Counter(data[offsets[i] : offsets[i + 1]].split())
                    own = np.fromiter([codes.setdefault(w, len(codes)) for w in n], np.int64, len(n))
                    order = np.argsort(own)
                    rows.append({"block": block, "doc_id": ids[i], "n_bytes": int(offsets[i + 1] - offsets[i]), "codes": packed_ascending(own[order]), "counts": packed(np.fromiter(n.values(), np.int64, len(n))[order])})
                size += int(offsets[b] - offsets[a])
                if size >= BLOCK_BYTES:
                    rows += dictionary()
                yield pa.RecordBatch.from_pylist(rows, _PA)
                if size >= BLOCK_BYTES:
                    block, codes, size = uuid.uuid4().hex[:16], {}, 0
        if codes:
            yield pa.RecordBatch.from_pylist(list(dictionary()), _PA)

    return run


def _pieces(path: str):
    """One bucket: every distinct pre-token is encoded once."""

    def run(group: pa.Table) -> pa.Table:
        encode = _encode(path)
        blocks, codes, tokens = (group.column(x).to_pylist() for x in ("block", "codes", "tokens"))
        known: dict[bytes, int] = {}
        lists = [zlib.decompress(t).split(b" ") for t in tokens]
        for words in lists:
            for w in words:
                known.setdefault(w, 0)
        words = list(known)
        for a in range(0, len(words), AT_ONCE):
            part = words[a : a + AT_ONCE]
            known.update(zip(part, encode([w.decode("utf-8", "replace") for w in part])))
        counts = [packed(np.fromiter([known[w] for w in words], np.int64, len(words))) for words in lists]
        return pa.table({"block": pa.array(blocks, pa.string()), "codes": pa.array(codes, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _sums(docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """One block: frequencies times pieces per document."""
    codes = [unpacked_ascending(x) for x in pieces.column("codes").to_pylist()]
    table = np.zeros(sum(map(len, codes)), np.int64)
    for own, n in zip(codes, pieces.column("counts").to_pylist()):
        table[own] = unpacked(n)
    total = []
    for own, n in zip(docs.column("codes").to_pylist(), docs.column("counts").to_pylist()):
        total.append(int(table[unpacked_ascending(own)] @ unpacked(n)))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())})


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) -> ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (n_tokens > limit)."""
    d = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    made = stage(d.mapInArrow(_frequencies(buckets), _SCHEMA), "frequencies")
    words = made.where("bucket is not null").select("block", "bucket", "codes", "tokens")
    pieces = words.groupBy("bucket").applyInArrow(_pieces(path), "block string, codes binary, counts binary")
    own = made.where("bucket is null").select("block", "doc_id", "n_bytes", "codes", "counts")
    out = own.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", c("n_tokens") > limit)
