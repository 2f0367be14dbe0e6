"""Alignment of two tokenizers over the bytes of each text, in Arrow.

A text is read as its bytes after one space.  Both tokenizers cut these bytes into tokens; where a token
of each ends at the same offset a group ends, and two tokens are linked when their byte ranges overlap.

A slice of texts is aligned by Arrow alone: the lists of ids are flattened with their parent indices,
token lengths become ends by a cumulative sum that starts again with each document, and an Acero full
outer hash join on (document, end) brings both sides together.  In the order of the ends every row is one
link: the token of either side that covers the bytes before an end is the next one that ends there or
later (a backward fill), and rows that both sides have end a group.

Links are counted per document by ``Table.group_by``.  A block of some megabytes of text sends one row per
distinct pair of ids, with the number of its documents that hold the pair, and Spark adds these partial
counts up, finds the highest of each id of the first side, and joins both back to the blocks.  What a
document keeps until then are codes of its block's pairs, so texts and links are never shuffled and a
frequent pair comes once per block.

Rows: null and empty texts, and texts whose tokens of one side do not spell the text again, have no
tokens, zeros everywhere and '' for the groups; every row is a document of its own, repeated rows and
null ids included; other columns are not looked at and not returned.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import packed, packed_ascending, unpacked, unpacked_ascending
from tidemark.stage import stage

c = F.col
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20


@dataclass
class Side:
    """A tokenizer: ids of each text (given without the space), the bytes of each id, and their lengths."""

    encode: Callable[[list[str]], list]
    labels: pa.Array
    lengths: pa.Array


def _side(encode, labels: list[bytes]) -> Side:
    column = pa.array(labels, pa.large_binary())
    return Side(encode, column, pc.binary_length(column))


def byte_level(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text.

    Where the ids follow the merges, tiktoken reads the same vocabulary as ranks, in a fraction of the time.
    """
    from tidemark.llm.bpe import PATTERN, byte_alphabet

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, alphabet, vocab = {x["content"]: x["id"] for x in spec["added_tokens"]}, byte_alphabet(), spec["model"]["vocab"]
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for s, i in (vocab | special).items():
        labels[i] = s.encode() if s in special else bytes(alphabet[x] for x in s)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and not spec["model"].get("ignore_merges") and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs)):
        import tiktoken

        ranks = {labels[i]: i for s, i in vocab.items() if s not in special}
        t = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _side(lambda texts: [t.encode_to_numpy(" " + x, disallowed_special=()) for x in texts], labels)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return _side(lambda texts: [e.ids for e in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)], labels)


def sentence_pieces(path: str) -> Side:
    """A sentencepiece model, which puts the space before a text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    labels = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if sp.is_byte(i) else None
        labels.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return _side(lambda texts: sp.encode(texts, num_threads=1), labels)


_SIDES: dict[str, Side] = {}


def side(path: str) -> Side:
    """One tokenizer per file and worker process: .json is byte-level, .model sentencepiece."""
    if path not in _SIDES:
        _SIDES[path] = byte_level(path) if path.endswith(".json") else sentence_pieces(path)
    return _SIDES[path]


@dataclass
class Tokens:
    """Tokens of a slice in order: the document and the id of each, and where it ends in its document's bytes."""

    doc: pa.Array
    id: pa.Array
    end: pa.Array


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text's begin (one more than texts)."""
    flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in lists)])
    return flat, np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))


def _spelled(use: Side, flat: np.ndarray, at: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which texts the tokens spell, space first."""
    labels = use.labels.take(pa.array(flat))
    ends = np.frombuffer(labels.buffers()[1], np.int64)[: len(labels) + 1][at].tolist()
    data = memoryview(labels.buffers()[2] or b"").cast("B")
    return np.array([i < j and data[i:j] == b" " + x for i, j, x in zip(ends, ends[1:], raw)], bool)


def _tokens(use: Side, flat: np.ndarray, at: np.ndarray) -> Tokens:
    column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
    doc, ids = pc.list_parent_indices(column).cast(pa.int64()), pc.list_flatten(column)
    # a cumulative sum per document: the running one less its value where the document begins
    run = pc.cumulative_sum(use.lengths.take(ids).cast(pa.int64()))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), run]), column.offsets.slice(0, len(at) - 1))
    return Tokens(doc, ids, pc.subtract(run, before.take(doc)))


def _kept(flat: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without the tokens of texts that are not good."""
    n = np.diff(at)
    return flat[np.repeat(good, n)], np.concatenate(([0], np.cumsum(np.where(good, n, 0))))


@dataclass
class Aligned:
    """``doc``, ``a``, ``b`` of each link in order (places of tokens in the slice); ``closes``: whether a group ends with it."""

    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray
    closes: np.ndarray


def _align(a: Tokens, b: Tokens) -> Aligned:
    def rows(t, name):
        return pa.table({"doc": t.doc, "end": t.end, name: pa.array(np.arange(len(t.id)), pa.int64())})

    both = rows(a, "a").join(rows(b, "b"), keys=["doc", "end"], join_type="full outer", use_threads=False)
    both = both.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    one, two = (both.column(x).combine_chunks() if both.num_rows else pa.array([], pa.int64()) for x in ("a", "b"))
    closes = pc.and_(pc.is_valid(one), pc.is_valid(two))
    column = lambda x: x.to_numpy(zero_copy_only=False)
    return Aligned(column(both.column("doc")), column(pc.fill_null_backward(one)), column(pc.fill_null_backward(two)), column(closes))


def _group_texts(found: Aligned, a: Tokens, b: Tokens, n_docs: int) -> list[bytes]:
    """The groups of each document: ids of either side in order, as ``a1,a2|b1;a3|b2,b3``."""
    group = np.cumsum(found.closes) - found.closes  # of each link
    of = []
    for at, n in ((found.a, len(a.id)), (found.b, len(b.id))):
        g = np.zeros(n, np.int64)
        g[at] = group
        of.append(g)
    n_groups = int(found.closes.sum())
    n_a, n_b = (np.bincount(g, minlength=n_groups) for g in of)
    # the place of a token among all: first those of the first side in its group, then the other
    place_a = np.arange(len(of[0])) + (np.cumsum(n_b) - n_b)[of[0]]
    place_b = np.arange(len(of[1])) + np.cumsum(n_a)[of[1]]
    n = len(place_a) + len(place_b)
    ids, part, doc = np.zeros(n, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for place, t, g, k in ((place_a, a, of[0], 0), (place_b, b, of[1], 1)):
        ids[place], part[place], doc[place] = t.id.to_numpy(), 2 * g + k, t.doc.to_numpy()
    part[n], doc[n] = -1, -1
    after = np.where(doc[1:] != doc[:-1], 0, np.where(part[1:] == part[:-1], 1, np.where(part[1:] // 2 == part[:-1] // 2, 2, 3)))
    texts = _numerals(int(ids.max()) + 1 if n else 1).take(pa.array(ids * 4 + after))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: n + 1]
    data = memoryview(texts.buffers()[2] or b"").cast("B")
    at = ends[np.searchsorted(doc[:n], np.arange(n_docs + 1))]
    return [bytes(data[at[i] : at[i + 1]]) for i in range(n_docs)]


def _numerals(n: int, _kept: dict = {}) -> pa.Array:
    """Each id with what can follow it: nothing, ``,`` ``|`` ``;``."""
    if _kept.get("n", 0) < n:
        _kept["n"], _kept["x"] = n, pa.array([f"{i}{s}" for i in range(n) for s in ("", ",", "|", ";")], pa.large_string())
    return _kept["x"]


def _slices(batches, paths: tuple[str, str]) -> Iterator[tuple[list, int, Tokens, Tokens, Aligned]]:
    """Ids of the documents of some texts, their bytes, the tokens of both sides and their links."""
    one, two = map(side, paths)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).fill_null("").cast(pa.large_binary())
        size = pc.binary_length(texts).to_numpy()
        begin = 0
        while begin < len(ids):
            end, held = begin, 0
            while end < len(ids) and (end == begin or held + size[end] <= SLICE_BYTES):
                held += int(size[end])
                end += 1
            raw = texts.slice(begin, end - begin).to_pylist()
            words = [x.decode("utf-8", "replace") for x in raw]
            ids_of = [_flat(use.encode(words)) for use in (one, two)]
            good = _spelled(one, *ids_of[0], raw) & _spelled(two, *ids_of[1], raw) & (size[begin:end] > 0)
            a, b = (_tokens(use, *_kept(*own, good)) for use, own in zip((one, two), ids_of))
            yield ids.slice(begin, end - begin).cast(pa.int64()).to_pylist(), held, a, b, _align(a, b)
            begin = end


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) -> ``doc_id``, ``n_a``, ``n_b``, ``groups`` (``a1,a2|b1;a3|b2,b3``)."""

    def run(batches):
        for ids, _size, a, b, found in _slices(batches, (path_a, path_b)):
            n = [np.bincount(t.doc.to_numpy(), minlength=len(ids)).astype(np.int64) for t in (a, b)]
            groups = [g.decode() for g in _group_texts(found, a, b, len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, n), pa.array(groups, pa.string())], names=["doc_id", "n_a", "n_b", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, groups string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))


_FIELDS = "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, code int, a int, b int, n_docs long"
_PA = pa.schema(
    [("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("codes", pa.binary()), ("times", pa.binary()), ("code", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64())]
)


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _PA], schema=_PA)


def _blocks(paths: tuple[str, str], digest: Callable[[bytes], str]):
    """Rows of documents (with codes of their pairs) and rows of their block's pairs."""

    def run(batches):
        held, docs, links = 0, [], []

        def close():
            name = uuid.uuid4().hex[:16]
            t = pa.concat_tables(links)
            pair, code = np.unique(t.column("pair").to_numpy(), return_inverse=True)
            partial = pa.table({"code": code}).group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code")
            order = np.lexsort((code, t.column("doc").to_numpy()))
            code, times = code[order], t.column("times").to_numpy()[order]
            own = pa.Table.from_pylist(docs)
            at = np.searchsorted(t.column("doc").to_numpy()[order], np.arange(len(docs) + 1))
            cut = lambda x, pack: [pack(x[i:j]) for i, j in zip(at[:-1], at[1:])]
            columns = {x: own.column(x).combine_chunks() for x in own.column_names}
            yield _rows({"block": [name] * len(docs), **columns, "codes": cut(code, packed_ascending), "times": cut(times, packed)})
            if len(pair):
                yield _rows({"block": [name] * len(pair), "code": np.arange(len(pair), dtype=np.int32), "a": (pair >> 32).astype(np.int32), "b": (pair & 0xFFFFFFFF).astype(np.int32), "n_docs": partial.column("count_all").combine_chunks()})

        for ids, size, a, b, found in _slices(batches, paths):
            key = a.id.to_numpy()[found.a].astype(np.int64) << 32 | b.id.to_numpy()[found.b]
            t = pa.table({"doc": found.doc + len(docs), "pair": key}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
            links.append(pa.table({"doc": t.column("doc"), "pair": t.column("pair"), "times": t.column("count_all")}))
            count = lambda x: np.bincount(x, minlength=len(ids)).tolist()
            n = zip(ids, count(a.doc.to_numpy()), count(b.doc.to_numpy()), count(found.doc[found.closes]), count(found.doc), _group_texts(found, a, b, len(ids)))
            docs += [{"doc_id": i, "n_a": x, "n_b": y, "n_groups": g, "n_links": m, "groups_sha256": digest(text)} for i, x, y, g, m, text in n]
            held += size
            if held >= BLOCK_BYTES:
                yield from close()
                held, docs, links = 0, [], []
        if docs:
            yield from close()

    return run


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """One block: what the corpus says about each pair, summed over the links of each document."""
    n = pairs.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, bool)
    code = pairs.column("code").to_numpy()
    count[code], best[code] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    n_best, total = [], []
    for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist()):
        own, times = unpacked_ascending(codes), unpacked(times)
        n_best.append(int(times[best[own]].sum()))
        total.append(int(times @ count[own]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return pa.table({x: docs.column(x) for x in names} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())})


def _sha256(text: bytes) -> str:
    import hashlib

    return hashlib.sha256(text).hexdigest() if text else ""


def pair_counts(made: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` (documents of the corpus that hold the pair linked), ``best`` (no pair of ``a`` has a higher one)."""
    n = stage(made.where("code is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("count")), "pair-counts")
    top = n.groupBy("a").agg(F.max("count").alias("top"))
    return n.join(top, "a").select("a", "b", "count", (c("count") == c("top")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) -> ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is as
    frequent as any of its first id), ``count_sum`` (documents of the pair, summed over the links), and ``groups_sha256`` of the
    groups that ``alignments`` gives as text."""
    made = stage(_texts(docs).mapInArrow(_blocks((path_a, path_b), _sha256), _FIELDS), "alignments")
    pairs = made.where("code is not null").select(c("block").alias("of"), "code", "a", "b").join(pair_counts(made), ["a", "b"]).select("of", "code", "count", "best")
    own = made.where("code is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return own.groupBy("block").cogroup(pairs.groupBy("of")).applyInArrow(_sums, schema)
