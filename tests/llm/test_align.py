"""Alignment of two tokenizers against plain loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Both tokenizers and their token bytes, read in another way than the operator does."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(self, text):
        if not text:
            return [], []
        byte = {chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else None: b for b in range(256)}
        spare = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        byte |= {chr(256 + i): b for i, b in enumerate(spare)}
        e = self.a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(byte[x] for x in t)) for i, t in zip(e.ids, e.tokens)]
        two = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            two.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in one) != want or b"".join(x for _, x in two) != want:
            return [], []
        return one, two


def spans(tokens):
    at = 0
    for i, x in tokens:
        yield i, at, at + len(x)
        at += len(x)


def brute(rows):
    use = Plain()
    per, count = [], Counter()
    for doc_id, text in rows:
        a, b = map(lambda t: list(spans(t)), use.tokens(text))
        links = [(i, j) for i, s, e in a for j, t, u in b if s < u and t < e]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < high) for side in (a, b)))
            low = high
        per.append((doc_id, len(a), len(b), links, ";".join(groups), len(ends)))
        count.update(set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return sorted(str((d, x, y, g, len(m), sum(count[p] == top[p[0]] for p in m), sum(count[p] for p in m), sha(s))) for d, x, y, m, s, g in per), {d: s for d, _, _, _, s, _ in per}


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdehinorstAT'ñ語😀_=-") for _ in range(rng.randint(1, 9)))
    texts = ["  ".join(word() if rng.random() < 0.5 else rng.choice(["the", "ing", "House"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", " ", "\n\n \t", "a▁b", "<s> x </s><|endoftext|>", "\x00\x01", "<0x41>", "the the", "the the", "a" * 3000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the house"), (3, "the house"), (3, "the house")]


@pytest.mark.parametrize("slice_bytes, block_bytes", [(1 << 20, 16 << 20), (50, 200), (1, 1)])
def test_scores_equal_brute_force(spark, monkeypatch, slice_bytes, block_bytes):
    """Whatever the slices and blocks are."""
    r = rows()
    want, _ = brute(r)
    d = spark.createDataFrame(r, "doc_id long, text string")
    run = align._blocks((A, B), align._sha256)

    def cut(batches):
        align.SLICE_BYTES, align.BLOCK_BYTES = slice_bytes, block_bytes
        yield from run(batches)

    monkeypatch.setattr(align, "_blocks", lambda *_: cut)
    got = align.scored(d, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(str(tuple(x)) for x in got.collect()) == want


def test_groups_as_text(spark, docs, no_docs):
    r = [(i, t) for i, t in rows() if i is not None and i != 3]
    got = align.alignments(spark.createDataFrame(r, "doc_id long, text string"), A, B).collect()
    assert {x.doc_id: x.groups for x in got} == brute(r)[1]
    assert align.alignments(no_docs, A, B).count() == 0 and align.scored(no_docs, A, B).count() == 0


def test_links_are_the_merged_ends():
    """As many links as different ends of either side, for random cuts of the same bytes."""
    rng = np.random.default_rng(1)
    n = 200
    cuts = [np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n) for _ in range(2)]
    import pyarrow as pa

    t = [align.Tokens(pa.array(np.zeros(len(x), np.int64)), pa.array(np.arange(len(x))), pa.array(x)) for x in cuts]
    got = align._align(*t)
    s = [np.concatenate(([0], x[:-1])) for x in cuts]
    want = {(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1])) if s[0][i] < cuts[1][j] and s[1][j] < cuts[0][i]}
    assert set(zip(got.a.tolist(), got.b.tolist())) == want and len(got.a) == len(want)
    assert got.closes.sum() == len(set(cuts[0].tolist()) & set(cuts[1].tolist()))


def test_both_readers_of_a_vocabulary_agree():
    """Over characters of all kinds: what ranks give is what the library gives."""
    use, plain = align.byte_level(A), Plain()
    texts = ["".join(f"a{chr(x)}1 {chr(x)}{chr(x)} b" for x in range(lo, lo + 128) if not 0xD800 <= x < 0xE000) for lo in [*range(0, 0x3400, 128), *range(0x3400, 0x30000, 1024)]]
    assert [list(x) for x in use.encode(texts)] == [e.ids for e in plain.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_query_over_the_fixture(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    docs.withColumnRenamed("lang", "code").withColumnRenamed("n_chars", "block").write.parquet(f"{tmp_path}/documents.parquet")
    use, rows = Plain(), docs.collect()
    got = queries.QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()
    want = sorted(str((x.doc_id, *map(len, use.tokens(x.text)))) for x in rows)
    assert sorted(str((x.doc_id, x.n_a, x.n_b)) for x in got) == want
    assert all(x.n_links == x.n_a + x.n_b - x.n_groups for x in got)
