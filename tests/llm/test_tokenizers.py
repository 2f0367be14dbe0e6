"""The tokenization automaton against plain merging and against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def merged(word, ranks):
    """Plain byte-pair merging: the leftmost pair of the lowest rank first."""
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def trained(rng, n):
    """Merges as training finds them: each joins a pair that stands in a text merged so far."""
    text = [rng.choice("abc") for _ in range(400)]
    merges = []
    while len(merges) < n:
        pairs = sorted(set(zip(text, text[1:])))
        made = {a + b for a, b in merges}
        pairs = [p for p in pairs if p[0] + p[1] not in made and len(p[0] + p[1]) < 9]
        if not pairs:
            break
        p = rng.choice(pairs)
        merges.append(p)
        out = []
        for x in text:
            if out and (out[-1], x) == p:
                out[-1] += x
            else:
                out.append(x)
        text = out
    return merges


@pytest.mark.parametrize("seed", range(6))
def test_automaton_reads_what_merging_gives(seed):
    rng = random.Random(seed)
    merges = trained(rng, 25)
    tokens = ["a", "b", "c", *[a + b for a, b in merges]]
    number = {t: i for i, t in enumerate(tokens)}
    made = bpe.Automaton({i: t.encode() for t, i in number.items()}, [(number[a], number[b], number[a + b]) for a, b in merges])
    ranks = {p: i for i, p in enumerate(merges)}
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 24)))
        assert [tokens[t] for t in made.encode_word(w.encode())] == merged(w, ranks), w
        ids, at = made.encode_words(np.frombuffer((w + "ab" + w).encode(), np.uint8), np.array([0, 0, len(w), len(w) + 2, 2 * len(w) + 2]))
        assert [[tokens[t] for t in ids[i:j]] for i, j in zip(at, at[1:])] == [[], merged(w, ranks), merged("ab", ranks), merged(w, ranks)]


def test_automaton_leaves_out_merges_that_never_happen():
    # b c goes first, so a b is read before c only where no c follows, and "ab" "c" never
    tokens = ["a", "b", "c", "bc", "ab", "abc"]
    made = bpe.Automaton({i: t.encode() for i, t in enumerate(tokens)}, [(1, 2, 3), (0, 1, 4), (4, 2, 5)])
    assert [tokens[t] for t in made.encode_word(b"abcab")] == ["a", "bc", "ab"]
    with pytest.raises(ValueError):
        bpe.Automaton({0: b"a", 1: b"aa"}, [(0, 0, 1), (0, 0, 1)])


def test_codec_equals_library(library):
    use, rng = bpe.codec(PATH), random.Random(2)
    texts = ["".join(f"a{chr(x)}1 {chr(x)}{chr(x)} b" for x in range(lo, lo + 64)) for lo in range(0, 0x3200, 64)]
    texts += ["".join(rng.choice("aabcdehinorst   Tsx\n'-_=.ñ語😀") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "x <|endoftext|><|endoftext|>  y", "<|endoftext| >", " \n<|endoftext|>\n ", "a" * 50_000, " " * 20_001, "=-" * 9000, "é" * 5000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert use.encode(text) == ids
        assert use.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    assert use.decode(use.encode("é")[:1]) == "�" or len(use.encode("é")) == 1


def test_texts_together_and_in_pieces(library, monkeypatch):
    """Whatever is taken at once: the same ids."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdehinorst  T\n'1ñ語") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += ["", "<|endoftext|>", "", "x" * 500, "a <|endoftext|>b", "", " ".join("word" for _ in range(300)), ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for name, value in (("WORDS_AT_ONCE", 7), ("TOGETHER", 3), ("TOGETHER", 600)):
        monkeypatch.setattr(bpe, name, value)
        ids, at = bpe.codec(PATH).encode_all(texts)
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want
    assert bpe.codec(PATH).encode_all([])[1].tolist() == [0]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_encoding_query(spark, docs, no_docs, library, tmp_path):
    """Nulls, empty and very long texts, repeated rows, a column named like a result; the registered query."""
    extra = docs.withColumnRenamed("lang", "ids")
    got = bpe.decoded(bpe.encoded(extra, PATH), PATH).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in docs.collect()]
    assert sorted(map(str, [(r.doc_id, list(r.ids), r.text) for r in got])) == sorted(map(str, want))
    assert bpe.encoded(no_docs, PATH).count() == 0
    assert bpe.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).collect()[0].text is None
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["op11_bpe_automaton"](spark, str(tmp_path)).collect()}
    assert got == {(i, len(ids), sha(",".join(map(str, ids))), sha(text)) for i, ids, text in want}


def test_a_bad_vocabulary_is_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
