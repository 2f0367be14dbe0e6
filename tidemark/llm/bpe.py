"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The merges are compiled into a deterministic automaton over tokens that reads exactly the sequences
which merging gives (Berglund, Martens and van der Merwe 2024).  It starts with one state that every
byte loops on.  Each merge ``u v -> w``, in order of rank, puts in a gadget: the state that ``u`` leads
to is copied without its arc ``v`` and ``u`` leads to the copy from now on, so ``u v`` can no longer be
read; wherever ``u`` can be read there is an arc ``w`` as well, which leads where ``v`` led.

A state differs from the first one only by arcs it lacks.  Tokens are numbered in post-order of the
tree of left parts (``u`` is the parent of ``w``, children by rank), by which the loss of an arc ``v``
together with all later tokens that begin with it is one interval of numbers.  A state is the sorted
table of its intervals, and a transition is one binary search in it.

A text is cut into words by the vocabulary's pattern, and a word's tokens are the one path of the
automaton that spells it.  Equal words of some megabytes of text are encoded once, all of them step by step
together; decoding joins the labels of the arcs.

Rows: each row is encoded on its own and whole; a null text is an empty one and has no ids; a null
``doc_id`` and repeated rows stay; other columns are not looked at and not returned.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import slices, text_bytes

c = F.col
#: Fixed value: how byte-level vocabularies cut a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of at most so many bytes are encoded together, longer ones each by itself; words of a text, and bytes of texts, taken at once.
TOGETHER, WORDS_AT_ONCE, SLICE_BYTES = 48, 1 << 20, 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """``labels``: token -> bytes; ``merges``: (left, right, token) by rank; tokens that no merge makes and that
    are one byte long are the alphabet."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        if len({w for _, _, w in merges}) != len(merges):
            raise ValueError("two merges make the same token")
        self.labels = labels
        made = {w for _, _, w in merges}
        alphabet = [t for t, label in labels.items() if len(label) == 1 and t not in made]
        children: dict[int, list[int]] = {}
        ranks: dict[int, list[int]] = {}
        for rank, (u, _v, w) in enumerate(merges):
            children.setdefault(u, []).append(w)
            ranks.setdefault(u, []).append(rank)
        low, number = self._post_order(alphabet, children)
        self.states = self._compile(alphabet, merges, children, ranks, low, number)
        self._build_arcs(number)
        self._build_tables(number)

    @staticmethod
    def _post_order(alphabet, children):
        """First number of each token's subtree, and each token's own number (the last of its subtree)."""
        low, number, n = {}, {}, 0
        todo = [(t, False) for t in reversed(alphabet)]
        while todo:
            t, done = todo.pop()
            if done:
                number[t] = n
                n += 1
            else:
                low[t] = n
                todo.append((t, True))
                todo += [(x, False) for x in reversed(children.get(t, ()))]
        return low, number

    @staticmethod
    def _compile(alphabet, merges, children, ranks, low, number):
        """Token -> the state it leads to, as (first numbers, last numbers) of what the state cannot read."""
        first = ([], [])
        states = dict.fromkeys(alphabet, first)
        for rank, (u, v, w) in enumerate(merges):
            if u not in states or v not in states:
                continue  # made of a token that is never read
            begins, ends = states[u]
            p = number[v]
            at = bisect_right(begins, p)
            if at and ends[at - 1] >= p:
                continue  # u v is never read: the merge does nothing
            states[w] = states[v]
            # v and what begins with it from this rank on; earlier such tokens can still be read
            later = bisect_left(ranks.get(v, ()), rank)
            begin = low[children[v][later]] if later < len(ranks.get(v, ())) else p
            at = bisect_left(begins, begin)
            states[u] = ([*begins[:at], begin, *begins[at:]], [*ends[:at], p, *ends[at:]])
        return states

    def _build_arcs(self, number):
        """The bytes of the tokens as a tree: (node << 8 | byte) -> node, and what can be read at a node."""
        self.whole = {self.labels[t]: t for t in self.states}
        self.step: dict[int, int] = {}
        self.read: list[tuple[int, int] | None] = [None]
        for t in self.states:
            node = 0
            for b in self.labels[t]:
                node = self.step.setdefault(node << 8 | b, len(self.read))
                if node == len(self.read):
                    self.read.append(None)
            self.read[node] = (t, number[t])

    def _build_tables(self, number):
        """The same as arrays: states one after the other, nodes of the tree in a hash table."""
        span = max(number.values(), default=0) + 1
        n = max(self.labels, default=0) + 1
        self._lead, self._size = np.zeros(n, np.int64), np.ones(n, np.int64)
        known, begins, ends = {}, [], [-1]
        for t, state in self.states.items():
            if id(state) not in known:
                known[id(state)] = at = (len(known) + 1) * span
                begins += [at + x for x in state[0]]
                ends += [at + x for x in state[1]]
            self._lead[t], self._size[t] = known[id(state)], len(self.labels[t])
        self._begins, self._ends = np.array(begins, np.int64), np.array(ends, np.int64)
        self._token = np.array([-1 if x is None else x[0] for x in self.read], np.int64)
        self._number = np.array([0 if x is None else x[1] for x in self.read], np.int64)
        bits = max(8, len(self.step).bit_length() + 3)
        self._shift = np.uint64(64 - bits)
        self._keys, self._nodes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys, nodes = np.array(list(self.step), np.int64), np.array(list(self.step.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self._keys[at] < 0
            self._keys[at[free]], self._nodes[at[free]] = keys[free], nodes[free]
            left = self._keys[at] != keys  # another key has the slot
            # of two new keys in one slot one was written last, with its node
            self._nodes[at[~left]] = nodes[~left]
            keys, nodes, at = keys[left], nodes[left], (at[left] + 1) & (len(self._keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where each node's arc of its byte leads, -1 without one."""
        keys = node << 8 | byte
        at = self._slot(keys)
        out = np.where(self._keys[at] == keys, self._nodes[at], -1)
        on = np.flatnonzero((self._keys[at] != keys) & (self._keys[at] >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self._keys) - 1)
            hit = self._keys[at[on]] == keys[on]
            out[on[hit]] = self._nodes[at[on[hit]]]
            on = on[~hit & (self._keys[at[on]] >= 0)]
        return out

    def encode_words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after the other, and where each word's begin (one more than words).

        All words advance together.  Every prefix of a word has one path, so its last token says the state; the
        arcs that spell the next bytes, where the state has them, are the last tokens of longer prefixes.
        """
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -TOGETHER))
        own = {int(w): self.encode_word(raw[offsets[w] : offsets[w + 1]].tobytes()) for w in order[:long]}
        order = order[long:]
        length, begin = size[order], offsets[:-1][order]
        top = int(length[0]) if len(length) else 0
        more = np.searchsorted(-length, -np.arange(top + 1))  # words longer than this, the longest first
        last = np.full((top + 1, len(order)), -1, np.int64)
        letters = np.zeros((top, len(order)), np.int64)
        for j in range(top):
            letters[j, : more[j]] = raw[begin[: more[j]] + j]
        for i in range(top):
            word = np.arange(more[i])
            state = self._lead[last[i, word]] if i else np.zeros(more[i], np.int64)
            node = np.zeros(more[i], np.int64)
            for j in range(i, top):
                n = int(np.searchsorted(word, more[j]))
                node = self._next(node[:n], letters[j, word[:n]])
                on = np.flatnonzero(node >= 0)
                if not len(on):
                    break
                word, state, node = word[on], state[on], node[on]
                token = self._token[node]
                at = np.flatnonzero(token >= 0)
                number = state[at] + self._number[node[at]]
                # the interval that begins last before it: an earlier state's ends before it as well
                at = at[self._ends[np.searchsorted(self._begins, number, "right")] < number]
                last[j + 1, word[at]] = token[at]
        return self._paths(last, order, length, own, len(size))

    def _paths(self, last, order, length, own, n_words):
        """From the last token of each word back to its first."""
        steps, word, at = [], np.flatnonzero(length), length[length > 0]
        while len(word):
            token = last[at, word]
            steps.append((word, token))
            at = at - self._size[token]
            word, at = word[at > 0], at[at > 0]
        n = np.zeros(n_words, np.int64)
        for word, _ in steps:
            n[order[word]] += 1
        for w, ids in own.items():
            n[w] = len(ids)
        begin = np.concatenate(([0], np.cumsum(n)))
        out = np.zeros(begin[-1], np.int32)
        for i, (word, token) in enumerate(steps):
            out[begin[order[word] + 1] - 1 - i] = token
        for w, ids in own.items():
            out[begin[w] : begin[w + 1]] = ids
        return out, begin

    def _spelled(self, word: bytes, at: int) -> list[tuple[int, int, int]]:
        """(token, its number, where it ends) of the tokens that spell what follows ``at``, the longest last."""
        step, read, node, out = self.step, self.read, 0, []
        for end in range(at, len(word)):
            node = step.get(node << 8 | word[end])
            if node is None:
                break
            if read[node] is not None:
                out.append((*read[node], end + 1))
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The one path of the automaton that spells ``word``.

        The longest arc is tried first.  A prefix has one path, so a place from which the word's end cannot be
        reached is left for good, and each place is looked at once.
        """
        t = self.whole.get(word)
        if t is not None:
            return [t]
        n, path, places, dead = len(word), [], [0], set()
        tries = [self._spelled(word, 0)] if n else []
        begins, ends = [], []
        while tries:
            arcs = tries[-1]
            while arcs:
                t, number, end = arcs.pop()
                at = bisect_right(begins, number)
                if (at and ends[at - 1] >= number) or end in dead:
                    continue
                path.append(t)
                if end == n:
                    return path
                begins, ends = self.states[t]
                places.append(end)
                tries.append(self._spelled(word, end))
                break
            else:
                dead.add(places.pop())
                tries.pop()
                if path:
                    path.pop()
                begins, ends = self.states[path[-1]] if path else ([], [])
        return path


class Codec:
    """A byte-level vocabulary: texts to ids and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take up their surroundings")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        labels = {i: bytes(alphabet[x] for x in s) for s, i in vocab.items() if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = labels | {i: s.encode() for s, i in special.items()}
        self._labels = pa.array([self.labels.get(i) for i in range(max(self.labels) + 1)], pa.large_binary())
        self.special = special
        # the longest of the added tokens that begin at one place wins
        names = sorted(special, key=lambda s: (-len(s), s))
        self._cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._words = regex.compile(PATTERN)
        if any(self._words.fullmatch(x) for x in special):
            raise ValueError(f"{path} has an added token that is a word as well")

    def _word_lists(self, texts: list[str]):
        """Words in order, at most so many at once, and the text of each list's words."""
        words, of = [], []
        for i, text in enumerate(texts):
            parts = self._cut.split(text) if self._cut is not None and any(x in text for x in self.special) else (text,)
            for part in parts:
                if part in self.special:
                    words.append(part)
                elif len(part) <= WORDS_AT_ONCE:
                    words += self._words.findall(part)
                else:
                    found = self._words.finditer(part)
                    while some := [m.group() for m in islice(found, WORDS_AT_ONCE)]:
                        words += some
                        if len(words) >= WORDS_AT_ONCE:
                            yield words, np.array([*of, (i, len(words))])
                            words, of = [], []
            of.append((i, len(words)))
            if len(words) >= WORDS_AT_ONCE:
                yield words, np.array(of)
                words, of = [], []
        if words:
            yield words, np.array(of)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more than texts)."""
        ids, n = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for words, of in self._word_lists(texts):
            column = pa.array(words, pa.large_string()).dictionary_encode()
            code, distinct = column.indices.to_numpy(), column.dictionary
            raw = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
            flat, begin = self.automaton.encode_words(raw, np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1])
            if not self.special.keys().isdisjoint(words):
                own = [[self.special[w]] if w in self.special else flat[i:j].tolist() for w, i, j in zip(distinct.to_pylist(), begin, begin[1:])]
                flat, begin = np.array(sum(own, []), np.int32), np.concatenate(([0], np.cumsum(list(map(len, own)))))
            size = np.diff(begin)[code]
            end = np.cumsum(size)
            ids.append(flat[np.repeat(begin[code] - end + size, size) + np.arange(end[-1])])
            # texts without words in this list repeat the place before them
            place = np.concatenate(([0], end))[of[:, 1]]
            np.add.at(n, of[:, 0], np.diff(place, prepend=0))
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(n)))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each row of ids: the labels of its arcs."""
        parts = self._labels.take(pa.array(ids, pa.int64()))
        if parts.null_count:
            raise KeyError("an id that the vocabulary lacks")
        ends = np.frombuffer(parts.buffers()[1], np.int64)[: len(ids) + 1]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].tobytes()), parts.buffers()[2] or pa.py_buffer(b"")])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # ids may end within a character
            return pa.array([x.as_py().decode("utf-8", "replace") for x in whole], pa.string())

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One compiled vocabulary per worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) -> ``doc_id``, ``ids`` (array of int): the tokens of the whole text, no special
    tokens added; strings of special tokens inside a text are those tokens."""

    def run(batches):
        use = codec(path)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)]
                ids, at = use.encode_all(texts)
                rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows], names=["doc_id", "ids"])

    return docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (``doc_id``, ``ids``) -> ``doc_id``, ``ids``, ``text``; special tokens stay in the text.  Null ids give a
    null text; an id that the vocabulary lacks is an error."""

    def run(batches):
        use = codec(path)
        for batch in batches:
            ids = batch.column(1)
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = use.decode_all(flat[at[0] : at[-1]], at - at[0])
            if ids.null_count:
                texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, texts], names=["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
