"""Near-duplicate documents and paragraphs, components, decontamination."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, links, minhash, paragraphs
from tidemark.llm.words import mix, shingle_hashes, text_bytes, word_hashes


def test_word_hashes_follow_words():
    texts = ["A b\tc", None, "", "a", " b  C\n", "ünï a"]
    raw, offsets = text_bytes(pa.array(texts))
    h, first = word_hashes(raw, offsets)
    assert np.diff(first).tolist() == [3, 0, 0, 1, 2, 2]
    assert h[0] == h[3] == h[7] and h[1] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 4
    assert len(shingle_hashes(h[:0])) == 0 and len(shingle_hashes(h[:3])) == 1 and len(shingle_hashes(h)) == len(h) - 4


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(100, 101)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        if a != b:
            assert got[a] == got[b] == (0 if a < 100 and edges[0] != (1, 1) else 100)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, percent):
    ids = [i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for x, a in enumerate(ids):
            for y, b in enumerate(ids[:x]):
                k = len(sets[x] & sets[y])
                if k and 100 * k >= percent * (len(sets[x]) + len(sets[y]) - k) and comp[a] != comp[b]:
                    low = min(comp[a], comp[b])
                    comp = {i: low if v in (comp[a], comp[b]) else v for i, v in comp.items()}
                    changed = True
    return comp


@pytest.mark.parametrize("seed, cell", [(1, 1000), (2, 4), (3, 1)])
def test_links_in_mixed_buckets_equal_brute_force(spark, monkeypatch, seed, cell):
    """Families whose members share edits with some of the others, so that the bounds of pairs are close; one bucket holds two families."""
    monkeypatch.setattr(links, "CELL", cell)
    rng = random.Random(seed)
    sets, keys = {}, []
    for f in range(4):
        base = {rng.getrandbits(62) for _ in range(rng.choice([9, 14, 80]))}
        pool = [rng.getrandbits(62) for _ in range(10)]
        for _ in range(25):
            gone = set(rng.sample(sorted(base)[: len(base) // 2], rng.randint(0, 3)))
            node = len(sets)
            sets[node] = (base - gone) | set(rng.sample(pool, rng.randint(0, 3))) | {rng.getrandbits(62) for _ in range(rng.randint(0, 1))}
            keys += [(f // 2, node), (10 + 5 * f + rng.randint(0, 4), node)]
    want = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in range(a):
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    want[a] = want[b] = min(want[a], want[b])
    rows = spark.createDataFrame(list({i: sorted(x) for i, x in sets.items()}.items()), "node long, shingles array<long>")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in sets.items()], "node long, n int")
    got = links.linked_classes(spark.createDataFrame(keys, "key long, node long"), sizes, lambda nodes: rows.join(nodes, "node"), 80)
    got = {r.node: r.component for r in got.collect()}
    assert {i: got.get(i, i) for i in sets} == want and len(set(want.values())) > 4


def test_near_documents(spark, docs, no_docs):
    got = [r.asDict() for r in minhash.near_duplicates(docs).collect()]
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1 and not by[3]["kept"]
    assert by[7]["component_id"] == by[8]["component_id"] == 7 and by[7]["n_shingles"] == 1
    assert by[4]["kept"] and by[4]["n_shingles"] == 0 and by[5]["component_id"] == 5 and by[6]["n_shingles"] == 29_996
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_chains_of_edits(spark):
    """Neighbours are linked, ends are not: one component each, whatever meets in a bucket."""
    rng = random.Random(3)
    rows, n = [], 0
    for family in range(6):
        w = [f"f{family}_{i}" for i in range(120)]
        for _ in range(25):
            rows.append((n, " ".join(w)))
            n += 1
            w = list(w)
            w[rng.randrange(len(w))] = f"e{n}"
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = f"g{n}"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()}
    assert got == brute(rows, 85)


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    d = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect()} == {(5, 3), (3, 3), (9, 3)}


def test_paragraphs(spark, docs, no_docs):
    extra = docs.where("doc_id is not null").withColumnRenamed("lang", "removed").withColumnRenamed("n_chars", "at")
    got = {r.doc_id: r for r in paragraphs.drop_repeats(extra).collect()}
    # the passage of 60 words stands in 9 and 10; its ends are in pieces with other words
    assert 16 <= got[9].n_repeated <= 60 and got[9].n_removed == 0 and got[10].first_docs == [9] and got[10].n_removed == got[9].n_repeated
    left = got[10].text.split()
    assert left[0] == "head" and len(left) == 61 - got[10].n_removed and "p530" not in left and "p530" in got[9].text
    assert got[1].n_removed == 0 and got[1].n_repeated >= 50 and got[2].text == "" and got[3].n_removed >= 40 and "w999" in got[3].text
    assert got[4].text is None and got[5].text == "" and got[12].n_removed == 0 and got[6].n_removed == 0 and got[6].n_repeated == 0
    assert paragraphs.drop_repeats(no_docs).count() == 0
    assert paragraphs.bands_for(80, 4, 0.9995) == 15 and paragraphs.bands_for(80, 2, 0.95) == 3


def pieces(words, reach):
    """Cuts of one text by plain loops over the hashes of three words."""
    raw, offsets = text_bytes(pa.array([" ".join(words)]))
    h, _ = word_hashes(raw, offsets)
    one = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    g = [one(int(h[i]) * 0x9E3779B97F4A7C15 + one(int(h[i + 1]) * 0xC2B2AE3D27D4EB4F + int(h[i + 2]))) for i in range(len(h) - 2)]
    at = [0] + [i for i in range(1, len(g)) if all(g[i] < x for x in g[max(0, i - reach) : i]) and all(g[i] <= x for x in g[i + 1 : i + reach + 1])]
    return list(zip(at, [*at[1:], len(h)])) if len(h) else []


def test_cuts_are_local_and_equal_plain_loops():
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 3, 9, 80, 300]))] for _ in range(60)]
    raw, offsets = text_bytes(pa.array([" ".join(t) for t in texts]))
    words, first = word_hashes(raw, offsets)
    got = paragraphs.cuts(words, first)
    for i, t in enumerate(texts):
        own = got[(got >= first[i]) & (got < first[i + 1])] - first[i]
        assert own.tolist() == [a for a, _ in pieces(t, paragraphs.REACH)]
    x, n = paragraphs._shingles([words[a:b] for a, b in ((0, 3), (3, 3), (5, 40))], 5)
    assert n.tolist() == [0, 0, len(x)] and set(x.tolist()) == set(shingle_hashes(words[5:40]).tolist())


def test_passages_equal_brute_force(spark):
    """Passages inside lines, over lines and wrapped anew, some with an edit, a very common one, against plain loops."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(4000)}"
    passages = [[word() for _ in range(rng.choice([30, 55, 70, 120]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.choice([0, 6, 40, 150]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = list(passages[0 if i % 3 == 0 else rng.randrange(12)])
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "\n"]) for x in w)))
    units, sets = [], {}
    for i, text in rows:
        w = text.split()
        for a, b in pieces(w, paragraphs.REACH):
            s = frozenset(tuple(w[j : j + 5]) for j in range(a, b - 4))
            if b - a >= 5:
                units.append((i, a, b, s))
                sets.setdefault(s, (i, a))
    keys = list(sets)
    comp = {s: s for s in keys}
    by = {}
    for s in keys:
        for g in s:
            by.setdefault(g, []).append(s)
    pairs = {(x, y) for group in by.values() for x in group for y in group if x is not y}
    for x, y in pairs:
        if 100 * len(x & y) >= 80 * len(x | y):
            a, b = comp[x], comp[y]
            comp = {k: (a if v is b else v) for k, v in comp.items()} if a is not b else comp
    places = {}
    for i, a, _, s in units:
        places.setdefault(id(comp[s]), []).append((i, a))
    want = {i: [0, 0] for i, _ in rows}
    for n, keep in enumerate((lambda i, a, p: len({d for d, _ in p}) > 1, lambda i, a, p: (i, a) != min(p))):
        last = None
        runs = []
        for i, a, b, s in units:
            if keep(i, a, places[id(comp[s])]):
                if last == (i, a):
                    runs[-1][2] = b
                else:
                    runs.append([i, a, b])
                last = (i, b)
        for i, a, b in runs:
            if b - a >= paragraphs.LEAST_WORDS:
                want[i][n] += b - a
    got = paragraphs.marked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [r.n_repeated, r.n_removed] for r in got} == want and sum(x for x, _ in want.values()) > 1000


def edit_distance_in(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for x in text:
        new = [0]
        for i, y in enumerate(item):
            new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        k = rng.randint(0, 12)
        d, _ = decontaminate.myers(decontaminate.peq(item), len(item), text, k)
        assert d == min(k + 1, edit_distance_in(item, text))


def test_decontamination_equals_brute_force(spark, no_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(15)] + ["", None, "!!!"]
    rows = []
    for n in range(80):
        text = [word() for _ in range(rng.randint(0, 40))]
        if n % 3:
            chars = list(items[n % 15])
            for _ in range(rng.randint(0, 14)):
                chars[rng.randrange(len(chars))] = rng.choice("abcde ")
            text.insert(rng.randint(0, len(text)), "".join(chars).upper() if n % 2 else "".join(chars) + "###")
        rows.append((n, " ".join(text)))
    rows += [(100, None), (101, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for n, text in rows:
        for i, item in enumerate(items):
            x, t = decontaminate.plain(item), decontaminate.plain(text)
            if x and t:
                dist = edit_distance_in(x, t)
                if dist <= decontaminate.budget(x, decontaminate.RATE):
                    want.add((n, i, dist))
    for block in (200, 10**6):
        got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(d, b, block_chars=block).collect()}
        assert got == want and want
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(no_docs, b).count() == 0
