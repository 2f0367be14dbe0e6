"""Extraction, token counts, context-tree scores and the pipeline against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import DATA
from tidemark.llm import ctw, decontaminate, queries, styletree, tokens
from test_near import brute, edit_distance_in

SF = f"{DATA}/sf0.001"


# -- extraction ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b &amp; c<br>d", "a\nb & c d"),
        ("<nav>m</nav><div class='ad box'>x</div><article><h1>T</h1><p>a <b>b</b>&nbsp;c</p><div id=comments><p>no</p></div></article><footer>f</footer>", "T\na b c"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> -->", "x"),
        ("<body class='no-sidebar'><ul><li>one<li>two<ul><li>three</ul></ul>tail", "one\ntwo\nthree\ntail"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("a < b and <3 <", "a < b and <3 <"), ("<p title='a>b'>x", "x"), ("<p title=\"open>x</p>y", "x\ny"),
    ],
)
def test_page(html, want):
    assert "\n".join(t for _, t in styletree.Page(html).blocks) == want


@pytest.mark.parametrize(
    "html, want",
    [
        *[(f"<div {x}><nav>m</nav><article><h1>T</h1><p>a</p></article></div><div class=footer>f</div>", "T\na") for x in ("class=no-sidebar", "id=page class='site has-sidebar'", "class=header-fixed", "class='share-enabled'", "class=hasSidebar", "class=related-on")],
        ("<div class=search-page><div id=comments>c</div><main><p>a</p></main></div>", "a"),
        ("<div class='post with-comments'><p>story</p><p>more</p></div><div class='nav menu'>m</div>", "story\nmore"),
        ("<div class=header-fixed><p>a long story of the day</p></div><p>end</p>", "a long story of the day\nend"),
        # what is no wrapper stays out, whatever its size
        ("<article><p>story</p><div id=comments>more comments than there is story</div></article>", "story"),
        ("<div class=post>the story</div><div class=related><article>one</article><article>two</article></div>", "the story"),
        ("<article>story</article><div class='related posts'><article>a long teaser of another story</article></div>", "story"),
        ("<div class=post><p>the story of the day</p></div><div class=sidebar>links</div>", "the story of the day"),
    ],
)
def test_wrappers_named_after_parts_of_a_page(html, want):
    assert "\n".join(t for _, t in styletree.Page(html).blocks) == want


def test_same_text_on_every_page_goes(spark):
    page = lambda i: f"<div class=top><p>Welcome to our site</p></div><div class=body><p>story {i} of the day</p><p>more on {i * 7}</p></div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(30)] + [(100, "http://small.example/", page(1)), (101, None, None), (102, "http://h.example/x", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("low", F.lit(1)).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in styletree.extract(d).collect()}
    assert len(got) == 33 and got[3].text == "story 3 of the day\nmore on 21" and got[3].n_chars == len(got[3].text)
    assert got[100].text.startswith("Welcome") and got[101].text == "" and got[102].text == ""
    assert styletree.extract(d.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_article(spark):
    """A host of nothing but copies, and one where a third of the pages are copies with a style node of their own."""
    same = "<article><h1>T</h1><p>the one story</p><blockquote class=%s>a word of it</blockquote></article>"
    page = lambda i: f"<article><div class=top>Welcome</div><p>story {i} of the day</p></article>"
    rows = [(i, f"http://all.example/?s={i}", same % "x") for i in range(12)] + [(50 + i, f"http://third.example/?s={i}", same % ("print" if i % 2 else "x")) for i in range(30)]
    rows += [(100 + i, f"http://third.example/{i}", page(i)) for i in range(60)] + [(100, "http://third.example/0", page(0))] * 20
    got = defaultdict(set)
    for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].add(r.text)
    want = {i: {"T\nthe one story\na word of it"} for i in [*range(12), *range(50, 80)]} | {100 + i: {f"story {i} of the day"} for i in range(60)}
    assert got == want


def test_near_copies_keep_their_article(spark):
    """Twelve pages of one article with another date each; one of them also edits the article; a host of nothing but edited copies."""
    article = "<article><h1>The title</h1>" + "".join(f"<p>paragraph {i} tells the same to all who read it</p>" for i in range(5)) + "<div class=when>printed at %d</div></article>"
    rows = [(i, f"http://dates.example/{i}", article % i) for i in range(12)]
    rows[3] = (3, rows[3][1], rows[3][2].replace("paragraph 2 tells", "paragraph 2 told"))
    edited = [("<article>" + "".join(f"<p class=c{k}>part {k} of an article{' with a long edit' * (k == i % 4)}, {i * (k == i % 4)}</p>" for k in range(4)) + "</article>") for i in range(40)]
    rows += [(100 + i, f"http://edits.example/{i}", x) for i, x in enumerate(edited)]
    for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        html = dict((x[0], x[2]) for x in rows)[r.page_id]
        assert r.text.split("\n") == [t for _, t in styletree.Page(html).blocks]


@pytest.mark.parametrize("n", [5, 7, 9, 12, 40])
def test_labels_stay_with_what_they_name(spark, n):
    """Recipes whose headings and row labels are the same on all pages; the line after them is not theirs."""
    page = lambda i: (
        f"<article><h1>Dish {i}</h1><h2>Ingredients</h2><ul><li>{i} eggs and flour</li></ul><h2>Method</h2><p>beat all of it for {i} minutes</p>"
        f"<table><tr><th>Serves</th><td>{i} or {i + 1}</td></tr></table><h2>Stay</h2><div class=more>Read on</div></article>"
    )
    rows = [(i, f"http://food.example/{i}", page(i)) for i in range(n)]
    for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r.page_id
        want = [f"Dish {i}", "Ingredients", f"{i} eggs and flour", "Method", f"beat all of it for {i} minutes", "Serves", f"{i} or {i + 1}"]
        assert r.text == "\n".join(want + ["Stay", "Read on"] * (n < 7)), n


def plain_extract(rows):
    """The style tree of each host in plain loops: (page_id, url, html) -> page_id -> text."""
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        hosts[url.split("/")[2]].append((page_id, styletree.Page(html)))
    out = {}
    for pages in hosts.values():
        bodies = [tuple(sorted({t for _, t in p.blocks}, key=lambda x: (-len(x), x))[:3]) for _, p in pages]
        weight = Counter(bodies)
        seen, styles, kinds = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
        for (_, p), b in zip(pages, bodies):
            for node, text in set(p.blocks):
                seen[node][text] += 1 / weight[b]
            for node, under in p.children.items():
                styles[node][frozenset(under)] += 1 / weight[b]
                kinds[node] |= {frozenset(under)} - {frozenset()}
        low = set()
        for node, by in styles.items():
            m = round(sum(by.values()), 5)
            if m <= 1:
                continue
            entropy = -sum(n / m * math.log(n / m) for n in by.values()) / math.log(m)
            means = [max(math.log(n), 0) for n in seen[node].values()]
            content = 1 - (sum(means) / len(means) if means else 0) / math.log(m)
            g = 0.9 ** len(kinds[node])
            if (2 + m * ((1 - g) * entropy + g * content)) / (2 + m) < 0.25:
                low.add(node)
        for page_id, p in pages:
            stay = [node not in low for node, _ in p.blocks]
            most = sorted({t for _, t in p.blocks}, key=lambda x: (-len(x), x))[:3]
            lost = sum(len(t) for t in most if t not in {x for (_, x), ok in zip(p.blocks, stay) if ok})
            if 2 * lost > sum(map(len, most)):
                stay = [True] * len(stay)
            for i in range(len(stay)):
                if p.labels[i] and not stay[i]:
                    after = [stay[j] for j in range(i + 1, len(stay)) if not p.labels[j]]
                    stay[i] = bool(after) and after[0]
            out[page_id] = "\n".join(t for (_, t), ok in zip(p.blocks, stay) if ok)
    return out


def test_extraction_equals_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for h in range(6):
        tops = [f"notice {k} of site {h}" for k in range(3)]
        for i in range(rng.choice([3, 8, 15, 40])):
            if i and rng.random() < 0.3:  # a copy, some with another counter
                html = rng.choice(rows)[2].replace("seen 1", "seen 2")
            else:
                parts = [f"<div class=top>{rng.choice(tops[: 1 + h % 3])}</div>", f"<h2>{rng.choice(['About', 'Story'])}</h2>"]
                parts += [f"<p>{' '.join(rng.choice('abcdefgh') * rng.randint(2, 9) for _ in range(rng.randint(1, 20)))}</p>" for _ in range(rng.randint(0, 4))]
                parts += [f"<ul class=links>{''.join(f'<li>{x}</li>' for x in ('home', 'shop', 'mail'))}</ul>", "<div class=count>seen 1</div>"]
                html = "<body>" + "".join(parts if rng.random() < 0.8 else rng.sample(parts, len(parts)))
            rows.append((len(rows), f"http://h{h}.example/{i}", html))
    rows.append((len(rows), "http://long.example/", "<p>" + "word and more " * 300_000 + "</p>"))
    got = {r.page_id: r.text for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = plain_extract(rows)
    assert got == want
    assert sum(len(styletree.Page(x[2]).blocks) for x in rows) > sum(len(t.split("\n")) for t in want.values())


def test_importance_is_the_entropy_formula(spark):
    html = ["<div><p>a</p></div>", "<div><p>a</p><h2>b</h2></div>", "<div><p>a</p><p>c</p></div>", "<div><p>d</p></div>"]
    d = spark.createDataFrame([("http://x/", h) for h in html], "url string, html string")
    got = {(r.pages, round(r.content, 9), round(r.presentation, 9)): r.importance for r in styletree.importance(d).collect()}
    m = math.log(4)
    p_node = (4, round(1 - (math.log(3) / m) / 3, 9), 0.0)
    div = (4, 1.0, round(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / m, 9))
    assert p_node in got and got[p_node] == pytest.approx(p_node[1]) and div in got
    assert got[div] == pytest.approx((1 - 0.9**2) * div[2] + 0.9**2)


def test_all_driver_pages_give_their_article(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.op5_style_tree_text(spark, SF).drop("url"), "page_id").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        want = [x for x in inner.replace("<b>", "").replace("</b>", "").replace("<br>", " ").replace("</p>", "<p>").replace("<h1>", "<p>").replace("</h1>", "<p>").split("<p>")]
        want = [" ".join(styletree.entities.unescape(x).split()) for x in want]
        assert r.text == "\n".join(x for x in want if x)


# -- token counts -------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, docs, no_docs):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    odd = ["é x", "a <|endoftext|> b<|startoftext|>c", "don't WON'T it's here", "日本語 テスト", "a b\x0bc\x1cd", "= ̸ ≠", "İstanbul ΣΑΣ", "́ start", "1234 5.6%", " \n "]
    d = docs.union(spark.createDataFrame([(200 + i, t, None, None, 0) for i, t in enumerate(odd)], docs.schema))
    t = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in d.collect())
    got = tokens.token_counts(d, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert tokens.token_counts(no_docs, path).count() == 0


def test_counts_of_driver_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, SF).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}


# -- scores -------------------------------------------------------------------------------------


class Trees:
    """Context-tree weighting by the definition, on dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for node, context, bit in self.bits(t):
                for d in range(depth + 1):
                    self.n[node, context[:d]][bit] += 1
                    if d:
                        self.kids[node, context[: d - 1]].add(context[:d])
        self.known = {}

    def bits(self, text):
        b = bytes([255]) * self.depth + bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()) + bytes([255])
        for p in range(self.depth, len(b)):
            for k in range(8):
                yield (1 << k) | (b[p] >> (8 - k)), b[p - self.depth : p][::-1], (b[p] >> (7 - k)) & 1

    def kt(self, node, context):
        a, b = self.n.get((node, context), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node, context):
        if (node, context) not in self.known:
            own = self.kt(node, context)
            if len(context) < self.depth:
                own = np.logaddexp(own, sum(self.weighted(node, k) for k in self.kids.get((node, context), ()))) - math.log(2)
            self.known[node, context] = own
        return self.known[node, context]

    def next(self, node, context, bit, d=0):
        n = self.n.get((node, context[:d]), (0, 0))
        kt = (n[bit] + 0.5) / (sum(n) + 1)
        if d == self.depth:
            return kt
        w = math.exp(self.kt(node, context[:d]) - math.log(2) - self.weighted(node, context[:d]))
        return w * kt + (1 - w) * self.next(node, context, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.next(*x)) for x in self.bits(text))


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_scores_equal_the_definition(spark, depth):
    texts = ["abra cadabra Abra", "", None, "the cat sat on the mat", "ünï the Mat", "zz unseen zz", "the hat", "abra"] * 2
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if not ctw.held_out(i)] + ["no id"]
    assert len(train) < len(texts) + 1
    trees = Trees(train, depth)
    n = Counter(w for t in train for w in [*(t or "").lower().encode().split(), None])
    total = sum(n.values()) + len(n) + 1
    got = ctw.scores(d.repartition(3), depth).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = "no id" if r.doc_id is None else texts[r.doc_id]
        own = [*(t or "").lower().encode().split(), None]
        assert r.score == pytest.approx(trees.score(t), abs=1e-7) and r.train_tokens == sum(n.values())
        assert r.n_tokens == len(own) and r.n_known == sum(n[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((n[w] + 1) / total) for w in own), abs=1e-9)
        assert r.held_out == (r.doc_id is not None and ctw.held_out(r.doc_id))


def test_probabilities_add_up_to_one():
    keys, counts = np.unique(np.random.default_rng(0).integers(0, 3, (500, 4)) @ [1 << 24, 1 << 16, 1 << 8, 1], return_counts=True)
    context = keys[0] >> 8
    every = np.unique(np.concatenate([keys, (context << 8) + np.arange(256)]))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, keys)] = counts
    parts = [np.flatnonzero(every >> 16 == g) for g in np.unique(every >> 16)]
    ups = [ctw._parents(*ctw._subtrees(every[s], n[s], 3)[0][-1][:4]) for s in parts]
    table = defaultdict(lambda: np.zeros(3))
    for up, _at, z, o, below in ups:
        for i, node in enumerate(up):
            table[node] += (z[i], o[i], below[i])
    nodes = np.array(sorted(table))
    top = ctw._tops(nodes, *np.array([table[x] for x in nodes]).T)
    own = next(s for s in parts if context >> 8 == every[s][0] >> 16)
    p = 10 ** ctw._log10_of(every[own], n[own], 3, top)
    assert p[every[own] >> 8 == context].sum() == pytest.approx(1.0)


def test_held_out_text_is_predicted_better_than_chance(spark, no_docs):
    assert ctw.scores(no_docs).count() == 0
    got = queries.op9_context_tree_scores(spark, SF).where("held_out").agg(F.avg("bits_per_byte").alias("b")).first()
    assert got.b < 3


# -- pipeline -----------------------------------------------------------------------------------


def plain_pipeline(rows, items):
    import re

    # quality
    def bad(t):
        w = t.split()
        bare = re.sub(r"[\x20\x09-\x0D]+", "", t)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        rep = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        ln = [x for x in t.split("\n") if x.split()]
        upper, letters = sum(x.isupper() for x in bare), sum(x.isalpha() for x in bare)
        symbols = sum(x in "#*$%&|<>" for x in t)
        return (
            len(w) < 20 or 100 * rep > 30 * len(w) or 10 * symbols > len(w) or 2 * (len(ln) - len(set(ln))) > len(ln) or len(bare) < 2 * len(w) or len(bare) > 20 * len(w)
            or 2 * upper > letters or (len(w) < 400 and 4 * len(set(w)) < len(w))
        )

    rows = [r for r in rows if not bad(r[1] or "")]
    # lines
    pages, n = Counter(r[2] for r in rows), Counter()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower() if x.isascii() else "".join(y.lower() if y.isascii() else y for y in x.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        n.update((r[2], k) for k in {key(x) for x in r[1].split("\n")} if k)
    rows = [(i, "\n".join(x for x in t.split("\n") if not (n[s, key(x)] >= 5 and n[s, key(x)] > 0.05 * pages[s])), s) for i, t, s in rows]
    comp = brute([(i, t) for i, t, _ in rows], 85)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    found = [decontaminate.plain(x) for x in items]
    rows = [r for r in rows if not any(x and (x in decontaminate.plain(r[1])) for x in found)]
    return rows


def test_pipeline(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for i, t, _ in plain_pipeline([(r.doc_id, r.text, r.source) for r in raw], items)}
    got = corpus_pipeline.run(spark, SF).collect()
    before = {r.doc_id: r for r in raw}
    for r in got:
        assert want[r.doc_id] == r.text and r.source == before[r.doc_id].source and r.lang == before[r.doc_id].lang
        assert r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars)
    copies = Counter(r.doc_id for r in got)
    assert max(copies.values()) <= 2 and {r.copy for r in got} <= {1, 2}
    # what the mix leaves out is within the shares of its sources
    taken, size = Counter(), Counter()
    source = {r.doc_id: r.source for r in raw}
    for i, t in want.items():
        size[source[i]] += len(t.split())
        taken[source[i]] += len(t.split()) * copies[i]
    longest = max(len(t.split()) for t in want.values())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=2 * longest * len(size))


@pytest.mark.parametrize("rows", ["docs", "no_docs"])
def test_stages_take_any_rows(spark, request, rows, tmp_path):
    d = request.getfixturevalue(rows)
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, d.withColumn("extra", F.lit(1)).withColumn("size", F.lit("x")), SF)
        out.write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        assert d.columns[:5] == corpus_pipeline.COLUMNS, name
