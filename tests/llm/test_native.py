"""Quality ledger, site lines, mixing and url rules: defined cases and the SQL twins."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import DATA, compare, connect
from tidemark.llm import lines, mixing, quality, queries, urls

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(got, connect(SF).sql(queries.SQL[name]).df()) is None


def test_native_plans_have_no_python(spark, docs):
    for df in (quality.ledger(docs), mixing.mixed(docs), mixing.emitted(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_repeats(text):
    w = (text or "").split()
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_ledger(spark, docs):
    twice = " ".join(f"q{i % 13}" for i in range(40))
    d = docs.union(spark.createDataFrame([(20, twice, "en", "a", 1), (21, "z " * 50, "en", "a", 1)], docs.schema)).withColumn("fail_bits", F.lit("clash"))
    got = {}
    for r in quality.ledger(d).collect():
        got.setdefault(r.doc_id, r)
        t = r.text or ""
        assert r.n_words == len(t.split()) and r.word_chars == sum(map(len, t.split()))
        assert r.n_symbols == sum(x in "#*$%&|<>" for x in t) and r.n_repeat_words == brute_repeats(t)
        seen = [x for x in t.split("\n") if x.split()]
        assert r.n_dup_lines == len(seen) - len(set(seen))
    assert got[4].n_words == 0 and got[20].n_repeat_words == 40 and got[12].n_dup_lines == 2
    assert got[11].fail_bits & quality.BITS["symbols"] and got[4].fail_bits & quality.BITS["too_few_words"]


def test_ablation(spark, docs, no_docs):
    book = quality.ledger(docs)
    rows = {r.rule: r for r in quality.ablation(book, quality.STRICT).collect()}
    bits = [r.fail_bits & quality.STRICT.mask for r in book.collect()]
    for rule, bit in ((r, quality.BITS[r]) for r in quality.STRICT.rules):
        assert rows[rule].n_failed == sum(bool(b & bit) for b in bits) and rows[rule].n_only_this == sum(b == bit for b in bits)
    assert all(r.n_docs == 0 for r in quality.ablation(quality.ledger(no_docs), quality.BASE).collect())


def test_site_lines(spark, no_docs):
    rows = [(i, f"Menu \nunique {i}\n\nmenu", "en", "a" if i % 2 else None, 1) for i in range(20)] + [(50, None, "en", "a", 1), (51, "", "en", "a", 1), (52, "Menu", "en", "b", 1)]
    d = spark.createDataFrame(rows, no_docs.schema)
    got = {r.doc_id: r for r in lines.drop_boilerplate(d).collect()}
    assert got[0].text == "unique 0\n" and got[1].n_dropped == 2 and got[1].n_lines == 4
    assert got[50].text is None and got[51].text == "" and got[52].text == "Menu"
    assert lines.drop_boilerplate(no_docs).count() == 0


def test_copies_are_not_boilerplate_of_themselves(spark, no_docs):
    """A third of a source are copies of one text: it stays once, and the menu of the other pages still goes."""
    copy = "Menu\n" + "\n".join(" ".join(f"c{i}_{j}" for j in range(12)) for i in range(6))
    rows = [(i, copy if i % 2 else f"  {copy.upper()}", "en", "a", 1) for i in range(30)]
    rows += [(100 + i, "Menu\n" + " ".join(f"u{i}_{j}" for j in range(30)), "en", "a", 1) for i in range(60)]
    d = spark.createDataFrame(rows, no_docs.schema)
    cleaned = corpus_pipeline.line_dedup(spark, d, SF)
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got[1] == copy.removeprefix("Menu\n") and got[100] == rows[30][1].removeprefix("Menu\n") and len(got) == 90
    left = [r.doc_id for r in corpus_pipeline.near_dedup(spark, cleaned, SF).collect()]
    assert sorted(left) == [0, *range(100, 160)]


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by handing the excess on until none is above."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = total / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > most * sizes[i] + 1e-9}
        for i in full or open_:
            target[i] = most * sizes[i] if full else level * weights[i]
            total -= target[i] if full else 0
        if not full:
            break
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [[100, 10, 10, 50], [1, 1, 1000], [0, 5, 5], [0, 0], [7], [5, 400, 3, 3, 3, 90, 1]])
def test_targets(spark, sizes):
    d = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(d).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_mix(spark, docs, no_docs):
    m = [r.asDict() for r in mixing.mixed(docs).collect()]
    assert len(m) == docs.count() and all(0 <= r["copies"] <= 2 for r in m)
    assert m == [r.asDict() for r in mixing.mixed(docs).collect()]
    n = mixing.emitted(docs).count()
    assert n == sum(r["copies"] for r in m)
    assert mixing.mixed(no_docs).count() == 0 and mixing.emitted(no_docs).columns == [*no_docs.columns, "copy"]


def test_mix_comes_near_its_targets(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    for r in mixing.mixed(d).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("top")).collect():
        assert abs(r.taken - r.target) <= 2 * r.top


def test_url_rules(spark):
    good, bad = "http://A.org/x", "http://b.example.org/es/1"
    link = '<a href="http://b.example.org/">x</a>'
    rows = [(1, good, None), (2, bad, ""), (3, None, link), (4, "no scheme", link), (5, "http://c.net", f"{link}{link}"), (6, "x://d.net?q", '<A HREF=//a.org/z>'), (7, "http://b.example.org/en/1", None), (8, "http://e.net/", "<a href='/local'>"), (1, good, None)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].rule == "org/" and got[1].verdict == "allow" and got[2].rule == "example.org/es/" and got[7].rule == "example.org/en/1"
    assert (got[3].host, got[3].path, got[3].verdict) == ("", "", "allow") and got[4].host == ""
    assert got[5].host == "c.net" and got[5].path == "" and got[5].verdict == "block" and got[5].distrust > 0
    assert got[6].host == "d.net" and got[6].verdict == "allow" and got[8].verdict == "allow"


@pytest.mark.parametrize("n", [3, 20, 1000])
def test_linkers_of_a_blocked_host_are_blocked_however_many(spark, n):
    bad = "http://b.example.org/es/1"
    link = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [(0, bad, None), *[(1 + i, f"http://l{i}.net/", link("b.example.org")) for i in range(n)]]
    # one link of hundred of the same weight goes there
    rows += [(5000, "http://large.net/", link("b.example.org") + "".join(link(f"g{i}.net") for i in range(100)))]
    rows += [(6000 + i, f"http://h{i}.net/", "".join(link(f"g{j}.net") for j in range(100))) for i in range(n)]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[1 + i] for i in range(n)} == {"block"} and got[5000] == "allow" and {got[6000 + i] for i in range(n)} == {"allow"}


def test_propagation_equals_plain_loops(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e2")]
    seeds = {"a": 1.0, "d": 1.0}
    now = {h: 0.15 * s for h, s in seeds.items()}
    for _ in range(20):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for s, t in edges:
            new[t] = new.get(t, 0) + 0.85 * now.get(s, 0) / sum(x == s for x, _ in edges)
        now = {h: v for h, v in new.items()}
    got = urls.propagated(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(seeds.items()), "host string, seed double"), 20, 0.85)
    got = {r.host: r.score for r in got.collect()}
    for h, v in now.items():
        assert got.get(h, 0.0) == pytest.approx(v, abs=1e-12)
