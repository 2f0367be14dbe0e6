"""Registered queries of the operators over the driver tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import align, bpe, ctw, decontaminate, lines, minhash, mixing, negatives, paragraphs, quality, styletree, tokens, urls

c = F.col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


W = r"[^\x20\x09-\x0D]+"
#: A-Z to lower case and nothing else; the functions for whole alphabets differ between engines.
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OUTER = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SHINGLES = f"""words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{W}') AS w FROM documents),
  grams AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM words),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id)"""


@query(
    f"""WITH RECURSIVE {SHINGLES},
    links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
      JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * i >= 85 * (s.n + t.n - i)),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r AS component_id, d.doc_id = r AS kept
    FROM documents d JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""
)
def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    k AS (SELECT *, translate(trim(line, {OUTER}), {AZ}) AS k FROM l),
    t AS (SELECT source, list_filter(list_transform(string_split(text, chr(10)), lambda x: translate(trim(x, {OUTER}), {AZ})), lambda x: x <> '') AS ks FROM documents),
    u AS (SELECT DISTINCT source, list_filter(ks, lambda x, i: list_position(ks, x) = i) AS ks FROM t),
    p AS (SELECT source, count(*) AS pages FROM u GROUP BY source),
    n AS (SELECT source, k, count(*) AS n FROM (SELECT source, unnest(ks) AS k FROM u) x GROUP BY source, k),
    b AS (SELECT n.source, k FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n >= {lines.LEAST} AND n > CAST({lines.RATIO} AS DOUBLE) * pages),
    m AS (SELECT k.*, b.k IS NOT NULL AS bad FROM k LEFT JOIN b ON k.k = b.k AND k.source IS NOT DISTINCT FROM b.source),
    g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS text FROM m GROUP BY doc_id)
    SELECT d.doc_id, d.source, g.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN g USING (doc_id)"""
)
def op3_site_line_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(c("doc_id").cast("long").alias("doc_id"), "source", "text")
    return lines.drop_boilerplate(d).select("doc_id", "source", "text", "n_lines", "n_dropped")


def _bits() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))


@query(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
    win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 's': array_to_string(w[i:i+7], ' ')}})) AS p FROM t),
    g AS (SELECT doc_id, p.i AS i, count(*) OVER (PARTITION BY doc_id, p.s) AS n FROM win),
    cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
    m AS (SELECT t.doc_id, len(w) AS n_words, regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS bare, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS ln,
            coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct_words FROM t LEFT JOIN cov USING (doc_id)),
    f AS (SELECT doc_id, n_words, length(bare) AS word_chars, length(bare) - length(translate(bare, '#*$%&|<>', '')) AS n_symbols,
            len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines, n_repeat_words,
            length(regexp_replace(bare, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(bare, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, n_distinct_words FROM m),
    b AS (SELECT *, {_bits()} AS fail_bits FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
      n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (fail_bits & {quality.STRICT.mask}) = 0 AS kept FROM b"""
)
def op8_quality_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(c("doc_id").cast("long").alias("doc_id"), "text")
    book = quality.ledger(d)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.STRICT).alias("kept"),
    )


@query(
    f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
    x AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS total FROM w),
    y AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
    z AS (SELECT *, (SELECT max(level) FROM y WHERE level * weight <= cap) AS best FROM y),
    a AS (SELECT source, source_size, least(cap, coalesce(best * weight, cap)) AS target,
                 CAST('0x' || substr(md5('mix/' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM z),
    r AS (SELECT d.doc_id, size, a.source_size, target, u, CASE WHEN a.source_size > 0 THEN target / a.source_size ELSE 0 END AS rate,
                 row_number() OVER (PARTITION BY d.source ORDER BY size, ((coalesce(doc_id, -1) % 997) + 997) % 997, doc_id) AS rank FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
    SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT) * size AS taken FROM r"""
)
def op10_systematic_mix(spark, sf_dir):
    m = mixing.mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (c("copies") * c("size")).alias("taken"))


@query()
def op6_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


@query()
def op9_context_tree_scores(spark, sf_dir):
    return ctw.scores(table(spark, sf_dir, "documents"))


@query()
def op5_style_tree_text(spark, sf_dir):
    return styletree.extract(table(spark, sf_dir, "pages"))


def _rounds(name: str, src: str, dst: str, seeds: str) -> str:
    """The rounds of score propagation as one common table expression each."""
    d = urls.DAMPING
    out = [f"{name}w AS (SELECT {src} AS src, {dst} AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY {src}) AS w FROM edges)", f"{name}0 AS MATERIALIZED (SELECT host, {1 - d}::DOUBLE AS score FROM seed WHERE {seeds})"]
    for i in range(1, urls.ROUNDS + 1):
        out.append(
            f"{name}{i} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT dst AS host, {d}::DOUBLE * score * w AS score FROM {name}w JOIN {name}{i - 1} p ON p.host = src UNION ALL SELECT * FROM {name}0) x GROUP BY host)"
        )
    return ", ".join(out)


def _rule_case(value) -> str:
    whens = []
    for rule, allowed in sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0])):
        host, path = urls._split(rule)
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {value(rule, allowed)}")
    return "CASE " + " ".join(whens) + " END"


_HOST = f"translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), {AZ})"


@query(
    f"""WITH u AS (SELECT page_id, html, {_HOST} AS host, coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    j AS (SELECT page_id, html, host, path, {_rule_case(lambda r, a: f"'{r}'")} AS rule, {_rule_case(lambda r, a: str(a).upper())} AS allowed FROM u),
    edges AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{urls.LINK.replace("'", "''")}', 1)), {AZ}) AS dst FROM j) l WHERE src <> dst AND src <> '' AND dst <> ''),
    seed AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE allowed) AS good, count(*) FILTER (WHERE NOT allowed) AS bad FROM j WHERE host <> '' GROUP BY host),
    {_rounds('t', 'src', 'dst', f'good >= {urls.SHARE} * n AND good > bad')}, {_rounds('b', 'dst', 'src', f'bad >= {urls.SHARE} * n AND bad > good')},
    linkers AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst),
    reach AS (SELECT src AS host, sum({urls.DAMPING * (1 - urls.DAMPING)!r}::DOUBLE / n) AS most FROM edges JOIN linkers USING (dst) GROUP BY src),
    s AS (SELECT page_id, j.host, path, rule, allowed, coalesce(t.score, 0) AS trust, coalesce(b.score, 0) AS distrust, coalesce(most, 0) AS most
      FROM j LEFT JOIN t{urls.ROUNDS} t ON t.host = j.host LEFT JOIN b{urls.ROUNDS} b ON b.host = j.host LEFT JOIN reach r ON r.host = j.host)
    SELECT page_id, host, path, rule, CASE WHEN coalesce(allowed, NOT ((distrust >= {urls.LEAST} OR (most > 0 AND distrust >= {urls.LEAST} * most)) AND distrust > trust)) THEN 'allow' ELSE 'block' END AS verdict FROM s"""
)
def op1_link_trust_urls(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op4_paragraph_dedup(spark, sf_dir):
    d = paragraphs.marked(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["begin"], x["end"]))
    return d.withColumns({"removed": F.array_join(spans, ","), "first_docs": F.array_join(c("first_docs").cast("array<string>"), ",")})


@query()
def op11_bpe_automaton(spark, sf_dir):
    path = tokens.vocabulary("byte_bpe_50k.json")
    d = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), path), path)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return d.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(c("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(c("text")).alias("decoded_sha256"),
    )


@query()
def op12_token_alignment(spark, sf_dir):
    d = align.scored(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model"))
    return d.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) x WHERE k <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
)
def op13_rns_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(negatives.relabelled(negatives.prepared(table(spark, sf_dir, "embeddings"))))
