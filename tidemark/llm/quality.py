"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed
rule.  A policy is a versioned mask: applying it, comparing two of them, or asking what a single rule
removes is bit arithmetic over the ledger, and no text is read again.

Rows: a null text has no words, no lines and no symbols; an empty text likewise.  Repeated rows and
ties are judged alike, each row by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rule -> condition of failure over the measurements.  A rule keeps its bit for good; new ones are added at the end.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "2 * n_upper > n_letters",
    "few_distinct_words": "n_words < 400 and 4 * n_distinct_words < n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is rejected when it fails any of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STRICT = Policy("strict", 1, (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words", "shouting", "few_distinct_words"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """Hashes of the 8-word windows in order, by doubling: 1, 2, 4, 8 words."""
    pair = lambda step: lambda h: F.zip_with(
        F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b)
    )
    h = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        h = _let(h, pair(step))
    return h


def _covered(windows: Column) -> Column:
    """Number of words covered by the windows (an array of hashes in order) that are there more than once.

    Sorting (hash, place) puts equal windows side by side; their places, in order, then give the length
    of the union of [place, place + 8)."""

    def marked(placed: Column) -> Column:
        n = F.size(placed)
        before = F.concat(F.slice(placed, 1, 1), F.slice(placed, 1, n - 1))
        after = F.concat(F.slice(placed, 2, n - 1), F.slice(placed, n, 1))
        # the window's place if it equals the one before (not itself: the first) or the one after
        own = F.zip_with(placed, before, lambda x, p: F.struct(x["h"].alias("h"), x["i"].alias("i"), ((x["h"] == p["h"]) & (x["i"] != p["i"])).alias("m")))
        hits = F.zip_with(own, after, lambda x, a: F.when(x["m"] | ((x["h"] == a["h"]) & (x["i"] != a["i"])), x["i"]).otherwise(F.lit(-1)))
        return F.sort_array(F.filter(hits, lambda i: i >= 0))

    def union(places: Column) -> Column:
        following = F.concat(F.slice(places, 2, F.size(places) - 1), F.array(F.lit(2147483000)))
        return F.aggregate(F.zip_with(places, following, lambda i, j: F.least(j - i, F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    # sort_array compares without a lambda, unlike array_sort
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(placed, marked), union)


def _repeat_words(words: Column) -> Column:
    """Only a text whose windows are not all distinct is walked through."""
    return _let(_windows(words), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0)))


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``docs`` with its measurements and ``fail_bits``: one pass over each text, no shuffle."""
    names = ["_words", "_bare", "_lines", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_distinct_words", "fail_bits"]
    d = docs.drop(*names)
    text = F.coalesce(c("text"), F.lit(""))
    d = d.withColumn("_words", F.filter(F.split(text, GAP), lambda w: w != ""))
    d = d.withColumns({"_bare": F.translate(text, " \t\n\x0b\x0c\r", ""), "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")})
    length = lambda x: F.length(x).cast("long")
    bare = c("_bare")
    d = d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": length(bare),
            "n_symbols": length(bare) - length(F.translate(bare, "#*$%&|<>", "")),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(c("_words")).cast("long"),
            "n_letters": length(F.regexp_replace(bare, r"[^\p{L}]", "")),
            "n_upper": length(F.regexp_replace(bare, r"[^\p{Lu}]", "")),
            "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
        }
    ).drop("_words", "_bare", "_lines")
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(rules.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return d.withColumn("fail_bits", total.cast("long"))


def passes(policy: Policy) -> Column:
    return c("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, documents that only this rule rejects (what leaving it
    out would bring back) and the measured words of these; one aggregation of the ledger."""
    failed = c("fail_bits").bitwiseAND(F.lit(policy.mask))
    cells = []
    for r in policy.rules:
        bit = F.lit(BITS[r])
        cells += [
            F.count_if(failed.bitwiseAND(bit) != 0).alias(f"{r}.failed"), F.count_if(failed == bit).alias(f"{r}.alone"),
            F.coalesce(F.sum(F.when(failed == bit, c("n_words"))), F.lit(0)).alias(f"{r}.words"),
        ]
    one = book.agg(F.count("*").alias("n_docs"), F.count_if(failed != 0).alias("n_rejected"), F.coalesce(F.bit_or(failed), F.lit(0)).alias("rules_hit"), *cells)
    rows = [F.struct(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit"), "n_docs", "n_rejected", "rules_hit", *[c(f"`{r}.{x}`").alias(y) for x, y in (("failed", "n_failed"), ("alone", "n_only_this"), ("words", "words_only_this"))]) for r in policy.rules]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
