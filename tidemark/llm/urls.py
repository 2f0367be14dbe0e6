"""URL filter: host and path rules first, then trust and distrust along the links between hosts.

A url that a rule fits gets the longest rule's verdict.  For the others their host decides: trust starts
at hosts whose pages rules mostly allow and flows along links (personalised PageRank); distrust starts
at hosts whose pages rules mostly block and flows against them, to whoever links there.  A host is
blocked where distrust is above its trust and at least ``least``, or at least ``least`` of what its links
would bring if all of them led to blocked hosts: a blocked host's distrust is divided among those that
link to it, so the mass itself says little about a host.  A host that neither reaches is allowed.

The graph is one row per pair of hosts, counted with a map-side part, so a host with a third of all
pages is at most one edge per host it names.  Each round joins scores to edges and sums them per host;
rounds are written to the shared folder, and end early when nothing changes any more.

Rows: a url that is null or has no ``://`` has an empty host and path, which no rule fits and no link
reaches: allowed.  A null or empty html has no links.  Repeated rows count again in a host's share, but
links count once per pair of hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.stage import stage

c = F.col
#: (rule, allowed); a rule is a host and the beginning of a path.
RULES = (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))
DAMPING, ROUNDS, LEAST, SHARE = 0.85, 20, 0.05, 0.5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hosts in href attributes with a scheme or a leading //.
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, rest = rule.partition("/")
    return host, slash + rest


def matched(rules=RULES) -> Column:
    """The longest fitting rule of ``host`` and ``path`` as a struct (rule, allowed), or null."""
    out = None
    for rule, allowed in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, path = _split(rule)
        fits = ((c("host") == host) | c("host").endswith("." + host)) & c("path").startswith(path)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(allowed).alias("allowed"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``: one row per pair of different hosts with a link."""
    d = pages.where(c("html").contains("//")).select(host_of(c("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("dst"))
    return d.select("src", F.translate("dst", UPPER, UPPER.lower()).alias("dst")).where("src != dst and src != '' and dst != ''").distinct()


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """``host``, ``score``: personalised PageRank from ``seeds`` (``host``, ``seed``) along ``src`` -> ``dst``."""
    out = edges.join(edges.groupBy("src").agg(F.count("*").alias("n")), "src").select("src", "dst", (1.0 / c("n")).alias("w"))
    out = stage(out, "links")
    base = stage(seeds.select("host", ((1 - damping) * c("seed")).alias("score")), "seeds")
    now = base
    for _ in range(rounds):
        flow = out.join(now, out["src"] == now["host"]).select(c("dst").alias("host"), (damping * c("score") * c("w")).alias("score"))
        new = stage(flow.union(base).groupBy("host").agg(F.sum("score").alias("score")), "round")
        changed = new.alias("x").join(now.alias("y"), "host", "left").where("y.score is null or x.score != y.score")
        if changed.isEmpty():
            break
        now = new
    return now


def host_scores(judged: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, share: float = SHARE) -> DataFrame:
    """``host``, ``trust``, ``distrust`` and ``reach`` (distrust in one step if all hosts it links to were blocked) of every
    host a seed reaches; ``judged`` has ``host`` and ``allowed``
    (null where no rule fits) per page."""
    n = judged.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if("allowed").alias("good"), F.count_if(~c("allowed")).alias("bad"))
    n = stage(n, "hosts")
    seed = lambda which, other: n.where((c(which) >= share * c("n")) & (c(which) > c(other))).select("host", F.lit(1.0).alias("seed"))
    trust = propagated(edges, seed("good", "bad"), rounds, damping)
    back = edges.select(c("dst").alias("src"), c("src").alias("dst"))
    distrust = propagated(back, seed("bad", "good"), rounds, damping)
    both = trust.select("host", c("score").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "score"))
    both = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    linkers = edges.groupBy("dst").agg(F.count("*").alias("n"))
    reach = edges.join(linkers, "dst").groupBy(c("src").alias("host")).agg(F.sum(damping * (1 - damping) / c("n")).alias("reach"))
    return both.join(reach, "host", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))


def filter_urls(pages: DataFrame, rules=RULES, least: float = LEAST, rounds: int = ROUNDS, damping: float = DAMPING, share: float = SHARE) -> DataFrame:
    """``page_id``, ``url``, ``html`` -> ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``."""
    d = pages.select("page_id", host_of(c("url")).alias("host"), path_of(c("url")).alias("path"))
    d = d.withColumn("_m", matched(rules)).select("page_id", "host", "path", c("_m.rule").alias("rule"), c("_m.allowed").alias("allowed"))
    edges = stage(host_edges(pages), "host-edges")
    scores = stage(host_scores(d, edges, rounds, damping, share), "host-scores")
    out = d.join(scores, "host", "left")
    much = (c("distrust") >= least) | ((c("reach") > 0) & (c("distrust") >= least * c("reach")))
    blocked = F.coalesce(much & (c("distrust") > c("trust")), F.lit(False))
    verdict = F.when(F.coalesce("allowed", ~blocked), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
