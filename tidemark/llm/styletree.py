"""Main text of pages by site style trees.

The element trees of a host's pages are merged: a style node is an element type under a chain of
element types.  Its presentation importance is the entropy of the child styles seen under it, its
content importance is one minus the mean entropy of its text features over the pages (a text on every
page tells nothing, a text on one page everything), both to the base of the pages that have the node
(Yi, Liu and Li 2003).  With l child styles they are mixed as (1 - g^l) presentation + g^l content;
branches below ``threshold`` go from each page of the host.

Elements whose declared role is no content (navigation, headers, forms, ...) have importance 0 from the
start, which also serves hosts with too few pages for entropies; where a page has an article or main
element, what stands outside of it has importance 0 as well.  A class or id declares it only where the
element does not hold the page's main, most of its text, or an article with more text than stands free
of such elements: wrappers of a page are often named after the parts it has.

Pages of a host with the same body, their ``BODY`` longest blocks, are copies (repeated rows, session
ids, print views, other dates or counters): together they weigh as one page in both entropies, and each
gets the verdicts of that tree.  An importance is shrunk towards 1 by the number of pages m behind it,
(prior + m * importance) / (prior + m), so a node that few pages have needs more evidence and no host is
left out for its size.

What a page loses is its lesser part: where low branches hold most of its body, the tree has taken
copies of an article for boilerplate, and the page keeps all.  Headings, column and row labels, terms and
captions repeat on pages of one kind although they belong to what follows; such a block of a low branch
goes only if the next block that is no label goes as well, or if none follows.

Each page is parsed once; its blocks are written, and entropies and texts are taken from there.  The
low nodes of a host are written too, so Spark knows their size when it chooses the join.

Rows: a null or empty html gives an empty text; a null url is the host ''.  Broken markup is read as far as it goes: unclosed elements end with the page.
Repeated rows are copies and keep a row each; other columns of the pages are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.urls import host_of
from tidemark.stage import stage

c = F.col
THRESHOLD, PRIOR, GAMMA, SALTS, BODY = 0.25, 2.0, 0.9, 16, 3

# Element names of HTML by what they do to a page's text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
NO_CONTENT = set("script style noscript template head title textarea iframe object canvas svg nav header footer aside menu form fieldset button select option datalist dialog".split())
NO_CONTENT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id attributes that name what is not the article.
NO_CONTENT_WORDS = set(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side aside header masthead topbar footer copyright share sharing social "
    "related recommended recommendations comment comments commentlist respond reply replies disqus form search searchbox widget widgets toolbar skip hidden".split()
)
#: Those of them that name texts by others: most of a page's text does not make these its content.
OTHERS_WORDS = set("cookie cookies consent gdpr related recommended recommendations comment comments commentlist respond reply replies disqus".split())
#: What follows one of these in a class says what a page has or lacks.
STATE_WORDS = set("no not has have with without".split())
ARTICLE = {"article", "main"}
#: Elements that name what follows them.
LABELS = set("h1 h2 h3 h4 h5 h6 th dt caption figcaption summary legend".split())
#: Opening one of these ends an open element of the given names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CASE = re.compile(r"([a-z])([A-Z])")


def _number(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _attributes(tag: str, text: str) -> tuple[str, bool, set[str]]:
    """The part of an element's style that class and id give, whether role or own words rule out content, and
    the words of class and id that name no content."""
    style, out, named = [], False, set()
    for name, *values in _ATTRIBUTE.findall(text):
        value = next((v for v in values if v), "")
        value = _CASE.sub(r"\1-\2", value).lower()
        words = _WORD.findall(value)
        if name.lower() == "role":
            out |= any(w in NO_CONTENT_ROLES for w in words)
        elif tag not in ("html", "body") and tag not in ARTICLE:
            if not NO_CONTENT_WORDS.isdisjoint(words):
                named |= {w for token in value.split() for w in takewhile(lambda x: x not in STATE_WORDS, _WORD.findall(token))} & NO_CONTENT_WORDS
        elif tag == "article":
            out |= any(w in ("comment", "comments", "reply", "ad", "advert", "advertisement", "related", "recommended") for w in words)
        style += words
    return " ".join(sorted(style)), out, named


class Page:
    """``blocks``: (style node, text) of the page's blocks outside of elements without content, in order, and
    ``labels``, whether each is a label; ``children``: style node -> styles of its child elements."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[int, str]] = []
        self.labels: list[bool] = []
        self.children: dict[int, set[str]] = {}
        # (style node, text, inside an article, named elements around it, label) and (style node, child style, named elements)
        self._found: list[tuple[int, str, bool, tuple[int, ...], bool]] = []
        self._styles: list[tuple[int, str | None, tuple[int, ...]]] = []
        # of each element whose class or id names no content: whether the words name texts by others; those with a main
        self._named: list[bool] = []
        self._mains: set[int] = set()
        self._parts: list[str] = []
        # (name, style node, ruled out, inside an article, named elements from the top down to it)
        self._stack: list[tuple[str, int, bool, bool, tuple[int, ...]]] = [("", 0, False, False, ())]
        self._open: dict[str, int] = {}
        if html:
            self._read(html)
        self._judge()

    def _judge(self) -> None:
        """Blocks and children that no named element rules out; of the blocks those inside an article, if any."""
        gone = set()
        if self._named:
            size, held, articles = 0, [0] * len(self._named), [0] * len(self._named)
            free = {False: 0, True: 0}
            for _node, text, inside, named, _label in self._found:
                size += len(text)
                for i in named:
                    held[i] += len(text)
                    articles[i] += len(text) * inside
                if not named:
                    free[inside] += len(text)
            clear = free[True] or free[False]
            for i, others in enumerate(self._named):
                most = not others and (2 * held[i] > size or articles[i] > clear)
                if not (most or i in self._mains or (clear == 0 and articles[i])):
                    gone.add(i)
        found = [x for x in self._found if gone.isdisjoint(x[3])]
        inside = any(x[2] for x in found)
        found = [x for x in found if x[2] or not inside]
        self.blocks = [(x[0], x[1]) for x in found]
        self.labels = [x[4] for x in found]
        for node, style, named in self._styles:
            if gone.isdisjoint(named):
                own = self.children.setdefault(node, set())
                if style is not None:
                    own.add(style)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = _TAG.search(html, at)
            self._parts.append(html[at : m.start() if m else len(html)])
            if m is None:
                break
            at = m.end()
            close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if m[0].startswith("<![CDATA[") and not name:
                self._parts.append(entities.escape(m[0][9:-3]))
            if not name:
                continue
            name = name.lower()
            if close:
                self._end(name)
            else:
                self._start(name, rest)
                if name in RAW and not rest.endswith("/"):
                    end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                    at = end.start() if end else len(html)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            name, node, out, inside, named = self._stack[-1]
            if not out:
                text = " ".join(entities.unescape("".join(self._parts)).split())
                if text:
                    self._found.append((node, text, inside, named, name in LABELS))
                    self._styles.append((node, None, named))
            self._parts = []

    def _start(self, name: str, rest: str) -> None:
        if name == "br" or name == "wbr":
            self._parts.append(" " if name == "br" else "")
            return
        style, out, words = _attributes(name, rest) if rest else ("", False, ())
        out |= name in NO_CONTENT
        if name in INLINE and not out and not words:
            return
        self._flush()
        if name in VOID:
            return
        if name in ENDS:
            self._end_any(ENDS[name], HOLDS[name])
        if self._open.get("p"):  # a block ends an open paragraph
            self._end_any({"p"}, {"article", "main", "body", "div", "section", "td", "th", "li", "blockquote", "button"})
        _n, node, above, inside, named = self._stack[-1]
        if name == "main" and not above and not out:
            self._mains.update(named)
        if words and not above and not out:
            named += (len(self._named),)
            self._named.append(not OTHERS_WORDS.isdisjoint(words))
        if not above and not out:
            self._styles.append((node, f"{name}.{style}", named))
        node = 0 if above or out else _number(node, name, style)
        self._stack.append((name, node, above or out, inside or name in ARTICLE, named))
        self._open[name] = self._open.get(name, 0) + 1

    def _pop(self) -> str:
        name = self._stack.pop()[0]
        self._open[name] -= 1
        return name

    def _end(self, name: str) -> None:
        if not self._open.get(name):
            if name not in INLINE:
                self._flush()
            return
        self._flush()
        while self._pop() != name:
            pass

    def _end_any(self, names: set[str], holders: set[str]) -> None:
        """Ends the nearest open element of these names, unless it is outside of the nearest holder."""
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in holders:
                return


def body(texts: list[str]) -> list[str]:
    """The longest different texts, longest first, equal lengths in order of code points."""
    return sorted(set(texts), key=lambda x: (-len(x), x))[:BODY]


def kept(blocks: list[tuple[int, str]], labels: list[bool], low: set[int]) -> list[str]:
    """Texts of the blocks that stay where the nodes ``low`` are found to be of low importance."""
    texts = [text for _, text in blocks]
    if low.isdisjoint(node for node, _ in blocks):
        return texts
    stay = {text for node, text in blocks if node not in low}
    most = body(texts)
    if 2 * sum(len(x) for x in most if x not in stay) > sum(len(x) for x in most):
        return texts
    out, follows = [], False
    for (node, text), label in zip(reversed(blocks), reversed(labels)):
        high = node not in low
        if not label:
            follows = high
        if high or (label and follows):
            out.append(text)
    return out[::-1]


_NODE = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string()), ("label", pa.bool_())]))
_STYLE = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("leaf", pa.bool_())]))
_PARSED = "host string, copy long, blocks array<struct<node long, text string, label boolean>>, styles array<struct<node long, style long, leaf boolean>>"


def _parsed(batches):
    for batch in batches:
        copies, blocks, styles = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            copies.append(_number(host, body([text for _, text in page.blocks])))
            blocks.append([{"node": n, "text": t, "label": label} for (n, t), label in zip(page.blocks, page.labels)])
            styles.append([{"node": n, "style": _number(sorted(s)), "leaf": not s} for n, s in page.children.items()])
        own = [x for x in ("page_id", "url") if x in batch.schema.names]
        columns = [batch.column(x) for x in own] + [batch.column("host"), pa.array(copies, pa.int64()), pa.array(blocks, _NODE), pa.array(styles, _STYLE)]
        yield pa.RecordBatch.from_arrays(columns, names=[*own, "host", "copy", "blocks", "styles"])


def _texts(batches):
    for batch in batches:
        out = []
        for blocks, low in zip(batch.column("blocks").to_pylist(), batch.column("low").to_pylist()):
            out.append("\n".join(kept([(b["node"], b["text"]) for b in blocks], [b["label"] for b in blocks], set(low or ()))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def _importance(parsed: DataFrame, gamma: float) -> DataFrame:
    # written, so that its size is known before the join
    several = stage(parsed.groupBy("copy").agg(F.count("*").alias("n_copies")).where("n_copies > 1"), "page-copies")
    # one exploded form for both kinds of evidence
    texts = F.array_distinct(F.transform("blocks", lambda x: F.struct(x["node"].alias("node"), F.xxhash64(x["text"]).alias("what"), F.lit(True).alias("text"), F.lit(False).alias("leaf"))))
    styles = F.transform("styles", lambda x: F.struct(x["node"].alias("node"), x["style"].alias("what"), F.lit(False).alias("text"), x["leaf"].alias("leaf")))
    d = parsed.select("host", "copy", F.concat(texts, styles).alias("kinds")).join(several, "copy", "left")
    n = d.select("host", (1.0 / F.coalesce("n_copies", F.lit(1))).alias("w"), F.explode("kinds").alias("e")).groupBy("host", "e.node", "e.what", "e.text", "e.leaf")
    # rounded, so that the shares of copies add up to whole pages in any order
    n = n.agg(F.round(F.sum("w"), 6).alias("n")).where("n > 0")
    n = n.withColumn("nlog", c("n") * F.ln("n"))
    style = ~c("text")
    total = F.round(F.sum(F.when(style, c("n"))), 5)
    g = n.groupBy("host", "node").agg(
        total.alias("pages"), F.sum(F.when(style, c("nlog"))).alias("_s"), F.count_if(style & ~c("leaf")).alias("_l"), F.avg(F.when(c("text"), F.greatest(F.ln("n"), F.lit(0.0)))).alias("_f"),
    )
    base = F.ln("pages")
    # sum of -p ln p over styles is ln m - sum(n ln n) / m
    presentation = F.when(c("pages") > 1, (base - c("_s") / c("pages")) / base).otherwise(1.0)
    content = F.when(c("pages") > 1, 1 - F.coalesce("_f", F.lit(0.0)) / base).otherwise(1.0)
    g = g.select("host", "node", "pages", presentation.alias("presentation"), content.alias("content"), F.pow(F.lit(gamma), c("_l")).alias("_g"))
    return g.withColumn("importance", (1 - c("_g")) * c("presentation") + c("_g") * c("content")).drop("_g")


def _parse(pages: DataFrame, *own) -> DataFrame:
    schema = ("page_id long, url string, " if own else "") + _PARSED
    return pages.select(*own, host_of(c("url")).alias("host"), c("html").cast("string").alias("html")).mapInArrow(_parsed, schema)


def importance(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """``host``, ``node``, ``pages`` (that have the node, copies together one), ``presentation``, ``content``, ``importance``."""
    return _importance(stage(_parse(pages), "page-blocks"), gamma)


def extract(pages: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR, gamma: float = GAMMA) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) -> ``page_id``, ``url``, ``text``, ``n_chars``."""
    parsed = stage(_parse(pages, c("page_id").cast("long").alias("page_id"), c("url").cast("string").alias("url")), "page-blocks")
    low = _importance(parsed, gamma).where((prior + c("pages") * c("importance")) / (prior + c("pages")) < threshold)
    low = stage(low.groupBy("host").agg(F.collect_list("node").alias("low")), "low-nodes")
    low = low.select("host", "low", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("part"))
    d = parsed.select("page_id", "url", "host", "blocks", F.pmod(F.xxhash64("page_id", "url", "copy"), F.lit(SALTS)).cast("int").alias("part"))
    d = d.join(low, ["host", "part"], "left").select("page_id", "url", "blocks", "low")
    return d.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
