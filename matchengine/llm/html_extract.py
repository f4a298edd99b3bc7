"""Main text of web pages by tag-path ratios.

Every text node has the path of tags from the root to it. A page's nodes are summed by path: text and punctuation for
each node; the sums are smoothed along the page and fused, and nodes whose fused ratio is high enough are content.
Elements that never hold an article's text (menus, footers, scripts and the like, by tag) and hidden ones are out
beforehand. All else is weighed, on every page: an <article> or <main> that holds much of the page's text raises the
ratios of paragraphs, headings, list items and cells in it, and a class, id or role that speaks of clutter, or a form, lowers those below it, unless the element holds
most of the page's text or of that article's. Blocks that are mostly links go.

Defined cases: a null or blank page, and one of markup alone, gives an empty text; unclosed and misnested tags are
closed as browsers close them, <head> by the first tag or text that cannot be in it; repeated rows give the same; an
empty table gives no rows; other columns are kept by extracted().
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Tag names and class words.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside button select option textarea input iframe object svg math canvas audio video map dialog menu".split()
)
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent notice notices newsletter subscribe subscription share sharing social comment comments commentlist disqus reply replies respond responses related "
    "recommended popup modal overlay widget login signup search pagination pager toolbar skip".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th".split())
LEAST = 0.25  # of the mean ratio
MARKED = 3.0  # factor of PROSE in the page's article, if that has SHARE of its text
SIGNED = 0.15  # factor below a sign of clutter
SHARE = 0.4
MOST = 0.5  # of the text: a sign on what holds more says nothing
APART = 0.1
LINKS = 0.6  # share of a block's text in links
SENTENCE = re.compile(r"(?:\S+\s+){4,}\S+[.!?…。！？][\"'»”)]*$")  # five words and more, with a full stop
LEADING = frozenset("h1 h2 h3 h4 h5 h6 summary caption dt".split())  # names of what comes behind
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؛،]")
WORDS = re.compile(r"[a-z]+")


class _Open(NamedTuple):
    """An open element; what it says of everything below it is carried along, so that depth costs nothing."""

    tag: str
    path: int  # the number of its path of tags
    out: bool  # out of bounds from here on
    article: int  # outermost article's number or 0
    sign: int  # number of the innermost element with a sign, or 0
    link: bool
    heading: bool
    header: bool
    body: bool  # in an article or main
    prose: bool
    leading: bool
    row: int  # number of the table row


_TOP = _Open("", 0, False, 0, 0, False, False, False, False, False, False, 0)


class _Page(HTMLParser):
    """nodes: [path's number, text, block, outermost article, innermost sign, in a link, in prose, leading, table row];
    out-of-bounds text is not kept. Articles (and mains) and elements with signs are numbered in order; ``above`` has each
    sign's next one up, ``weak`` the signs on paragraphs and the like."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.open: Counter[str] = Counter()  # open elements by tag
        self.above: dict[int, int] = {}
        self.weak: set[int] = set()
        self.nodes: list[list] = []
        self.block = 0
        self.elements = 0

    def _push(self, tag: str, out: bool, sign: bool) -> None:
        self.elements += 1
        up = self.stack[-1] if self.stack else _TOP
        article = self.elements if not up.article and not sign and tag in ("article", "main") else up.article
        if sign:
            self.above[self.elements] = up.sign
            if tag in PROSE:
                self.weak.add(self.elements)
        self.stack.append(
            _Open(
                tag, self.paths.setdefault((up.path, tag), len(self.paths) + 1), out or up.out, article, self.elements if sign else up.sign,
                up.link or tag == "a", up.heading or tag in HEADINGS, up.header or tag == "header", up.body or tag in ("article", "main"), up.prose or tag in PROSE,
                up.leading or tag in LEADING, self.elements if tag == "tr" else up.row,
            )
        )
        self.open[tag] += 1

    def _pop_to(self, at: int) -> None:
        if any(t.tag not in INLINE for t in self.stack[at:]):
            self.block += 1
        self.open.subtract(t.tag for t in self.stack[at:])
        del self.stack[at:]

    def _end_head(self) -> None:
        if self.open["head"]:
            self._pop_to(max(i for i, t in enumerate(self.stack) if t.tag == "head"))

    def _judge(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Whether the element is out of bounds, and whether it has a sign of clutter."""
        if tag in NEVER:
            return True, False
        got = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
            return True, False
        if tag in ("html", "body", "main") or tag in HEADINGS:
            return False, False
        signs = SIGNS.intersection(WORDS.findall(f"{got.get('class', '')} {got.get('id', '')}"))
        if tag == "article":
            return False, bool(signs & {"comment", "comments", "reply"})
        return False, tag == "form" or bool(signs) or got.get("role") in ROLES

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and tag != "head" and self.stack and (self.stack[-1].tag == "head" or tag == "body"):
            self._end_head()
        if tag in ENDS_P and self.open["p"]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag == "p":
                    self._pop_to(i)
                    break
                if self.stack[i].tag not in INLINE:
                    break
        if any(self.open[t] for t in CLOSES.get(tag, ())):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in CLOSES[tag]:
                    self._pop_to(i)
                    break
                if self.stack[i].tag in SCOPES[tag]:
                    break
        if tag == "br":
            self.handle_data(" ")
        elif tag not in INLINE:
            self.block += 1
        if tag not in VOID:
            self._push(tag, *self._judge(tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return
        if tag in ("p", "br"):
            self.block += 1

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and data.strip():
            self._end_head()
        up = self.stack[-1] if self.stack else _TOP
        if not up.out and (not up.header or up.heading and up.body):
            self.nodes.append([up.path, data, self.block, up.article, up.sign, up.link, up.prose, up.leading, up.row])


def ratios(nodes: list[list]) -> list[float]:
    """A fused ratio for each node: text a node and punctuation a node of its path, smoothed over neighbours."""
    text, marks, many = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, data, *_ in nodes:
        size = len("".join(data.split()))
        if size:
            text[path] += size
            marks[path] += len(PUNCTUATION.findall(data))
            many[path] += 1
    of = {p: (math.log1p(text[p] / many[p]), math.log1p(marks[p] / many[p])) for p in many}
    own = [of.get(n[0], (0.0, 0.0)) for n in nodes]
    weights = (0.25, 1.0, 0.25)
    out = []
    for i in range(len(own)):
        near = [(w, own[j]) for w, j in zip(weights, (i - 1, i, i + 1), strict=True) if 0 <= j < len(own)]
        whole = sum(w for w, _ in near)
        t, p = (sum(w * x[k] for w, x in near) / whole for k in (0, 1))
        out.append(t * (0.5 + p))
    return out


def main_text(html: str | None) -> str:
    """The blocks of content nodes in page order, white space in and between them as single blanks."""
    page = _Page()
    page.feed(html or "")
    page.close()
    nodes = page.nodes
    sizes = [len("".join(n[1].split())) for n in nodes]
    whole = sum(sizes)
    by_article, by_sign, both = defaultdict(int), defaultdict(int), defaultdict(int)
    for n, size in zip(nodes, sizes, strict=True):
        by_article[n[3]] += size
    article = max((a for a in by_article if a), key=by_article.__getitem__, default=0)
    for n, size in zip(nodes, sizes, strict=True):
        by_sign[n[4]] += size
        both[n[4]] += size * (n[3] == article != 0)
    for e in sorted(page.above, reverse=True):  # inner ones first: an element's text is also that of those around it
        by_sign[page.above[e]] += by_sign[e]
        both[page.above[e]] += both[e]

    paragraphs: dict[int, list[list]] = {e: [] for e in page.weak}
    plain = Counter(n[0] for n, size in zip(nodes, sizes, strict=True) if size and n[4] not in page.weak)
    for n in nodes:
        if n[4] in paragraphs:
            paragraphs[n[4]].append(n)

    def prose(e: int) -> bool:
        """Whether a paragraph with a sign is a sentence in the article, or among paragraphs on its path that have none."""
        own = paragraphs[e]
        here = article and both[e] == by_sign[e] or min((plain[n[0]] for n in own if n[1].strip()), default=0) > 1
        return bool(here) and SENTENCE.search(" ".join("".join(n[1] for n in own).split())) is not None

    def cluttered(e: int) -> bool:
        if e in page.weak and prose(e):
            return False
        if by_sign[e] > MOST * whole:  # a wrapper, unless an article has its text elsewhere, as above long comments
            return article != 0 and by_article[article] - both[e] >= max(SHARE * (whole - by_sign[e]), APART * whole)
        return by_article[article] < SHARE * whole or both[e] <= MOST * by_article[article]

    clutter = {0: False}  # whether an element with a sign, or one around it, is clutter
    for e in sorted(page.above):
        clutter[e] = clutter[page.above[e]] or cluttered(e)
    if by_article[article] < SHARE * sum(s for n, s in zip(nodes, sizes, strict=True) if not clutter[n[4]]):
        article = 0
    fused = ratios(nodes)
    least = LEAST * sum(s * f for s, f in zip(sizes, fused, strict=True)) / whole if whole else 0.0
    best: dict[int, float] = defaultdict(float)
    links, total = defaultdict(int), defaultdict(int)
    for n, size, f in zip(nodes, sizes, fused, strict=True):
        f *= SIGNED if clutter[n[4]] else MARKED if article and n[3] == article and n[6] else 1.0
        if size:
            best[n[2]] = max(best[n[2]], f)
        total[n[2]] += size
        links[n[2]] += size * n[5]
    text: dict[int, list[str]] = defaultdict(list)
    names, rows, clean = set(), {}, set()
    for n in nodes:
        text[n[2]].append(n[1])
        if n[7]:
            names.add(n[2])
        if n[8]:
            rows[n[2]] = n[8]
        if not clutter[n[4]]:
            clean.add(n[2])
    order = [b for b in text if total[b]]

    def linked(b: int) -> bool:
        """Mostly links, and not a sentence that goes on outside them."""
        return links[b] > LINKS * total[b] and not (links[b] < total[b] and b in clean and SENTENCE.search(" ".join("".join(text[b]).split())))

    kept = {b for b in order if best[b] >= least and not linked(b)}
    full = {rows[b] for b in kept if b in rows}  # a row's cells stay together
    kept |= {b for b in order if rows.get(b) in full and b in clean and not linked(b)}
    for b, after in zip(reversed(order[:-1]), reversed(order[1:]), strict=True):  # and a name with what it names
        if b in names and b in clean and after in kept and not linked(b):
            kept.add(b)
    blocks = {b: text[b] for b in order if b in kept}
    return " ".join(t for t in (" ".join("".join(x).split()) for x in blocks.values()) if t)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' other columns, text and n_chars."""
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.select(*names, html).mapInArrow(run, f"{fields}{', ' if names else ''}text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    """The contract's row for every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
