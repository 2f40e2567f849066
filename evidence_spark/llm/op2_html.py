"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (what stands between two block-level tags). Each
block is described by its own word count and link density, those of the blocks before and
after it, and by what encloses it: an article container, a page part such as navigation,
footer, form or aside, or a class or id naming one. A decision tree, trained on the small
labelled table below, keeps or drops each block; kept blocks are joined by line breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr br input".split())
PARTS = frozenset("nav footer aside form menu dialog fieldset header".split())
ARTICLE = frozenset("article main".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "a": {"a"}, "body": {"head"}}
# Words that name page parts other than the article in class, id and role.
PART_WORDS = frozenset(
    "ad ads advert advertisement advertorial adslot banner billboard breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus feedback footer footnav form gdpr header hidden login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags teaser toolbar topbar complementary contentinfo widget".split())
ARTICLE_WORDS = frozenset("article articlebody body-text content entry entry-content maincontent main post post-body post-content story storybody text".split())

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_part", "in_article")


class BlockParser(HTMLParser):
    """Text blocks of one page with the cues of what encloses them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag; inside a silent element, a page part, an article
        self.blocks: list[tuple[str, int, int, bool, bool]] = []
        self.text: list[str] = []
        self.linked: list[str] = []
        self.links = 0

    def _state(self) -> tuple[bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False)

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, part, article = self._state()
                self.blocks.append((text, len(text.split()), len("".join(self.linked).split()), part, article))
        self.text.clear()
        self.linked.clear()

    def _close_until(self, at: int) -> None:
        for tag, *_ in self.open[at:]:
            if tag == "a":
                self.links -= 1
        del self.open[at:]

    def _last(self, tags, stop) -> int:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in stop:
                break
        return -1

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
            return
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P and (k := self._last(("p",), ("div", "section", "article", "td", "body", "li", "blockquote"))) >= 0:
            self._close_until(k)
        if tag in SAME_ENDS and (k := self._last(SAME_ENDS[tag], ("ul", "ol", "table", "dl", "menu"))) >= 0:
            self._close_until(k)
        silent, part, article = self._state()
        here = dict(attrs)
        names = set()
        for key in ("class", "id", "role"):
            if value := here.get(key):
                low = value.lower()
                names.update(low.split(), re.split(r"[^a-z]+", low))
        hidden = "hidden" in here or here.get("aria-hidden") == "true" or "display:none" in (here.get("style") or "").replace(" ", "").lower()
        if tag in ARTICLE or (names & ARTICLE_WORDS and not names & PART_WORDS):
            article = True
        # a header inside an article holds its title
        if (tag in PARTS and not (tag == "header" and article)) or (names & PART_WORDS and tag not in ("html", "body")):
            part = True
        if tag == "a":
            self.links += 1
        self.open.append((tag, silent or hidden or tag in SILENT, part, article))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._flush()
        if (k := self._last((tag,), ())) >= 0:
            self._close_until(k)

    def handle_data(self, data):
        if not self._state()[0]:
            self.text.append(data)
            if self.links > 0:
                self.linked.append(data)


def text_blocks(html: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, linked words, in a page part, in an article) of every block, in page order."""
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.blocks


def block_features(blocks: list[tuple]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the ends a block has no words. in_article is 1
    inside an article container, 0 outside it, and 1/2 on a page without one."""
    words = np.array([0, *[b[1] for b in blocks], 0], dtype=float)
    density = np.array([0, *[b[2] / b[1] for b in blocks], 0], dtype=float)
    cues = np.array([b[3:5] for b in blocks], dtype=float).reshape(-1, 2)
    if not cues[:, 1].any():
        cues[:, 1] = 0.5
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], cues])


_LONG = "The river rose again over night and the lower fields stood under water until noon, when the wind turned at last. "
_MID = "She closed the book and looked out at the harbour. "
_LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">About us</a></li></ul>'

#: The small labelled table: pages, and for each of their blocks 1 (article) or 0.
LABELLED = (
    (f"<nav>{_LINKS}</nav><article><h1>Floods</h1><p>{_LONG}</p><p>{_LONG * 2}</p></article><footer>(c) Example press</footer>", "0001110"),
    (f"<div class=ad>{_LONG}</div><article><h1>A long day at the market</h1><p>{_MID}</p><p>{_LONG * 3}</p><p>Yes.</p></article>", "01111"),
    (f"<header><p>The Daily Page</p>{_LINKS}</header><main><h1>Title</h1><p>{_LONG * 2}</p></main><aside><p>{_LONG}</p></aside>", "0000110"),
    (f"<div><a href=/>Start</a> <a href=/x>Archive</a></div><div><h2>Notes on rain</h2><p>{_LONG * 2}</p><p>{_LONG}</p></div><div>All rights reserved</div>", "01110"),
    (f"<div id=content><p>{_LONG}</p><div class=advert>{_MID}</div><p>{_LONG * 2}</p></div><div class=comments><p>{_LONG}</p><p>{_MID}</p></div>", "10100"),
    (f"<article><header><h1>Bread</h1></header><p>{_LONG}</p><ul><li>Flour</li><li>Water and salt</li></ul><p>{_MID}</p></article><div class=related>{_LINKS}</div>", "11111000"),
    (f"<div class=cookie-notice><p>{_LONG}</p><p>Accept all</p></div><article><p>{_LONG * 2}</p><aside>{_MID}</aside><p>{_LONG}</p></article>", "00101"),
    (f"<article><h1>Short</h1><p>{_MID}</p><p>{_MID}</p></article><section class=comments><h3>3 comments</h3><p>{_LONG * 2}</p></section><footer><p>{_LONG}</p></footer>", "111000"),
    (f"<form><p>{_MID}</p><label>Your name</label></form><article><p>{_LONG}</p><form><p>{_LONG}</p></form></article>", "0010"),
    (f"<div class=sidebar><h3>Popular</h3><p>{_LONG}</p></div><div class=post><h1>Tides</h1><p>{_LONG}</p><blockquote>{_MID}</blockquote></div>", "00111"),
    (f"<table><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr></table><p>{_LONG * 2}</p><p>{_LONG * 2}</p><p><a href=3>Next page</a></p>", "00110"),
    (f"<article><p>{_LONG}<a href=x>a source</a></p><p><a href=y>{_MID}</a></p><div class=share><a href=t>Share</a></div></article><p>Contact</p>", "1100"),
    (f"<article><h1>One</h1><p>Two words.</p></article><footer>{_LONG * 2}</footer><div class=newsletter><p>{_LONG}</p></div>", "1100"),
    (f"<p>Welcome</p><article><h1>Rain</h1><p>Yes.</p><p>No.</p><p>Rain again.</p><p>{_LONG}</p><p>So.</p></article><p>{_LONG * 2}</p>", "01111110"),
    (f"<article><p><a href=1>Part one</a></p><p>Then.</p><p><a href=2>Part two</a></p></article><p><a href=3>Next</a></p><p>Top</p>", "11100"),
    (f"<p>{_MID}</p><article><h2><a href=1>Linked title of a piece</a></h2><p>Two.</p><p>{_MID}</p></article><div>{_LONG * 3}</div>", "01110"),
    (f"<article><p>{_LONG * 2}</p></article><div class=ad><a href=1>{_MID}</a></div><p>{_MID}</p><article><p>End.</p></article><p>{_LONG}</p>", "10010"),
    (f"<div><a href=1>Read more about the northern harbours</a></div><h1>Harbours of the north</h1><p>{_LONG}</p><p>{_LONG * 2}</p><div><a href=2>Back to the list of all towns</a></div>", "01110"),
    (f"<p>{_LONG * 2}</p><p>{_MID}</p><p>{_LONG}</p>", "111"),
    (f"<div><a href=1>Stories from the coast and islands</a> <a href=2>Letters</a></div><p>{_LONG}</p>", "01"),
    (f"<ul><li><a href=1>Latest stories from the region</a></li><li><a href=2>Opinion and letters to the editor</a></li></ul><p>{_LONG * 3}</p><p>{_LONG}</p>", "0011"),
    (f"<p>{_LONG}<a href=1>a note</a> {_MID}</p><p>{_LONG * 2}</p><div><a href=1>Older posts from this week</a> <a href=2>Newer posts</a></div>", "110"),
    (f"<p><a href=1>Sign in</a></p><p>{_LONG * 2}</p><p>{_LONG * 3}</p><p>{_LONG}</p><p>Imprint</p><p><a href=2>Privacy</a></p>", "011100"),
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled table."""
    x, y = [], []
    for html, marks in LABELLED:
        blocks = text_blocks(html)
        if len(blocks) != len(marks):
            raise ValueError(f"{len(blocks)} blocks, {len(marks)} labels: {html[:60]}")
        x.append(block_features(blocks))
        y.extend(int(c) for c in marks)
    return np.concatenate(x), np.array(y)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 5):
    """Gini decision tree: a leaf is its share of label 1, a node (feature, bound, low side, high side)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= bound
            cost = sum(part.sum() * (q := y[part].mean()) * (1 - q) for part in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(bound), low)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, bound, low = best
    return f, bound, fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1)


def tree_scores(tree, x: np.ndarray) -> np.ndarray:
    """Share of label 1 of the leaf that each row reaches."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, low, high = tree
    return np.where(x[:, f] <= bound, tree_scores(low, x), tree_scores(high, x))


def main_text(html: str, tree) -> str:
    """Blocks that the tree keeps, joined by line breaks."""
    blocks = text_blocks(html)
    if not blocks:
        return ""
    keep = tree_scores(tree, block_features(blocks)) >= 0.5
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = 5) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points). Null, empty and blockless pages
    have the empty text. Equal rows give equal rows; other columns are not carried."""
    tree = fit_tree(*labelled_blocks(), depth=depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h, tree) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(
        run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
