"""Main text of HTML pages by flat text blocks and a decision tree.

A page is cut into blocks of text at its block-level tags. A block's features are its words and link density, those of
the blocks before and after it, whether it is a heading or a list item, and what it stands in. A decision tree, trained
on the small table of labelled pages below, tells blocks of the article from all else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import map_texts

#: The labelled table: a page on each line, its blocks in order as words[/words in links][flags][+]. Flags: h heading, l list
#: item, a in an article, b in boilerplate, c in comments; + marks the main text.
LABELLED = """
1/1lb 1/1lb 2/2lb 1/1lb 8b 9ha+ 45a+ 80/4a+ 60a+ 12a+ 5b
2/2lb 2/2lb 1/1lb 3b 5ha+ 4a+ 25a+ 1a+ 120/10a+ 6b 7/4b
1/1b 3/3b 12b 6ha+ 30a+ 20la+ 25/8la+ 18la+ 3ha+ 50a+ 3/3b 2/2b
20b 7ha+ 70a+ 90a+ 4hac 30ac 12ac 2/2ac 65ac 9b
1/1lb 6ha+ 90a+ 40a+ 12c 3/1c 60c 25c 9hc 8c 5b
4ha+ 2a+ 1a+ 1a+ 3a+ 1a+ 2a+ 1a+ 6a+
11ha+ 13a+
2ha+ 55a+ 5/5a+ 48a+ 70/25a+ 31a+
7ha+ 60/20a+ 45/15a+ 3ha+ 4/4la 3/3la 5/5la 2/2la 6b
1/1la 2/2la 1/1la 9ha+ 80a+ 75a+ 4/4a 3/3a 4/4a
1a+
1+
16+
1+ 16+
6h+ 14+
12+ 90+ 70+ 9+
40+ 1+ 55+ 3+ 6+ 80+ 2+
80+ 60/3+ 100+ 33/8+ 45+ 61+
5h+ 60+ 80+ 3h+ 45+ 30+ 7h+ 22+
3+ 1+ 1+ 4+ 2+ 2+ 3+ 1+ 1+ 5+ 1+ 2+
2+ 2+ 2+ 9+ 1+ 12+ 8+ 1+ 15+ 10+ 1+ 11+
1h+ 4+ 1+ 2+ 1+ 3+ 25+
8l+ 12l+ 6l+ 20l+ 9l+ 4l+
4h+ 30+ 7l+ 3l+ 11l+ 2l+ 28+
1/1l 1/1l 2/2l 1/1l 1/1l 8h+ 60+ 75+ 90/6+ 40+
1/1l 2/2l 1/1l 3/3l 45+ 120+ 15+ 33+
2/2 1/1 1/1 2/2 6h+ 50+ 22+ 65+ 4/4 3/3 6/6 5/5
3/3 2/2 2/2 80+ 70+ 30/2+ 3/3l 4/4l 2/2l 8/8l
1/1 1/1 1/1 9h+ 18+ 140+ 12/9l 9/9l 8/8l 11/10l
1/1 4/4 1/1 3 2/2 1/1 60+ 85+ 1/1 3/3 2/2
60+ 4/4 3/3 2/2
1/1 2/2 1/1 80+ 3/3 4/4
7h+ 30+ 2/2 1/1
25+ 6/6
1/1 1/1 3/3l 4h+ 35+ 1+ 60+ 1/1 2/2
1 1/1 1/1 2/2
2 1/1 1/1 50+ 12+ 1 2/2 2/2
90+ 12/12 55+ 9/9 100+
20/12 15/10 12/10 30/17 22/14
3/3 1/1 5/4 6/5 2/2 1/1
2/2lb 2/2lb 3hb 6b 12b 9b 60+ 40+ 90+ 30b 5b
3b 8b 40b 100b 2b 50+ 45+ 20b
70b 50b 90b 6ha+ 30a+ 60a+ 90b
15b 3b 25/20b 40/3b 80+ 8+ 75+ 40b 100/5b
5c 40c 3c 9c 120c 6c
30+ 70+ 3h+ 4hc 50c 40c 6c 90c 15c
9b 30b 2hb 4lb 7lb 16lb
5hab 30ab 80ab 4ha+ 25a+ 60a+ 12ab 3lab 9lab
12a+ 10/10a+ 30a+
9ha+ 15a+ 8/8a+ 22a+ 35a+
14a+ 30a+ 6/6a+ 12a+ 18a+
6ha+ 11a+ 9/9a+ 13a+ 16/14a+ 40a+ 3/3lb 4/4lb
"""

#: Fixed lists of tags and of words in class, id and role.
RAW = "script style noscript template iframe svg math object canvas audio video select textarea button"
HEAD = "base basefont bgsound head link meta noframes noscript script style template title"
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
CONTAINERS = "div section nav header footer aside form article main ul ol dl table figure dialog menu fieldset details body"
BOILERPLATE = "nav footer aside dialog menu"
FORMS = "form fieldset"
#: What a name says if all its other words are plain ones: boilerplate, also beside those of articles; boilerplate; comments; an article.
STRONG_WORDS = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies disclaimer login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar"
WEAK_WORDS = "footer header overlay widget"
COMMENT_WORDS = "comment comments commentlist discussion replies reply respond responses"
GOOD_WORDS = "article articles content entry post posts story maincontent"
PLAIN_WORDS = "area bar block blocks bottom box boxes button buttons col column container desktop fixed form global group holder icon icons id inner item items left links list local main mobile outer page panel primary region right row secondary section site slot small sticky sub text thread title top unit wrap wrapper zone"

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+""")
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in [*RAW.split(), "title"]}
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW, _HEAD, _INLINE, _CONTAINERS, _BOILERPLATE, _FORMS = (frozenset(x.split()) for x in (RAW, HEAD, INLINE, CONTAINERS, BOILERPLATE, FORMS))
_STRONG, _WEAK, _COMMENT, _GOOD, _PLAIN = (frozenset(x.split()) for x in (STRONG_WORDS, WEAK_WORDS, COMMENT_WORDS, GOOD_WORDS, PLAIN_WORDS))
#: Fixed shapes of notices outside of articles that no name marks, in blocks of NOTICE_WORDS at most: they begin with the first or end with the last.
NOTICE = re.compile(r"^(?:©|\(c\)\s|copyright\b\s*(?:©|\(c\)|\d{4}|by\b)|(?:we|this (?:web)?site|our (?:web)?site)(?: and our partners)? uses? cookies\b)|\ball rights reserved\.?$", re.IGNORECASE)
NOTICE_WORDS = 60
#: Words of a block of running text, and blocks of that kind from which on a form is the frame of a page, not a form.
RUNNING_WORDS, FRAME_BLOCKS = 20, 2
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


@lru_cache(1 << 14)
def said_by(name: str) -> str:
    """What a class, id or role says: "boilerplate", "comments", "article" or nothing; a share-price isn't for sharing."""
    parts = {x.lower() for x in _PART.findall(name)}
    if parts & _COMMENT and parts <= _COMMENT | _PLAIN | _GOOD | _STRONG | _WEAK:
        return "comments"
    if (parts & _STRONG and parts <= _STRONG | _WEAK | _PLAIN | _GOOD) or (parts & _WEAK and parts <= _WEAK | _PLAIN):
        return "boilerplate"
    return "article" if parts & _GOOD else ""


@dataclass
class TextBlock:
    text: str
    words: int
    linked: int
    heading: bool = False
    item: bool = False
    article: bool = False
    boilerplate: bool = False
    comments: bool = False
    #: The outermost form that the block is in, from 1; 0 if there is none.
    form: int = 0


@dataclass
class _Page:
    blocks: list[TextBlock] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    #: Open containers: tag, and whether what is in them is in an article, in boilerplate, in comments. How often each is open.
    open: list[tuple[str, bool, bool, bool]] = field(default_factory=list)
    times: dict[str, int] = field(default_factory=dict)
    forms: int = 0
    heading: bool = False
    item: bool = False
    link: bool = False

    def add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.link:
            self.linked += len(text.split())

    def state(self) -> tuple[bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False)

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            text, form = " ".join(words), self.forms if any(self.times.get(x) for x in _FORMS) else 0
            article, boilerplate, comments = self.state()
            boilerplate |= not article and len(words) <= NOTICE_WORDS and bool(NOTICE.search(text))
            self.blocks.append(TextBlock(text, len(words), min(self.linked, len(words)), self.heading, self.item, article, boilerplate, comments, form))
        self.parts, self.linked = [], 0

    def tag(self, close: bool, name: str, attributes: str) -> None:
        if name in _INLINE:
            if name == "a":
                self.link = not close
            elif name == "br":
                self.parts.append(" ")
            return
        self.flush()
        self.link = False
        if name in _HEADINGS:
            self.heading = not close
        elif name == "li":
            self.item = not close
        elif name == "p":
            self.heading = False
        if name not in _CONTAINERS:
            return
        if close:
            while self.times.get(name):  # a tag that isn't open closes nothing
                last = self.open.pop()[0]
                self.times[last] -= 1
                if last == name:
                    break
            return
        if attributes.rstrip().endswith("/"):
            return
        says = {said_by(x) for found in _NAME.finditer(attributes) for x in (found[1] or found[2] or found[3] or "").split()}
        article, boilerplate, comments = self.state()
        bad = name in _BOILERPLATE or "boilerplate" in says or (name == "header" and not article)
        good = name in ("article", "main") or ("article" in says and not bad)
        if good and not comments and not {"comments", "boilerplate"} & says:  # an article inside of boilerplate starts anew
            article, boilerplate = True, False
        boilerplate |= bad and name not in ("body", "main")
        if name in _FORMS and not any(self.times.get(x) for x in _FORMS):
            self.forms += 1
        self.open.append((name, article, boilerplate, comments or ("comments" in says and name != "body")))
        self.times[name] = self.times.get(name, 0) + 1


def _judge_forms(blocks: list[TextBlock]) -> None:
    """Mark the blocks of forms as boilerplate, but for a form that frames the page: it has most of its running text."""
    running = {0: [0, 0]}
    for b in blocks:
        if b.words >= RUNNING_WORDS and 2 * b.linked < b.words and not (b.boilerplate or b.comments):
            own = running.setdefault(b.form, [0, 0])
            own[0], own[1] = own[0] + 1, own[1] + b.words
    whole = sum(n for _, n in running.values())
    for b in blocks:
        if b.form:
            n, words = running.get(b.form, (0, 0))
            b.boilerplate |= n < FRAME_BLOCKS or 2 * words < whole


def _after(html: str, name: str, attributes: str, at: int, unclosed: set[str]) -> int:
    """Where a page goes on after an opening tag, which ends at `at`, whose content is dropped.

    Without a closing tag only script and style take the rest of the page; unclosed has the names known to have none.
    """
    if name in ("svg", "math") and attributes.endswith("/"):
        return at
    found = None if name in unclosed else _CLOSE[name].search(html, at)
    if found:
        return found.end()
    unclosed.add(name)
    return len(html) if name in ("script", "style") else at


def text_blocks(html: str) -> list[TextBlock]:
    """The blocks of a page in order, with character references decoded and white space as single spaces.

    A head ends at its closing tag, or before text or a tag that can't stand in it. A quote that isn't closed is no
    quote; where that has been looked for over four times the length of the page, quotes are ignored, so that the time
    for a page is in proportion to its length, whatever is in it.
    """
    page, at, start, unclosed, wasted = _Page(), 0, 0, set(), 0
    #: Whether the page is in its head; whether titles are still the head's.
    head = titles = False
    while m := _START.search(html, start):
        name, attributes = m[2], ""
        if m[0] == "<!--":
            end = html.find("-->", m.start() + 2)
            end = len(html) if end < 0 else end + 3
        elif (end := html.find(">", m.end())) < 0:
            break
        elif name and wasted <= 4 * len(html):
            found = _ATTRIBUTES.match(html, m.end()).end()
            if found < len(html) and html[found] == ">":
                end = found
            else:
                wasted += found - m.end()
            attributes, end = html[m.end() : end], end + 1
        else:
            attributes, end = html[m.end() : end], end + 1
        raw = html[at : m.start()]
        if raw and not (head and not raw.strip()):
            head = False
            page.add(raw)
        at = start = end
        if not name:
            continue
        close, name = m[1] == "/", name.lower()
        if name in ("head", "body"):
            head = titles = name == "head" and not close
        elif head and (name not in _HEAD if not close else name in ("html", "br")):
            head = False
        if not close and (name in _RAW or (titles and name == "title")) and (not attributes or attributes[0] in " \t\n\r\f/"):
            at = start = _after(html, name, attributes, at, unclosed)
        elif name == "head" or not head:
            page.tag(close, name, attributes)
    if at < len(html):
        rest = html[at:]
        cut = rest.rfind("<")
        page.add(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest)  # a tag that the page's end cuts
    page.flush()
    if page.forms:
        _judge_forms(page.blocks)
    return page.blocks


_BLOCK = re.compile(r"(\d+)(?:/(\d+))?([hlabc]*)(\+?)")


def labelled() -> list[tuple[list[TextBlock], list[bool]]]:
    """The blocks of each page of the labelled table, and which are main text."""
    out = []
    for line in LABELLED.strip().splitlines():
        found = [_BLOCK.fullmatch(x) for x in line.split()]
        out.append(([TextBlock("", int(m[1]), int(m[2] or 0), *(x in m[3] for x in "hlabc")) for m in found], [m[4] == "+" for m in found]))
    return out


def features(blocks: list[TextBlock]) -> np.ndarray:
    own = [(b.words, 100 * b.linked / b.words) for b in blocks]
    around = [(0, 0), *own, (0, 0)]
    return np.array([(*around[i + 1], *around[i], *around[i + 2], b.heading, b.item, b.article, b.boilerplate, b.comments) for i, b in enumerate(blocks)], float).reshape(len(blocks), 11)


class Tree:
    """A decision tree of the least Gini impurity; ties go to the first feature and the lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7):
        self.share = float(y.mean())
        self.feature = None
        if depth == 0 or self.share in (0.0, 1.0):
            return
        best = (self._impurity(y) * len(y) - 1e-9, None, None)
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= cut
                cost = self._impurity(y[left]) * left.sum() + self._impurity(y[~left]) * (~left).sum()
                if cost < best[0] - 1e-9:
                    best = (cost, j, cut)
        if best[1] is not None:
            _, self.feature, self.cut = best
            left = x[:, self.feature] <= self.cut
            self.left, self.right = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share >= 0.5)
        left = x[:, self.feature] <= self.cut
        out = np.zeros(len(x), bool)
        out[left], out[~left] = self.left.predict(x[left]), self.right.predict(x[~left])
        return out


def train(pages: list[tuple[list[TextBlock], list[bool]]]) -> Tree:
    return Tree(np.concatenate([features(b) for b, _ in pages]), np.concatenate([np.array(y, float) for _, y in pages]))


@lru_cache(1)
def trained() -> Tree:
    return train(labelled())


def main_text(html: str) -> str:
    """The blocks of the article, joined by line feeds."""
    blocks = text_blocks(html)
    if not blocks:
        return ""
    keep = trained().predict(features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages, which has these keys and html.

    A null or empty html, and one without main text, gives an empty text; null keys stay, repeated rows are rows like
    others, other columns are left out. A page is taken whole, in time and memory in proportion to its length.
    """

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_texts(rows, "html", "page_id long, url string, text string, n_chars long", work)
