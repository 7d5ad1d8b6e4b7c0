"""Main text of web pages, by text-to-tag ratio.

The standard library's parser streams events; text gathers into blocks (the lines of the page)
with their tags counted. Blocks inside navigation, headers, footers, forms, notices, adverts,
comments and the like never count, unless the class or id that marks them as such holds the page's
own article or most of its text: then it only describes the layout. The ratio of characters to tags per block is smoothed by a
Gaussian, and blocks above the threshold, or with a sentence to themselves, are content. They
select the region: the smallest part of the page that holds all content, the whole of every
article and main element with text, and the titles. In a region that an article or main element
marks, all blocks are the text. In any other the content cluster is: all from its first to its last block, short
ones between them included, and headings, paragraphs, list items and cells from the title on and after it;
a bar before or after it has no sentence of its own and goes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Elements whose text never counts.
DROPPED = frozenset("head title script style noscript template nav header footer aside form button select option textarea input label fieldset iframe embed svg dialog menu menuitem datalist".split())
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promos promotion promoted nav navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead footer foot sidebar sidebars aside rail widget widgets comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert "
    "notification popup modal overlay dialog newsletter subscribe subscription signup login social share sharing shares related recommended recommendations "
    "toolbar pagination pager skip complementary contentinfo search".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address hr details summary hgroup center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these kinds within the nearest of the bounds.
CLOSES = {"p": ({"p"}, BLOCKS - {"p"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_OPEN_END = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
#: Width of the Gaussian in blocks; characters per tag of a sentence that is content wherever it stands.
SIGMA, SENTENCE = 1.0, 25.0
#: Elements that can be the region, and words of class, id and role of an article that is somebody's comment.
REGIONS = frozenset(["", *"html body main article section div center".split()])
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Marks of others' words, which may outweigh a short article.
OTHERS = COMMENTS | frozenset("ad ads adbox advert adverts advertisement advertisements cookie cookies consent gdpr".split())
#: Words that make a class or id with a mark a remark on the layout; shares of the page's sentences that show the same.
LAYOUT = frozenset("has no with without not enabled disabled fixed sticky elementor".split())
HALF, MOST = 0.5, 0.8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose short texts after the last sentence still belong to it.
PROSE = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption".split())
LEADS = HEADINGS | frozenset("p pre blockquote".split())
#: Characters of a block, and characters per tag, that make it a sentence and not a list of links.
LONG, WORDY = 50, 5


def marks_of(attributes: list[tuple[str, str | None]], marks: frozenset[str] = MARKS) -> frozenset[str]:
    """The classes, ids and roles that mark an element."""
    found = []
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                said = {w.lower() for w in _WORD.findall(token)}
                if said & marks and not said & LAYOUT:
                    found.append(token)
    return frozenset(found)


def hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attributes)


class Blocks(HTMLParser):
    """Collects blocks: (texts with the marks around each, tags, path of element numbers from the root)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, frozenset[str] | None]] = [("", 0, frozenset())]  # tag, element number, marks; None: dropped
        self.kinds: list[str] = [""]
        self.named: dict[int, frozenset[str]] = {}  # marks of each article and main element
        self.blocks: list[tuple[list[tuple[str, frozenset[str]]], int, tuple[int, ...]]] = []
        self.text: list[tuple[str, frozenset[str]]] = []
        self.heads: set[int] = set()  # headers within an article
        self.aside: list[bool] = []  # of each block: in such a header, but no heading
        self.tags = 0

    def flush(self) -> None:
        if any(text and not text.isspace() for text, _ in self.text):
            self.blocks.append((self.text, self.tags, tuple(n for tag, n, _ in self.open if tag in BLOCKS or not tag)))
            self.aside.append(any(n in self.heads for _, n, _ in self.open) and not any(tag in HEADINGS for tag, _, _ in self.open))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attributes):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            ended, bounds = CLOSES.get(tag, ({"p"}, BLOCKS - {"p"}) if tag not in ("html", "body") else (set(), set()))
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] in ended:
                    del self.open[at:]
                    break
                if self.open[at][0] in bounds:
                    break
        elif tag == "br":
            self.text.append((" ", frozenset()))
        if tag not in VOID:
            above, marks = self.open[-1][2], frozenset()
            if tag == "main":
                above = frozenset()
            elif tag not in ("html", "body"):
                marks = marks_of(attributes, MARKS if tag != "article" or any(k == "article" for k, _, _ in self.open) else COMMENTS)
            own = tag == "header" and above is not None and any(k == "article" for k, _, _ in self.open)
            if own:  # the article's title is text, its other lines only if they are sentences
                self.flush()
                self.heads.add(len(self.kinds))
                marks = frozenset()
            dropped = above is None or tag in DROPPED and not own or tag not in ("html", "body", "main") and hidden(attributes)
            if tag in ("article", "main") and not dropped:
                self.named[len(self.kinds)] = above | marks
            self.open.append((tag, len(self.kinds), None if dropped else above | marks))
            self.kinds.append(tag)

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                if tag in BLOCKS or any(t in BLOCKS or n in self.heads for t, n, _ in self.open[at:]):
                    self.flush()
                del self.open[at:]
                return
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:  # an inline end does not reach past its block
                return

    def handle_data(self, data):
        if self.open[-1][2] is not None:
            self.text.append((data, self.open[-1][2]))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach:reach + len(ratios)]


def layout(parser: Blocks) -> frozenset[str]:
    """Marks that only describe the layout: their elements hold the page's own article or most of its sentences.

    With an article elsewhere, or for others' words, they must hold most, an article and the title,
    or leave no sentence outside. Sentences among others' words do not count for the other marks."""
    sentences = []  # size, marks, those around an article (None without one), in a title
    for texts, tags, path in parser.blocks:
        named = [parser.named[e] for e in path if e in parser.named]
        around = frozenset().union(*named) if named else None
        sizes = [len(text.strip()) for text, _ in texts]
        said = sum(sizes) >= max(LONG, WORDY * tags)
        title = any(parser.kinds[e] == "h1" for e in path)
        sentences += [(size if said else 0, marks, around, title) for size, (_, marks) in zip(sizes, texts, strict=True) if size]
    every = list(dict.fromkeys(mark for _, marks, _, _ in sentences for mark in sorted(marks)))
    others = frozenset(m for m in every if {w.lower() for w in _WORD.findall(m)} & OTHERS)
    held = dict.fromkeys(every, 0)
    for size, marks, _, _ in sentences:
        for mark in marks:
            held[mark] += size
    rest = sum(size for size, marks, _, _ in sentences if marks.isdisjoint(others))
    free: frozenset[str] = frozenset()
    for mark in every:
        if not held[mark] or held[mark] < HALF * rest:
            continue
        own = [s for s in sentences if mark in s[1]]
        theirs = others - free - {mark} if mark not in others else frozenset()
        total = sum(size for size, marks, _, _ in sentences if marks.isdisjoint(theirs))
        size = sum(size for size, marks, _, _ in own if marks.isdisjoint(theirs))
        article, title = any(n and a and mark in a for n, _, a, _ in own), any(t for *_, t in own)
        outside = [s for s in sentences if s[0] and mark not in s[1] and s[1] <= free]
        most = size > 0 and size >= MOST * total
        if mark in others or any(a is not None for _, _, a, _ in outside):
            wraps = most and article and (title or not outside)
        else:
            wraps = most or article and size >= HALF * total
        if wraps:
            free |= {mark}
    return free


def extract(page: str | None) -> str:
    """The article's text; blocks are joined by two line ends."""
    if not page:
        return ""
    parser = Blocks()
    parser.feed(_OPEN_END.sub("", page))
    parser.close()
    parser.flush()
    free = layout(parser)
    blocks, passed = [], 0  # tags of a block without text count for the next
    for (texts, tags, path), aside in zip(parser.blocks, parser.aside, strict=True):
        text = " ".join("".join(text for text, marks in texts if marks <= free).split())
        passed += tags
        if text and not (aside and len(text) < max(LONG, WORDY * tags)):
            blocks.append((text, passed, path))
            passed = 0
    if not blocks:
        return ""
    sizes = np.array([len(text) for text, _, _ in blocks], np.float64)
    ratios = sizes / np.maximum([tags for _, tags, _ in blocks], 1)
    smooth = smoothed(ratios)
    content = (smooth >= min(smooth.std(), smooth.max())) | (ratios >= SENTENCE)
    region: tuple[int, ...] | None = None
    for counts, (_, _, path) in zip(content.tolist(), blocks, strict=True):
        named = next((at for at, e in enumerate(path) if parser.kinds[e] in ("article", "main")), None)
        if named is not None:
            path = path[:named + 1]
        elif not counts and not any(parser.kinds[e] == "h1" for e in path):
            continue
        region = path if region is None else tuple(a for a, b in zip(region, path) if a == b)  # noqa: B905
    while parser.kinds[region[-1]] not in REGIONS:
        region = region[:-1]
    within = [i for i, (_, _, path) in enumerate(blocks) if region[-1] in path]
    if not any(parser.kinds[e] in ("article", "main") for _, _, path in blocks for e in path):
        within = cluster(within, [parser.kinds[path[-1]] for _, _, path in blocks], content & ((ratios >= SENTENCE) | (sizes >= LONG)))
    return "\n\n".join(blocks[i][0] for i in within)


def cluster(within: list[int], kinds: list[str], content: np.ndarray) -> list[int]:
    """The blocks of a region that belong to its content: from the first to the last sentence above
    the threshold, prose from the title on, or headings and paragraphs right before them, and prose after them. All, if there is no such sentence."""
    sure = [i for i in within if content[i]]
    if not sure:
        return within
    out = [i for i in within if sure[0] <= i <= sure[-1]]
    early = [i for i in within if i < sure[0]]
    title = next((i for i in early if kinds[i] == "h1"), None)
    if title is not None:  # from the title on, all prose
        out = [i for i in early if i >= title and kinds[i] in PROSE] + out
    else:
        for i in reversed(early):
            if kinds[i] not in LEADS:
                break
            out.insert(0, i)
    for i in [i for i in within if i > sure[-1]]:
        if kinds[i] not in PROSE:
            break
        out.append(i)
    return out


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points).

    Null or empty pages have no text; repeated rows are extracted alike; a tag cut off by the end of
    the page is markup; empty tables give empty results; other columns are ignored."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    out = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(
        run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
