"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read once, front to back, into flat blocks: text between block-level tags. A block's
features are its words and link density, those of its neighbours before and after, and what kind of
part it stands in. A decision tree fitted on the labelled blocks of a few small sample pages tells
article from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts whose content is no text of the page at all.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title",
       "textarea", "xmp", "noembed", "noframes"}
# Of these, parts in which no tag is read before their own end tag.
RAW_TEXT = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
_RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*(?:>|$)", re.I) for tag in RAW_TEXT}
# Elements that may stand in a head; any other one begins the body.
HEAD = RAW_TEXT - {"textarea", "xmp", "iframe"} | {
    "base", "basefont", "bgsound", "link", "meta", "noscript", "template"}
HIDDEN = RAW | {"select", "button", "datalist", "audio", "video"}
# Of the hidden ones, those that hold no blocks: one left open ends where a block begins.
NARROW = {"select", "button", "datalist", "svg", "math"}
# Inline elements: their tags do not end a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements and words of class, id or role that name parts around an article.
AROUND = set("nav header footer aside form menu dialog fieldset".split())
AROUND_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|"
    r"breadcrumb\w*|header|masthead|footer|sidebar\w*|side|aside|widget\w*|related|recommend\w*|share|"
    r"sharing|social|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|signup|login|search|"
    r"comment\w*|disqus|respond|replies|reply|pagination|pager|complementary|contentinfo|legal|"
    r"copyright|toolbar|alert|paywall|gdpr)(?:$|[\s_-])", re.I,
)
ARTICLE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:article\w*|post|posts|content|main|story|entry|body|text|hentry)(?:$|[\s_-])", re.I
)
_PART = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)"
    r"((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|[^<]+|<", re.S,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WHITE = re.compile(r"\s+")

# Elements that a new one ends where their own end tag is left out, and those it does not look beyond.
_CELL, _ROWS = {"td", "th"}, {"thead", "tbody", "tfoot"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"} | _CELL),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl", "table"} | _CELL)),
    **dict.fromkeys(_CELL, (_CELL, {"table"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(_ROWS, (_ROWS | {"tr"}, {"table"})),
}
# These end an open paragraph as well.
ENDS_P = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
P_BOUND = {"table", "caption"} | _CELL

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "around", "article", "heading")


@dataclass
class Part:
    """An open element: named as a part around an article or as one, and what it turned out to hold."""

    tag: str
    around: bool
    article: bool
    # Only its class, id or role say that it stands around.
    by_name: bool
    words: int = 0
    # Words of each article or main element in it.
    articles: list[int] = field(default_factory=list)

    def stands_around(self) -> bool:
        """A container named so that holds one article, or one that outweighs all else, is no part around it."""
        inner = max(self.articles, default=0)
        return self.around and not (self.by_name and (len(self.articles) == 1 or 2 * inner > self.words) and inner)


@dataclass
class Block:
    text: str
    words: int
    links: float
    parts: tuple[Part, ...]
    heading: int
    around: int = 0
    article: int = 0


def _named(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))


def blocks_of(page: str | None) -> list[Block]:
    """Flat blocks in page order; never fails, whatever the markup."""
    found: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    open_parts: list[Part] = []
    opened: Counter[str] = Counter()
    heading = 0
    # How many elements were open where the open link began; the link ends with the innermost of them.
    link: int | None = None
    hidden: str | None = None
    inner: Counter[str] = Counter()
    in_head = False

    def close() -> None:
        if text:
            whole = _WHITE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                words = len(whole.split())
                inside = sum(len(html.unescape(piece).split()) for piece in linked)
                found.append(Block(whole, words, min(1.0, inside / words), tuple(open_parts), heading))
                for part in open_parts:
                    part.words += words
            text.clear()
            linked.clear()

    def end_open(tags: set[str], bound: set[str]) -> None:
        nonlocal link
        for at in range(len(open_parts) - 1, -1, -1):
            if open_parts[at].tag in tags:
                for part in reversed(open_parts[at:]):
                    end(part)
                del open_parts[at:]
                if link is not None and at < link:
                    link = None
                return
            if open_parts[at].tag in bound:
                return

    def end(part: Part) -> None:
        opened[part.tag] -= 1
        if part.tag in ("article", "main") and not part.around:
            for outer in open_parts[: open_parts.index(part)]:
                outer.articles.append(part.words)

    page, here = page or "", 0
    while m := _PART.match(page, here):
        here = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if hidden or piece.startswith(("<!", "<?")) or (in_head and piece.isspace()):
                continue
            in_head = False
            text.append(piece)
            if link is not None:
                linked.append(piece)
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW_TEXT and not closing:
            if not m[3].endswith("/"):
                # No tag is read in here; without an end the rest of the page belongs to it.
                finish = _RAW_END[tag].search(page, here)
                here = finish.end() if finish else len(page)
            if not hidden and tag not in HEAD:
                in_head = False
            continue
        if hidden:
            # A hidden element ends at its own end tag, with the element around it, or, if it holds no
            # blocks, where one begins.
            if closing and inner[tag] > 0:
                inner[tag] -= 1
                if tag == hidden and not inner[tag]:
                    hidden = None
                continue
            if closing and not opened[tag]:
                continue
            if not closing and not (hidden in NARROW and tag in ENDS_P):
                if tag not in VOID and not m[3].endswith("/"):
                    inner[tag] += 1
                continue
            hidden = None
        if tag == "head":
            in_head = not closing
            continue
        # The end tag of a head may be left out: the first element of a body ends it.
        in_head &= closing or tag in HEAD
        if tag in HIDDEN and not closing:
            if not m[3].endswith("/"):
                hidden = tag
                inner.clear()
                inner[tag] = 1
            continue
        if tag == "a":
            link = None if closing else len(open_parts)
        if tag in INLINE:
            continue
        close()
        if not closing:
            if tag in ENDS_P and opened["p"]:
                end_open({"p"}, P_BOUND)
            if tag in ENDS and any(opened[x] for x in ENDS[tag][0]):
                end_open(*ENDS[tag])
        if tag in VOID:
            continue
        heading = int(tag[0] == "h" and tag[1:].isdigit() and not closing)
        if closing:
            # An element that was never closed ends with the one around it.
            if opened[tag]:
                end_open({tag}, set())
            continue
        if tag in ("option", "html", "body"):
            continue
        name = _named(m[3]) if "=" in m[3] else ""
        says_article, says_around = bool(ARTICLE_WORDS.search(name)), bool(AROUND_WORDS.search(name))
        whole = tag in ("article", "main")
        # A header within an article is the article's own; an article named as both is an article.
        own_header = tag == "header" and any(part.tag == "article" for part in open_parts)
        by_tag = tag in AROUND and not own_header
        outside = by_tag or (says_around and not own_header and not (whole and says_article))
        open_parts.append(Part(tag, outside, not outside and (whole or says_article), not by_tag and not whole))
        opened[tag] += 1
    close()
    for part in reversed(open_parts):
        end(part)
    for block in found:
        block.around = int(any(part.stands_around() for part in block.parts))
        block.article = int(any(part.article for part in block.parts))
    return found


def block_features(blocks: list[Block]) -> np.ndarray:
    own = np.array([[min(b.words, 200), b.links] for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own])[:-1], np.concatenate([own, edge])[1:]
    kind = np.array([[b.around, b.article, b.heading] for b in blocks], float).reshape(-1, 3)
    return np.concatenate([own, before, after, kind], axis=1)


# The labelled table: small pages whose blocks are marked, ``+`` article and ``-`` boilerplate, in order.
SAMPLE_PAGES = [
    ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><article><h1>River "
     "floods</h1><p>The river rose over night and the lower town stood under water by noon, said the "
     "mayor.</p><p>Help came late.</p></article><footer>&copy; 2020 Town paper, all rights reserved</footer>",
     "--+++-"),
    ("<header><h1>Daily</h1><p>News since 1900</p></header><div class='ad'>Buy one, get two, only this "
     "week and only here in our shop.</div><main><h2>Bread</h2><p>Mix flour and water.</p><p>Let the "
     "dough rest for three hours in a warm place, then fold it twice and bake it.</p></main><aside>"
     "<p>More recipes that readers liked this month, from soup to cake and back.</p></aside>",
     "---+++-"),
    ("<div id='menu'><a href='a'>One</a> <a href='b'>Two</a></div><div id='content'><p>A long day ended "
     "at the sea, where nobody had waited for the travellers, and the hotel was closed.</p><p>See also "
     "<a href='x'>the map</a> of the coast.</p></div><div class='comments'><p>I was there last year and "
     "the hotel was open all summer long, so I wonder what has happened.</p></div>", "-++-"),
    ("<p><a href='a'>Start</a> <a href='b'>Shop</a> <a href='c'>Help</a></p><p>The committee met on Monday "
     "to speak about the bridge, which has been closed for repairs since the early spring of this "
     "year.</p><p>No date was given.</p><p>It will meet again before winter, when the engineers have "
     "handed in the second of their three reports.</p><p><a href='p'>Next page</a></p>", "-+++-"),
    ("<ul><li><a href='1'>Sports results</a></li><li><a href='2'>Weather today</a></li></ul><h1>A quiet "
     "harvest</h1><p>Farmers brought in less grain than in any year since the great drought, and prices "
     "in the markets of the region went up at once.</p><p>Contact</p>", "--++-"),
    ("<form><p>Your name and your address, so that we can send you the letter every week.</p></form>"
     "<article><p>Short note.</p></article><div class='cookie-notice'>We use cookies to make this site "
     "better for you and for all our partners.</div>", "-+-"),
    ("<article><header><h1>Title of it</h1></header><p>One.</p><ul><li>First point of the list</li><li>"
     "Second point</li></ul><p><a href='s'>A source</a></p></article><div class='related'><p>Read this "
     "too, a story of a man and his boat and the sea around them.</p></div><footer><p>Imprint</p></footer>",
     "+++++--"),
    ("<div><p>All rights reserved.</p></div><div><p>When the lights went out the orchestra played on, "
     "and not one of the guests left the hall before the last note had died away.</p><p>They clapped for "
     "ten minutes, some of them in tears, and asked for the first movement once more.</p></div><p>Log in"
     "</p>", "-++-"),
    ("<div class='ad banner'>Only today you get the whole set of twelve knives with a free board and a "
     "book of recipes, sent to your door at no cost to you.</div><div><p>The old mill by the lake was "
     "sold to a couple from the city who want to grind rye there again, as it was done for ages.</p></div>"
     "<aside><p>Our reporters travel all over the country for you and write about the people they meet on "
     "the road, week after week.</p></aside><footer><p>This paper is printed by a house that was founded "
     "by two brothers long ago and still belongs to the same family today.</p></footer>", "-+--"),
    ("<div id='comments'><p>What a fine story, I have read it to my children twice and they want to hear it "
     "again tonight before they go to sleep.</p><p>I do not agree at all, for the mill was never a place "
     "where anyone could live, and the lake is a pond.</p></div><form><p>Tell us in a few words what you "
     "think of this page, and leave your name and address so that we can answer you.</p></form><div "
     "class='sidebar'><p>Most read in the last seven days by those who live near you and have told us "
     "which parts of the paper they like.</p></div>", "----"),
    ("<article><h1>Fog</h1><p>Ships waited.</p></article>", "++"),
    ("<article><p>It rained.</p></article>", "+"),
    ("<article><p>It rained.</p><p><a href='r'>Rain chart</a></p></article>", "++"),
    ("<main><p>A storm took the roof of the school on the hill, and lessons are held in the town hall until "
     "the end of the month.</p></main>", "+"),
    ("<p>Sign in</p><p>The two teams met for the third time this year, and for the third time neither of "
     "them could score before the break.</p><p>After it the rain made the field so wet that the ball "
     "stopped dead wherever it fell to the ground.</p>", "-++"),
    ("<p>We found nothing here.</p>", "-"),
    # The same short blocks, told apart by their links and neighbours alone.
    ("<div><a href='1'>North</a> <a href='2'>South</a> <a href='3'>East</a></div><div><p>The ferry did not sail on "
     "Sunday, as the wind had turned and the harbour master would not let her go.</p><p>On Monday she left at "
     "dawn with half of her cargo and none of the mail.</p></div><div><a href='4'>More of the coast</a></div><div>"
     "<a href='5'>Ships and their owners</a></div>", "-++--"),
    ("<article><h1>Snow</h1><p>The pass is closed until the thaw.</p><p>Two roads in the valley are open again, said "
     "the warden on the radio this morning.</p><ul><li><a href='1'>Ten huts for the winter</a></li><li><a href='2'>How "
     "to read the sky</a></li><li><a href='3'>All about snow shoes</a></li></ul></article>", "+++---"),
    ("<main><h1>Glass</h1><p>The furnace burns day and night, and the men who feed it sleep in turns beside the "
     "door.</p><a href='n'><div><h3>A town of bells</h3><p>What the founders left behind</p></div></a><a href='o'><div>"
     "<h3>The last weaver</h3><p>A visit to her loom</p></div></a></main>", "++----"),
    ("<div><p>By <a href='/w'>our writer</a> in the north, who has known the lake since childhood and walks there "
     "every day.</p><p>Few birds came.</p><p>The reeds were cut too early, <a href='/r'>a study</a> found, and the "
     "nests of the year before were gone when spring began.</p></div><div><a href='/x'>Birds</a> | <a href='/y'>Lakes"
     "</a> | <a href='/z'>Reeds and rushes</a></div>", "+++-"),
    ("<div><a href='/'>The Evening Star</a></div><div><a href='/in'>Enter</a></div><h1>Salt</h1><p>It was dug here for "
     "a thousand years.</p><p>When the mine closed, the men took the train to the coast and few of them returned to "
     "the hills.</p><p><a href='/s'>Next: the story of the train to the coast</a></p>", "--+++-"),
    ("<section><h2>Honey</h2><p>Bees do not fly in the rain.</p><p>Their keeper waits in the hut, and writes down what "
     "the scales below each hive have shown since noon.</p></section><section><p><a href='1'>Wax</a></p><p><a "
     "href='2'>Hives for beginners</a></p><p><a href='3'>The dance that leads them home again</a></p></section>",
     "+++---"),
    ("<article><p>See <a href='m'>the map</a>.</p><p>Both paths lead up to the chapel, but only the left one is marked "
     "and safe after dark.</p></article><div><p><a href='1'>Chapels of the south</a></p></div>", "++-"),
    ("<article><p>A short walk</p><p>Two hours<br>up to <a href='t'>the tower</a></p><p>Bring <a href='b'>boots</a>.</p>"
     "</article>", "++++"),
    ("<article><p>The shop is open all week.</p><p>Call <a href='c'>the owner</a></p></article><div><a href='1'>Shops"
     "</a></div>", "++-"),
    ("<article><h1>Peat</h1><p>It burns slowly and smells of autumn, and the island had nothing else for its stoves."
     "</p></article><a href='1'><div><h3>One more tale</h3><p>of islands and smoke</p></div></a><a href='2'><div><h3>Old "
     "boats</h3><p>by the pier at night</p></div></a>", "++----"),
    ("<div><h1>Rain</h1><p>It fell for six days on the roofs of the town and on the seventh the cellars were full.</p>"
     "</div><a href='1'><p>Sun</p></a><a href='2'><p>Wind and the sea</p></a>", "++--"),
    ("<article><p>Nothing is lost.</p></article><a href='1'><h3>Found things</h3></a>", "+-"),
    ("<div class='page search'><article><h1>Clay</h1><p>Wet it, wedge it, throw it.</p><p>Then let the bowl dry for "
     "a week under a cloth before it goes near the kiln.</p></article></div><div class='search'><p>What are you "
     "looking for today on our pages, and in which year was it written?</p></div>", "+++-"),
]
MAX_DEPTH, MIN_LEAF = 7, 1


def fit_tree(points: np.ndarray, marks: np.ndarray, depth: int = MAX_DEPTH) -> tuple | float:
    """``(feature, threshold, below, above)`` down to shares of article blocks, by Gini gain."""
    share = float(marks.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for feature in range(points.shape[1]):
        values = np.unique(points[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = points[:, feature] < threshold
            a, b = marks[low], marks[~low]
            if len(a) < MIN_LEAF or len(b) < MIN_LEAF:
                continue
            impure = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impure < best[0] - 1e-12:
                best = (impure, feature, float(threshold), low)
    if best is None:
        return share
    _, feature, threshold, low = best
    return (feature, threshold, fit_tree(points[low], marks[low], depth - 1),
            fit_tree(points[~low], marks[~low], depth - 1))


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    points, marks = [], []
    for page, signs in SAMPLE_PAGES:
        blocks = blocks_of(page)
        if len(blocks) != len(signs):
            raise ValueError(f"{len(blocks)} blocks, {len(signs)} marks: {page[:60]}")
        points.append(block_features(blocks))
        marks.append(np.array([s == "+" for s in signs], float))
    return np.concatenate(points), np.concatenate(marks)


def is_article(tree: tuple | float, points: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(points), tree >= 0.5)
    feature, threshold, below, above = tree
    low = points[:, feature] < threshold
    out = np.empty(len(points), bool)
    out[low], out[~low] = is_article(below, points[low]), is_article(above, points[~low])
    return out


def main_text(page: str | None, tree: tuple | float) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    kept = is_article(tree, block_features(blocks))
    return " ".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame, html_column: str = "html", to: str = "_llm_main") -> DataFrame:
    """``pages`` with the main text in ``to``; null or empty pages, and pages without any, have ''.

    Broken markup is read as far as it goes; repeated rows get equal texts. Other columns stay.
    """
    tree = fit_tree(*labelled_blocks())

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in column], dtype=object)

    return pages.withColumn(to, text_of(F.col(html_column)))
