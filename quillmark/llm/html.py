"""Main text of HTML pages by two passes over blocks.

Pass one labels each block on its own by length, share of link text and share of stop words; elements that say what
they are (menus, footers, an article) shift the limits or decide. Pass two gives ambiguous blocks the label of their
nearest decided neighbours; in an article, of those in the article. Class names count only as whole names or as compounds
of such words (ad, related-posts), not where one of them stands among others (related-work), and only on block elements.
In an article, single names that a text may have for its own parts (discussion, recommended) only put a block in doubt.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Frequent words of four languages.
STOP_WORDS = {
    "en": "a about after all an and are as at be been but by can for from had has have he her his i if in is it its more no not of on one or our out she so than that the their them there they this to up was we were what when which who will with would you",
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was werden wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous y",
    "es": "a al ante como con de del desde donde el ella en entre era es esta este ha hay la las le lo los más me muy no o para pero por que se si sin sobre su sus también un una y ya",
}
WORDS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg canvas audio video".split())
BAD_TAGS = frozenset("nav footer aside form button select menu dialog head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended teaser comment comments commentlist reply replies respond disqus discussion footer masthead toolbar widget widgets login signup register pagination pager skip".split()
)
NAMES_OF_HEADERS = frozenset("header topbar".split())
#: Words that go with those above in the name of a class, and say nothing alone.
NAME_PARTS = frozenset("area articles bar block box btn button buttons container content footer form group holder inner item items lightbox links list main message node outer panel posts row section site slot stories thread top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that parts of an article may have as well.
SOFT_NAMES = frozenset("alert discussion menu notice notices promo promotion recommended related replies reply share sharing skip social widget widgets".split())
#: Names that make even an article element no part of the text.
ARTICLE_NAMES = frozenset("comment comments reply ad advert teaser".split())
#: A start tag closes an open element of these kinds at the top.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Characters of a short and of a long block; shares of link text and of stop words.
SHORT, LONG, LINKS, LINKS_INSIDE, STOPS_LOW, STOPS_HIGH = 70, 200, 0.4, 0.9, 0.15, 0.28

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Block:
    __slots__ = ("parts", "links", "bad", "inside", "doubt", "heading", "text", "label")

    def __init__(self, bad: bool, inside: bool, doubt: bool, heading: bool):
        self.parts, self.links, self.bad, self.inside, self.doubt, self.heading = [], 0, bad, inside, doubt, heading


def says(name: str, known: frozenset[str]) -> bool:
    """Whether a class name is one of the known words, or a compound of one with others that fit."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p and not p.isdigit()]
    return any(p in known for p in parts) and all(p in known or p in BAD_NAMES or p in NAME_PARTS for p in parts)


def marks(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """(no part of the text, start of the main text, in doubt) as an element's name and attributes say."""
    bad, good, doubt = tag in BAD_TAGS or tag == "header" and not inside, tag in ("article", "main"), False
    if attributes.strip():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        role = found.get("role", "").lower()
        if tag not in ("html", "body", "main"):
            if tag in BLOCK_TAGS and tag not in HEADINGS:
                known = BAD_NAMES if tag != "article" else ARTICLE_NAMES
                doubt = inside and tag != "p" and any(n in SOFT_NAMES for n in names)
                bad |= any(says(n, known) and not (inside and n in SOFT_NAMES) or not inside and says(n, NAMES_OF_HEADERS) for n in names) or role in BAD_ROLES
            bad |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        good |= role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    return bad, good, doubt


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order, with their text, share of link text and surroundings."""
    stack: list[tuple[str, bool, bool, bool]] = []  # element, in a bad one, in the main text, in doubt
    open_tags: Counter[str] = Counter()
    out: list[Block] = []
    current: Block | None = None
    before_hidden: Block | None = None
    at = in_link = 0

    def write(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if not raw.strip():
                return
            top = stack[-1] if stack else ("", False, False, False)
            current = Block(top[1], top[2], top[3], any(x[0] in HEADINGS for x in stack[-2:]))
            out.append(current)
        current.parts.append(raw)
        if in_link:
            current.links += len(raw.strip())

    while m := TOKEN.search(html, at):
        write(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # end tag
            if tag == "a":
                in_link = 0
            elif tag in BLOCK_TAGS or open_tags[tag]:
                for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                    if stack[k][0] == tag:
                        hidden = stack[k][1] and not (k and stack[k - 1][1])
                        open_tags.subtract(x[0] for x in stack[k:])
                        del stack[k:]
                        if hidden and tag not in BLOCK_TAGS:
                            current = before_hidden  # the text around goes on
                        break
                if tag in BLOCK_TAGS:
                    current, in_link = None, 0
            continue
        if tag in RAW_TAGS:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br":
            write(" ")
        if tag in BLOCK_TAGS:
            current, in_link = None, 0
            if stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                open_tags[stack.pop()[0]] -= 1
                if tag == "tr" and stack and stack[-1][0] == "tr":
                    open_tags[stack.pop()[0]] -= 1
        if tag not in VOID_TAGS and (tag in BLOCK_TAGS or m[3].strip()) and tag != "a":
            below = stack[-1] if stack else ("", False, False, False)
            bad, good, doubt = marks(tag, m[3], below[2])
            if tag in BLOCK_TAGS or bad or good:
                if bad and not below[1] and tag not in BLOCK_TAGS:
                    before_hidden, current = current, None
                open_tags[tag] += 1
                stack.append((tag, below[1] or bad, below[2] or good, below[3] or doubt))
    write(html[at:])
    kept = []
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()%$&#*") for w in text.lower().split()]
    return sum(w in WORDS for w in words) / max(1, len(words))


def first_label(b: Block, has_main: bool) -> str:
    """good, bad, near (probably good) or short, from the block alone."""
    n, links = len(b.text), b.links / max(1, len(b.text))
    if b.bad or has_main and not b.inside:
        return "bad"
    if has_main and b.doubt:  # in the article only what an element's name puts in doubt has to show that it is text
        return "bad" if links > LINKS else "good" if n >= SHORT and stop_share(b.text) >= STOPS_LOW else "short"
    if has_main:
        return "good" if n >= SHORT and links <= LINKS_INSIDE and not b.heading else "short"
    if links > LINKS or b.text.startswith(("©", "(c) ", "Copyright ")):
        return "bad"
    if n < SHORT or b.heading:
        return "bad" if links > 0.2 else "short"
    share = stop_share(b.text)
    if share >= STOPS_HIGH:
        return "good" if n > LONG else "near"
    return "near" if share >= STOPS_LOW or n > LONG else "short"


def main_text(html: str) -> str:
    """Text of the page's article: its blocks in page order, with an empty line between."""
    blocks = blocks_of(html)
    usable = sum(len(b.text) for b in blocks if not b.bad)
    has_main = 4 * sum(len(b.text) for b in blocks if b.inside and not b.bad) >= usable > 0
    if has_main:  # what is around the article, or is something else by its element, says nothing about the article's blocks
        blocks = [b for b in blocks if b.inside and not b.bad]
    first = [first_label(b, has_main) for b in blocks]
    if "good" not in first:
        best = "near" if "near" in first else "short"
        first = ["good" if x == best else x for x in first]
    edge = "good" if has_main else "bad"
    before, after = nearest(first, edge), [*reversed(nearest(first[::-1], edge))]
    labels = []
    for i, x in enumerate(first):
        (near, a), (far, b) = before[i], after[i]
        if x in ("good", "bad"):
            labels.append(x)
        elif has_main and not blocks[i].doubt:  # nothing decided against stands in an article but what is in doubt
            labels.append("good")
        elif x == "near":
            labels.append("good" if "good" in (a, b) else "bad")
        elif a == b:
            labels.append(a)
        else:  # the nearer one decides; a heading goes with what follows it
            labels.append(b if blocks[i].heading or far < near else a if near < far else "good")
    return "\n\n".join(b.text for b, x in zip(blocks, labels, strict=True) if x == "good")


def nearest(labels: list[str], edge: str) -> list[tuple[int, str]]:
    """(distance, label) of the last decided block before each; far away and as edge says at the edge."""
    out, last, at = [], edge, -(1 << 30)
    for i, x in enumerate(labels):
        out.append((i - at, last))
        if x in ("good", "bad"):
            last, at = x, i
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    Null or empty HTML gives an empty text. Repeated rows give repeated results, an empty table none; columns besides
    the three are not read. The whole page is read, however long, and cut-off tags at its end are dropped.
    """
    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = {c: kept.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return kept.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
