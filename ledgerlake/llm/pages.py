"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, each block on its own: blocks inside page furniture are bad; of
the others, long ones with enough stop words are good, long ones with few and blocks dense in links are bad, and the rest,
short ones above all, stays undecided. Second pass: an undecided block takes the label of its nearest decided neighbours,
good if either side is. On a page without an article where nothing is decided, undecided blocks are good.

Where a page's blocks hold hardly any of the known stop words, its language isn't one of those: link density and length
alone decide then.

Inside a page's article the same figures decide, with three differences: it takes both few stop words and many links to make
a long block bad, and a block all of links is undecided; undecided blocks ask only the article's own blocks, and are good
where none of those is decided; but short blocks of links that follow one another are a box of links, and bad with the
heading above them.

Furniture is what tags, roles and whole class names say it is; reader comments are also known by their heading: where a
section's first text is a heading such as "3 comments", the section is furniture. In an article, headings of a box that
holds furniture only go with it, and so do short texts that ask for consent to cookies.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block, tags whose content is no text, void tags.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
HIDDEN_TAGS = frozenset("head script style noscript template textarea title select button datalist object svg math canvas iframe noembed noframes xmp audio video map".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Page furniture by tag and by ARIA role.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog".split())
#: Words that make a class name or id furniture on any tag, and those that do so on a container only; all
#: other words of the name must be of the same kinds or say no more than where or what kind of box it is.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sidebar sidebars navbar navigation breadcrumb breadcrumbs masthead cookie cookies consent "
    "newsletter subscribe subscription signup login commentlist comments disqus pagination sharing share".split()
)
CONTAINER_WORDS = frozenset("nav menu menus banner promo promotion footer header social related recommended recommendations comment reply replies respond popup modal overlay widget widgets pager notice notices alert".split())
BOX_WORDS = frozenset("site page post posts entry article top bottom left right main primary secondary bar box list item items block area section container wrapper wrap inner outer panel content text links icons buttons form global user thread".split())
CONTAINERS = frozenset("div section ul ol dl table details span center article".split())
#: Headings of reader comments in the corpus languages.
COMMENT_HEADING = re.compile(r"(?:\d+|reader|user|all|your|les|die|los|leave a|add a|post a)?\s*(?:comments?|reply|replies|responses|commentaires?|kommentare?|comentarios?)\s*(?:\(\d+\)|:)?", re.I)
#: How texts begin that ask for consent, in the corpus languages.
CONSENT = re.compile(r"(?:we|this (?:site|website|page)) uses? cookies|(?:nous utilisons|ce site utilise)(?: des)? cookies|(?:wir verwenden|diese (?:seite|website) verwendet) cookies|(?:usamos|utilizamos|este sitio (?:web )?(?:usa|utiliza)) cookies", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())
ARTICLE_TAGS = frozenset(("article", "main"))
CLOSED_BY = {"li": {"ul", "ol", "menu"}, "p": BLOCK_TAGS, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}}

#: Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    "the of and to in is it that for on as with was be by are this from at or an a have not but they you his her he she we were which their had has will would there been if more no "
    "der die das und ist ein eine zu den von mit im in auf für nicht sich des dem auch als an es aus bei nach wie einen über "
    "le la les des et un une de du que qui dans pour pas sur au avec ce il en est par plus se sont aux ou "
    "el los las que y en del se por un una con no su para es al lo como más o pero sus".split()
)
MOST_LINKS = 0.3
#: A page with a smaller share of stop words is in another language; so many short blocks of links in a row are a box of links.
KNOWN_LANGUAGE, LINK_BOX = 0.04, 2
SHORT, FEW_STOPS, ENOUGH_STOPS = 70, 0.08, 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemtype|itemprop)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}

GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    furniture: bool
    in_article: bool
    heading: bool = False

    @property
    def many_links(self) -> bool:
        return self.linked / len(self.text) > MOST_LINKS


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE_TAGS or tag in HIDDEN_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDING.search(value)):
            return True
        if name in ("itemtype", "itemprop") and value.rstrip("/").rsplit("/", 1)[-1] in ("comment", "usercomments"):
            return True
        if tag not in ARTICLE_TAGS and ((name == "role" and value in FURNITURE_ROLES) or (name in ("class", "id") and any(_names_furniture(v, tag) for v in value.split()))):
            return True
    return False


def _names_furniture(name: str, tag: str) -> bool:
    parts = {p for p in re.split("[_-]+", name) if p}
    words = FURNITURE_WORDS | CONTAINER_WORDS if tag in CONTAINERS else FURNITURE_WORDS
    named = parts & words
    if not named or not parts <= FURNITURE_WORDS | CONTAINER_WORDS | BOX_WORDS:
        return False
    # a post's header holds its title
    return not (named <= {"header", "banner"} and parts & {"post", "entry", "article", "content", "section"})


@dataclass
class _Open:
    tag: str
    furniture: bool
    article: bool
    blocks: int  # blocks of the page before it was opened
    plain: int = 0  # blocks inside it that are no furniture and no headings
    junk: int = 0  # blocks of furniture inside it
    heads: list[int] = field(default_factory=list)  # headings inside it that nothing but furniture has followed


#: Boxes whose headings go with what they hold.
_BOXES = frozenset(("div", "section"))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, those without text left out. Unclosed and misnested tags are closed as browsers do. Time is
    in proportion to the page: what is open is counted, not searched."""
    out: list[Block] = []
    stack: list[_Open] = []
    outer: list[_Open] = []  # those of stack that are blocks
    count: Counter[str] = Counter()
    furniture = article = linked = 0
    parts: list[str] = []

    def flush() -> None:
        nonlocal linked, furniture
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            if outer and outer[-1].tag in HEADINGS and COMMENT_HEADING.fullmatch(text):
                box = next((o for o in reversed(outer[:-1][-3:]) if o.tag not in ("header", "hgroup")), None)
                if box and not box.furniture and box.tag in CONTAINERS and box.blocks == len(out):
                    box.furniture = True
                    furniture += 1
            heading = bool(outer) and outer[-1].tag in HEADINGS
            out.append(Block(text, linked, furniture > 0, article > 0, heading))
            if outer:
                held = outer[-1]
                if furniture:
                    held.junk += 1
                elif heading and outer[-1].tag != "h1":
                    held.heads.append(len(out) - 1)
                else:
                    held.plain += 1
        parts.clear()
        linked = 0

    def pop_to(tag: str) -> None:
        nonlocal furniture, article
        while stack:
            top = stack.pop()
            count[top.tag] -= 1
            furniture -= top.furniture
            article -= top.article
            if outer and outer[-1] is top:
                outer.pop()
                if top.tag in _BOXES and article and top.heads and top.junk and not top.plain:
                    for i in top.heads:
                        out[i].furniture = True
                    top.junk, top.heads = top.junk + len(top.heads), []
                if outer:
                    up = outer[-1]
                    up.plain, up.junk = up.plain + top.plain, up.junk + top.junk
                    more, most = sorted((up.heads, top.heads), key=len)
                    most += more  # the shorter to the longer: a heading moves a logarithmic number of times
                    up.heads = most
            if top.tag == tag:
                break

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        raw = page[at : found.start() if found else len(page)]
        if raw:
            parts.append(html.unescape(raw))
            if count["a"]:
                linked += len(_SPACE.sub(" ", parts[-1]))
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        if found[1] or found[4]:
            if count[tag]:
                pop_to(tag)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            close = _END[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        inner = outer[-1].tag if outer else None
        if inner and ((inner == "p" and tag in BLOCK_TAGS) or (inner == tag and tag in CLOSED_BY)):
            pop_to(inner)
        attributes = found[3] or ""
        if not attributes.rstrip().endswith("/") or tag in BLOCK_TAGS:
            new = _Open(tag, _is_furniture(tag, attributes, article > 0), tag in ARTICLE_TAGS, len(out))
            stack.append(new)
            count[tag] += 1
            furniture += new.furniture
            article += new.article
            if tag in BLOCK_TAGS or tag in CLOSED_BY:
                outer.append(new)
    flush()
    return out


def _stop_share(text: str) -> float:
    found = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


def known_language(found: list[Block]) -> bool:
    """Whether the blocks outside furniture hold enough of the known stop words."""
    return _stop_share(" ".join(b.text for b in found if not b.furniture)) >= KNOWN_LANGUAGE


def first_pass(block: Block, known: bool = True) -> int:
    """known: whether the page's language is one whose stop words are known."""
    if block.furniture:
        return BAD
    if not known and not block.in_article:  # other scripts say more in a letter
        return BAD if block.many_links else GOOD if len(block.text.encode()) > SHORT else OPEN
    if len(block.text) <= SHORT:
        return BAD if block.many_links and not block.in_article else OPEN
    stops = _stop_share(block.text)
    if block.in_article:
        return OPEN if block.many_links and stops >= FEW_STOPS else BAD if block.many_links else GOOD if stops >= ENOUGH_STOPS else OPEN
    return BAD if block.many_links or stops < FEW_STOPS else GOOD if stops >= ENOUGH_STOPS else OPEN


def mark_boxes(found: list[Block]) -> None:
    """In articles, makes texts that ask for consent furniture, and LINK_BOX and more short blocks of links that follow one
    another with the short heading above them."""
    link = [f.in_article and not f.furniture and len(f.text) <= SHORT and f.many_links and not f.heading for f in found]
    i = 0
    while i < len(found):
        end = i
        while end < len(found) and link[end]:
            end += 1
        if end - i >= LINK_BOX:
            above = i and found[i - 1].heading and found[i - 1].in_article and len(found[i - 1].text) <= SHORT
            for f in found[i - bool(above) : end]:
                f.furniture = True
        i = end + 1
    for f in found:
        f.furniture |= f.in_article and len(f.text) <= 4 * SHORT and bool(CONSENT.match(f.text))


def second_pass(labels: list[int], found: list[Block]) -> list[bool]:
    """An undecided block is good if the nearest decided block outside furniture, before or after it, is good; one inside an
    article asks the article's blocks only, and is good if none is decided."""

    def nearest(order) -> list[int]:
        seen, out = {True: OPEN, False: OPEN}, []
        for i in order:
            if labels[i] != OPEN and not found[i].furniture:
                seen[False] = labels[i]
                if found[i].in_article:
                    seen[True] = labels[i]
            out.append(seen[found[i].in_article])
        return out

    before = nearest(range(len(labels)))
    after = nearest(reversed(range(len(labels))))[::-1]
    return [x == GOOD or (x == OPEN and (GOOD in (b, a) or (f.in_article and b == a == OPEN))) for x, b, a, f in zip(labels, before, after, found, strict=True)]


def kept(found: list[Block]) -> list[bool]:
    mark_boxes(found)
    known = known_language(found)
    labels = [first_pass(b, known) for b in found]
    if all(b.furniture or (x == OPEN and not b.in_article) for x, b in zip(labels, found, strict=True)):
        return [not b.furniture for b in found]
    return second_pass(labels, found)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, k in zip(found, kept(found), strict=True) if k)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page has an empty text, as has one whose blocks are all bad. Pages are read whole and row by row, repeats
    alike, so there are no ties; a task holds one batch and a few times its longest page. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
