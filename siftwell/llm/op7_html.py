"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass judges each block by
stop-word density, length and link density.  Where it stands is evidence: menus, forms,
asides, footers and what is plainly named as advert, comments and the like
are out; inside ``article`` or ``main`` a block is never out for being short, terse
or linked; a name that only hints at such a part (``related-work``, ``login-issues``)
makes a block ambiguous unless it reads as prose.  Short blocks and those of middling density
stay ambiguous.  In the second pass each of these takes the label of its
nearest decided neighbours, in an article those of the same article; where they differ, the nearer one counts, and at equal distance a
block of middling density is kept and a short one is not.  Without any
decided block, in the article or on the page, all ambiguous ones are kept.

Character references are decoded, white space inside a block becomes one space,
and blocks are joined in page order by one space.  Nothing is capped.

The scan is one pass: its time grows with the length of the page, also for unclosed tags and quotes.

Defined results: a null or empty page has an empty text; unknown tags are
tolerated, a tag that never ends is text; an unclosed ``script`` or ``style`` takes the rest of the page, any other
unclosed tag or comment loses no text; rows keep null ids and urls;
repeated pages give repeated rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_ready, steps

# Element names of HTML and frequent words of four languages.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
DROPPED_TAGS = frozenset("script style noscript template svg math iframe object canvas textarea select title head".split())
BAD_TAGS = frozenset("nav aside footer form menu button dialog".split())
GOOD_TAGS = frozenset("article main".split())
STACKED_TAGS = BAD_TAGS | GOOD_TAGS | frozenset("div section header ul ol table details figure body".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus dropdown footer header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice pagination pager popup promo promoted related reply replies share sharing shares sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht oder sein sich sie sind so und um von war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur mais ne nous ont ou par pas plus pour qui que sa se ses son sont sur un une vous "
    "al como con del el ella en entre es esta este fue ha la las lo los más no o para pero por que se sin sobre su sus un una y ya".split()
)

SHORT = 70
DENSE, MIDDLING = 0.30, 0.12
LINKS = 0.5
#: Open containers among which an end tag seeks its start.
DEEPEST = 500

#: Words that beside a bad name leave it plain: ``comments-section`` is one, ``comments-policy`` only hints.
PLAIN_PARTS = frozenset("area bar block bottom box btn button buttons container content div fixed float form global group heading inner item items left link links list mini module outer page panel primary right row section secondary site sticky sub thread title top ul unit wrap wrapper zone".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"""[<>"']""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_EDGE = re.compile(r"^\W+|\W+$")


def _named(attributes: str) -> int:
    """What the names in a tag say: -1 plainly not main text, 1 a hint at that, 0 nothing."""
    if not attributes:
        return 0
    hint = 0
    for name, value in _NAMES.findall(attributes):
        bad = BAD_ROLES if name.lower() == "role" else BAD_NAMES
        for token in value.strip("\"'").lower().split():
            parts = [p for p in _PART.split(token) if p]
            if not bad.isdisjoint(parts):
                if all(p in bad or p in PLAIN_PARTS or p.isdigit() for p in parts):
                    return -1
                hint = 1
    return -1 if _HIDDEN.search(attributes) else hint


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``: its ``>`` outside quotes, or if there is none before the next ``<`` the first one."""
    here = at
    while m := _MARK.search(page, here):
        if m[0] == ">":
            return m.start()
        close = -1 if m[0] == "<" else page.find(m[0], m.end())
        if close < 0:
            break
        here = close + 1
    return page.find(">", at)


class Block(NamedTuple):
    """A block's text, how many of its characters are in links, where it stands (1 in an article, -1 outside, 0 unknown), the
    number of its article and whether a name hints that it isn't main text."""

    text: str
    linked: int
    place: int
    article: int = 0
    hinted: bool = False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []
    part: list[str] = []
    linked, in_link, at, articles = 0, False, 0, 0
    place, article, hinted = 0, 0, False
    no_end: set[str] = set()  # tags that are not closed any more

    def flush() -> None:
        nonlocal part, linked
        if part:
            text = " ".join(html_lib.unescape("".join(part)).split())
            if text:
                found.append(Block(text, linked, place, article, hinted))
        part, linked = [], 0

    size, last = len(page), page.rfind(">")
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            piece = page[at:begin]
            part.append(piece)
            if in_link:
                linked += len(piece)
        if begin == size:
            break
        if page.startswith("<!--", begin) and "!" not in no_end:
            end = page.find("-->", begin + 4)
            if end >= 0:
                at = end + 3
                continue
            no_end.add("!")
        m = _OPEN.match(page, begin)
        if begin > last or not (m or page[begin + 1 : begin + 2] in ("!", "?")):
            part.append("<")
            at = begin + 1
            continue
        if not m:
            at = (begin + 4 if page.startswith("<!--", begin) else page.find(">", begin) + 1)
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            part.append("<")
            at = begin + 1
            continue
        attributes, at = page[m.end() : end], end + 1
        tag = m[2].lower()
        if not m[1] and tag in DROPPED_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            if not attributes.rstrip().endswith("/") and tag not in no_end:
                close = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|<body\b", re.I).search(page, at)
                if close:
                    at = close.start() if close[0].lower().startswith("<body") else close.end()
                elif tag in ("script", "style"):
                    at = size
                else:
                    no_end.add(tag)
            continue
        if tag == "a":
            in_link = not m[1]
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if tag in STACKED_TAGS:
            if m[1]:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                in_link = False
            elif not attributes.endswith("/"):
                _, place, article, hinted = stack[-1] if stack else ("", 0, 0, False)
                name = 0 if tag == "body" or place < 0 else _named(attributes)
                if place < 0 or name < 0 or tag in BAD_TAGS or tag == "header" and place == 0:
                    place = -1
                elif tag in GOOD_TAGS:
                    if not place:
                        articles += 1
                        article = articles
                    place = 1
                stack.append((tag, place, article, hinted or name > 0))
            _, place, article, hinted = stack[-1] if stack else ("", 0, 0, False)
    flush()
    return found


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(_EDGE.sub("", w) in STOP_WORDS for w in words) / len(words)


def decide(found: list[Block]) -> list[bool]:
    """Which blocks belong to the main text."""
    labels: list[int | None] = []
    middling: set[int] = set()
    for k, b in enumerate(found):
        size = len(b.text)
        if b.place < 0:
            labels.append(-1)
            continue
        links = b.linked > LINKS * size
        density = 0.0 if size < SHORT or links else stop_density(b.text)
        if density >= DENSE:
            labels.append(1)
        elif b.place > 0:
            labels.append(None)
        elif links:
            labels.append(-1)
        else:
            if size >= SHORT:
                middling.add(k)
            labels.append(None if density >= MIDDLING or size < 3 * SHORT or b.hinted else -1)
    decided = [k for k, label in enumerate(labels) if label is not None]
    kept, before = [], -1
    for k, label in enumerate(labels):
        if label is not None:
            before += 1
        elif found[k].place > 0:
            label = 1  # by its decided neighbours in the article, which are all in, or for want of any
        elif not decided:
            label = 1
        else:
            left = decided[before] if before >= 0 else None
            right = decided[before + 1] if before + 1 < len(decided) else None
            if left is None or right is None or labels[left] == labels[right]:
                label = labels[right if left is None else left]
            elif k - left != right - k:
                label = labels[left if k - left < right - k else right]
            else:
                label = 1 if k in middling else -1
        kept.append(label > 0)
    return kept


def main_text(page: str | None) -> str:
    """The page's main text."""
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, decide(found)) if keep)


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of each page."""
    arrow_ready(pages.sparkSession)
    n = len(keep)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html__"):
            texts = [main_text(p) for p in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html).alias("html__")).mapInArrow(extract, f"{kinds}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLE: dict[str, str] = {}
