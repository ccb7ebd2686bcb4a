"""Operator 4: main text of web pages by two-pass block rules.

A page becomes a list of blocks with their length, link density and stop-word density. Only elements that can't be
text of an article are left out before the rules (``nav``, ``footer``, ``aside``, ``button``, ``script`` and the like, hidden
ones, and a ``header`` outside the article). They leave no trace: blocks before and behind them are neighbours, and a button
within a paragraph doesn't cut it. A ``form`` goes likewise, unless it holds most of the page's good text: then it is wrapped
around the page and is no form.

The first pass decides the clear blocks: long ones rich in stop words are good, link-dense ones bad. Within the article a
link-dense paragraph decides nothing and inherits like a short one; elsewhere it is good only between two good siblings. A page without a
good block takes the blocks of its richest container as good. In the second pass every other block (short, or poor in stop
words) inherits the label of its nearest decided neighbours: those in the smallest element around it that holds a
decided block; headings look ahead. Of a good and a bad one the nearer counts; of two as near, the good one if
it is a sibling.

Names in ``class`` and ``id`` are no rule of their own: readers' comments and adverts can be prose like the article's, so
blocks in an element that is named as such are left out like a form's. A name counts if all its words say so; that of a
paragraph or item within the article doesn't count against prose.

Pages are independent: each is read whole in the task that holds it, in time linear in its length, and nothing shuffles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import table

#: Frequent function words of four languages; a caller may pass others.
STOP_WORDS = frozenset(
    """the of and to in is it that was for on are as with his they at be this from have or by one had not but
    what all were when we there can an your which their if will each how about up out then she many some so
    der die das und ist nicht ein eine zu den von mit sich des auf für im dem auch es an als war wird bei aus
    nach wie noch oder nur über einer wenn sind ich er sie hat um zum zur
    le la les un une des et est que qui dans pour pas sur au avec il elle ce se ne du de en plus par sont
    mais comme ou nous vous leur ses son aux cette
    el los las una y en que por con para no se su del al lo como más pero sus le ya o este sí porque esta
    entre cuando muy sin sobre también""".split()
)
#: Characters under which a block is short.
LONG = 200
#: Stop-word density of a good block; link density of a bad one.
STOPS, LINKS = 0.2, 0.5

_ASIDE_TAGS = frozenset(
    "head title script style noscript template nav footer aside button select textarea iframe object svg menu dialog audio video canvas".split()
)
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name something beside the article, and words that may stand with them.
_ASIDE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr
    notice popup modal overlay newsletter subscribe subscription nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar
    footer masthead topbar social share sharing related recommended recommendations pagination pager comment comments
    disqus respond replies login signup searchbox copyright""".split()
)
_NEUTRAL_NAMES = frozenset(
    """area bar block box button buttons container content form header inner item items links list panel posts section slot text
    thread title unit user widget wrap wrapper""".split()
)
_MAIN_TAGS = frozenset(("article", "main"))
_BLOCK_TAGS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption
    legend option title""".split()
)
_LEAF_TAGS = frozenset("p li dd blockquote pre h1 h2 h3 h4 h5 h6".split())
_VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Contents of these are text up to their own end tag, whatever it looks like.
_RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW = {tag: re.compile(rf"</{tag}\b", re.I) for tag in _RAW_TAGS}
_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)|</[^>]*+>""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A block's text (white space joined), its link characters, its container and, in time, its label."""

    text: str
    link_chars: int
    heading: bool
    container: int
    label: str = ""


@dataclass
class Page:
    """Blocks in order, and of each container its parent (-1: none), first block, end, whether it is named as the
    article or as something beside it or is a form, and whether it is a paragraph or item within the article."""

    blocks: list[Block]
    parent: list[int]
    first: list[int]
    end: list[int]
    named: list[str]  # "main", "aside", "form" or ""
    leaf: list[bool]
    item: list[bool]  # of a list or table


def _aside_name(value: str) -> bool:
    """Whether one of the names in a class or id consists of words that name something beside the article."""
    for name in value.split():
        words = {w.lower() for w in _NAME.findall(name)}
        if words and not words.isdisjoint(_ASIDE_NAMES) and words <= _ASIDE_NAMES | _NEUTRAL_NAMES:
            return True
    return False


def _attributes(attributes: str) -> tuple[bool, str]:
    """(left out, name) by a start tag's attributes."""
    out, named = False, ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            if not named and _aside_name(value):
                named = "aside"
        elif name == "role":
            out |= value.lower() in _ASIDE_ROLES
            if value.lower() == "main":
                named = "main"
        elif name == "style":
            out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            out |= name == "hidden" or value.lower() == "true"
    return out, named


def parse(page: str) -> Page:
    """The page's blocks and containers."""
    blocks: list[Block] = []
    parent, first, ends, names, leaves, items = [-1], [0], [0], [""], [False], [False]
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, left out, in an article
    depth: dict[str, int] = {}  # open elements by tag
    pieces: list[tuple[str, bool]] = []
    link = 0
    heading = False

    def flush() -> None:
        nonlocal heading
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len("".join(html.unescape(p).split())) for p, in_link in pieces if in_link)
                blocks.append(Block(text, linked, heading, stack[-1][1]))
            pieces.clear()
        heading = False

    def pop() -> None:
        tag, own, _, _ = stack.pop()
        depth[tag] -= 1
        ends[own] = len(blocks)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not stack[-1][2]:
            pieces.append((text, link > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag in _BLOCK_TAGS
        if block:
            flush()
            link = 0
        if tag == "br" and not stack[-1][2]:
            pieces.append((" ", False))
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            if depth.get(tag):
                while stack[-1][0] != tag:
                    if not block and stack[-1][0] in _BLOCK_TAGS:
                        break  # an inline end tag closes no block
                    pop()
                else:
                    pop()
            continue
        if tag == "a":
            link += 1
        if tag in _VOID_TAGS or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if block and stack[-1][0] in ("p", *_HEADINGS) or tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack[-1][0] == tag:
            pop()  # a block ends an open paragraph, an item ends the item before it
        _, own, out_before, in_article = stack[-1]
        out, named = _attributes(m[3]) if m[3].strip() else (False, "")
        if tag in _MAIN_TAGS:
            named = "main"
        out |= tag in _ASIDE_TAGS or tag == "header" and not in_article
        if tag == "form" and named != "aside":
            named = "form"
        if tag in ("html", "body"):
            out, named = False, ""
        if block or out:
            parent.append(own)
            first.append(len(blocks))
            ends.append(len(blocks))
            names.append(named)
            leaves.append(in_article and tag in _LEAF_TAGS)
            items.append(tag in ("li", "dd", "td", "th"))
            stack.append((tag, len(parent) - 1, out_before or out, in_article or named == "main"))
            depth[tag] = depth.get(tag, 0) + 1
            heading = tag in _HEADINGS
        if tag in _RAW_TAGS:
            end = _RAW[tag].search(page, at)
            at = end.start() if end else len(page)
    flush()
    while len(stack) > 1:
        pop()
    ends[0] = len(blocks)
    return Page(blocks, parent, first, ends, names, leaves, items)


def _first_pass(block: Block, stop_words: frozenset[str]) -> str:
    if block.link_chars > LINKS * len(block.text.replace(" ", "")):
        return "linked"
    if len(block.text) < LONG or block.heading:
        return "short"
    words = _WORD.findall(block.text.lower())
    return "good" if sum(w in stop_words for w in words) >= STOPS * len(words) else "poor"


def _inherited(page: Page, k: int, left: int, right: int, around: int) -> str:
    """The label that block ``k`` takes from the decided blocks ``left`` and ``right`` of it within container ``around``."""
    near = [x for x in (left, right) if page.first[around] <= x < page.end[around]]
    if page.blocks[k].heading and right in near:
        return page.blocks[right].label
    if not near:
        return "bad"
    if len(near) == 1 or left + right != 2 * k:
        return page.blocks[min(near, key=lambda x: abs(x - k))].label
    above = page.parent[page.blocks[k].container]
    return "good" if any(page.blocks[x].label == "good" and page.parent[page.blocks[x].container] == above for x in near) else "bad"


def _names(page: Page) -> list[str]:
    """The name of each container: its own or that of its nearest named one around it (parents come first). A form that
    holds most of the good text, or of all text on a page without any, has no name of its own."""
    weigh = "good" if any(b.label == "good" and page.named[b.container] != "aside" for b in page.blocks) else ""
    sums = [0]
    for b in page.blocks:
        sums.append(sums[-1] + (len(b.text) if b.label == weigh or not weigh and b.label != "linked" else 0))
    named = list(page.named)
    for c in range(len(named)):
        around = named[page.parent[c]] if c else ""
        if named[c] == "form" and (around == "aside" or 2 * (sums[page.end[c]] - sums[page.first[c]]) > sums[-1]):
            named[c] = ""
        named[c] = named[c] or around
    return named


def classify(page: Page, stop_words: frozenset[str] = STOP_WORDS) -> list[Block]:
    """The blocks of the main text. Both passes; labels are left in the blocks."""
    blocks, parent = page.blocks, page.parent
    for b in blocks:
        b.label = _first_pass(b, stop_words)
    named = _names(page)
    for b in blocks:
        name = named[b.container]
        if name == "form" or name == "aside" and not (b.label == "good" and page.leaf[b.container] and named[parent[b.container]] != "aside"):
            b.label = "out"
        elif b.label == "linked" and name == "main" and not page.item[b.container]:
            b.label = "short"
    kept = [k for k, b in enumerate(blocks) if b.label != "out"]
    place = lambda k: parent[blocks[k].container]
    good = [b.label == "good" for b in blocks]
    for i, k in enumerate(kept):
        if blocks[k].label == "linked":
            sides = kept[i - 1 : i] + kept[i + 1 : i + 2] if i else []
            blocks[k].label = "good" if len(sides) == 2 and all(good[x] and place(x) == place(k) for x in sides) else "bad"
    if not any(b.label == "good" for b in blocks):
        richest = _richest(page, named)
        for b in blocks:
            if b.label in ("short", "poor") and b.container in richest:
                b.label = "good"
    decided = [k for k, b in enumerate(blocks) if b.label in ("good", "bad")]
    # of each container the smallest one around it, or itself, that holds a decided block
    around, at = [0] * len(parent), 0
    count = [0]
    for b in blocks:
        count.append(count[-1] + (b.label in ("good", "bad")))
    for c in range(1, len(parent)):
        around[c] = c if count[page.end[c]] > count[page.first[c]] else around[parent[c]]
    labels = []
    for k, b in enumerate(blocks):
        while at < len(decided) and decided[at] < k:
            at += 1
        if b.label in ("good", "bad", "out"):
            labels.append(b.label)
            continue
        left, right = decided[at - 1] if at else -1, decided[at] if at < len(decided) else len(blocks)
        labels.append(_inherited(page, k, left, right, around[b.container]))
    for b, label in zip(blocks, labels, strict=True):
        b.label = label
    return [b for b in blocks if b.label == "good" and b.text]


def _richest(page: Page, named: list[str]) -> set[int]:
    """The container, with all in it, that holds the most characters of undecided text directly or in its paragraphs;
    one that the page names as its article comes first, one that it names as something else last."""
    parent, size = page.parent, [0] * len(page.parent)
    for b in page.blocks:
        if b.label in ("short", "poor"):
            size[b.container] += len(b.text) - b.link_chars
            if parent[b.container] >= 0:
                size[parent[b.container]] += len(b.text) - b.link_chars
    rank = {"main": 2, "": 1, "aside": 0, "form": 0}
    best = max(range(len(size)), key=lambda c: (size[c] > 0, rank[named[c]], size[c], -c))
    inside = {best} if size[best] else set()
    for c in range(best + 1, len(parent)):
        if parent[c] in inside and named[c] not in ("aside", "form"):
            inside.add(c)
    return inside


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """Main text of one page: its good blocks in page order, an empty line between them."""
    return "\n\n".join(b.text for b in classify(parse(page), stop_words)) if page else ""


def extract(pages: DataFrame, html_col: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """All columns of ``pages`` but the html, and ``text`` and ``n_chars`` (code points).

    Null and empty pages, and pages without main text, have an empty text. Pages of any length are read
    whole; repeated rows are all returned; an empty table gives an empty result. A column of the input that
    is called ``text`` or ``n_chars`` gives way to the result's.
    """
    others = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars")]
    schema = T.StructType([*others, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py(), stop_words) for x in part.column(len(others))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(others)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    schema.fieldNames(),
                )

    return pages.select(*(F.col(f"`{f.name}`") for f in others), html_col).mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"))
