"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides what it
can: blocks in navigation, header, footer, sidebar, notice, advert, form or comment
containers and blocks that are mostly links are boilerplate; blocks with enough
text and stop words, or headings inside an article, are content.  The second pass
gives every other (short or thin) block the label of its nearest decided
neighbour, where blocks of its own container come first; content wins ties.

Edge cases: null html counts as empty and gives an empty text; unclosed and
broken tags end with their container; a dropped element (script and style aside) that
is not closed before its container counts as a tag without content; repeated rows are extracted alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordquant.llm import textscan as S
from fjordquant.llm.common import fresh

# Common function words, block-level tags, container names.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can did do for from had has have he her his
how if in into is it its more no not of on one or other our out she so some such than that the their them
then there these they this to up was we were what when which who will with would you your
au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me mes mon ne nous
on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es
für hat ich ihr im in ist ja kann mich mit nach nicht noch nur oder sein sich sie sind so über um und uns
von vor war was wie wird zu zum zur
al como con de del el ella ellos en entre era es esta este fue ha hay la las lo los más mi muy no nos o para
pero por que se ser si sin sobre son su sus también te un una y ya
""".split())
BLOCK_TAGS = frozenset("""
address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol option
p pre section summary table tbody td tfoot th thead title tr ul
""".split())
DROPPED = "script style noscript template svg math iframe object canvas select textarea button head title audio video".split()
BAD_TAGS = frozenset("nav aside footer form menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adv|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|"
    r"masthead|footer|sidebar\w*|side|aside|widget\w*|cookie\w*|consent|notice\w*|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comment\w*|disqus|replies|"
    r"pagination|pager|toolbar|skip)(?=$|[\s_-])", re.I)
GOOD_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = "p"

SHORT_CHARS = 70
LINK_SHARE = 0.33
STOP_SHARE = 0.1

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
SPACE = re.compile(r"\s+")
END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in DROPPED}
RAW = frozenset("script style".split())                  # without an end tag, the rest of the page
FOREIGN = frozenset("svg math".split())                  # /> closes them
NESTING = frozenset("svg math object template".split())  # may hold themselves


@dataclass
class Block:
    text: str
    linked: int
    container: int   # number of the nearest sectioning element
    bad: bool        # inside a boilerplate container
    article: bool
    heading: bool


def boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "role" and value.lower() in BAD_ROLES:
            return True
        if name in ("class", "id") and BAD_NAMES.search(value):
            return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return bool(HIDDEN.search(VALUE.sub("= ", attributes)))


def end_of_dropped(page: str, at: int, tag: str, outer: set[str]) -> int | None:
    """Where the element opened before ``at`` ends; None if it is never closed.

    It is not closed if one of the ``outer`` elements around it ends before, or an
    element that cannot lie in its own kind opens again.
    """
    if not END_OF[tag].search(page, at):
        return None
    inner: dict[str, int] = {}
    while m := TOKEN.search(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if not name or name in VOID:
            continue
        if m[1]:
            if inner.get(name):
                inner[name] -= 1
            elif name == tag:
                return at
            elif name in outer:
                return None
        elif name in RAW:
            end = END_OF[name].search(page, at)
            if not end:
                return None
            at = end.end()
        elif not (name in FOREIGN and m[3].endswith("/")):
            if name == tag and tag not in NESTING:
                return None
            inner[name] = inner.get(name, 0) + 1
    return None


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; one pass over the tags with a stack of open ones."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, bad, in article, container
    bad, article, container, made, links = False, False, 0, 0, 0
    heading = False
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        nonlocal heading
        if parts:
            text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                chars = len(SPACE.sub(" ", html_lib.unescape("".join(linked))).strip())
                out.append(Block(text, chars, container, bad, article, heading))
            parts.clear()
            linked.clear()

    def restore() -> None:
        nonlocal bad, article, container
        bad, article, container = stack[-1][1:] if stack else (False, False, 0)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            parts.append(text)
            if links:
                linked.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if not closing and tag in END_OF:
            if tag in BLOCK_TAGS:
                close()
            if tag in RAW:
                end = END_OF[tag].search(page, at)
                at = end.end() if end else len(page)
            elif not (tag in FOREIGN and m[3].endswith("/")):
                at = end_of_dropped(page, at, tag, {s[0] for s in stack}) or at
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag == "a":
            links = 0 if closing else 1
        elif tag in HEADINGS:
            heading = not closing
        if tag in VOID or (not closing and m[3].endswith("/")):
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in BLOCK_TAGS:
                        links = 0
                    del stack[depth:]
                    restore()
                    break
            continue
        inside = article or tag in GOOD_TAGS
        is_bad = bad or boilerplate(tag, m[3], article)
        if tag in BLOCK_TAGS or is_bad != bad:
            if is_bad != bad:
                close()
            if tag == CLOSED_BY_BLOCK and stack and stack[-1][0] == tag:
                stack.pop()
                restore()
            if tag in ("article", "main", "section", "div", "aside", "nav", "footer", "header", "form"):
                made += 1
                container = made
            bad, article = is_bad, inside
            stack.append((tag, bad, article, container))
    close()
    return out


def first_pass(block: Block) -> bool | None:
    """True for content, False for boilerplate, None where undecided."""
    n = len(block.text)
    if block.bad:
        return False
    if block.linked > LINK_SHARE * n:
        return None if block.article else False
    if block.article and block.heading:
        return True
    if n < SHORT_CHARS:
        return None
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()«»") in STOP_WORDS for w in words)
    if stops >= STOP_SHARE * len(words):
        return True
    return None if block.article else False


def extract(page: str) -> str:
    blocks = blocks_of(page)
    labels = [first_pass(b) for b in blocks]
    n = len(blocks)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    last: int | None = None
    for i in range(n):
        before[i] = last
        last = i if labels[i] is not None else last
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] is not None else last
    kept = []
    for i, b in enumerate(blocks):
        label = labels[i]
        if label is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            ranked = sorted((blocks[j].container != b.container, blocks[j].article != b.article,
                             abs(j - i), not labels[j]) for j in near)
            label = not ranked[0][3] if ranked else b.article
            if b.article and not any(labels[j] and blocks[j].article for j in near):
                label = True  # an article of short blocks only
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def main_text(df: DataFrame, html: str, name: str = "text") -> DataFrame:
    """Attach the main text of the ``html`` column; the html itself is dropped."""
    inner = fresh(df, "_html")[0]
    kept = [c for c in df.columns if c not in (html, name)]
    source = df.select(*kept, F.coalesce(F.col(html), F.lit("")).alias(inner))
    schema = source.drop(inner).schema.add(name, "string")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, inner):
            texts = [extract(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names)

    return source.mapInArrow(run, schema)
