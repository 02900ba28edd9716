"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass weighs the evidence of each block: its length, its density
of stop words, its links, and where it stands (in or beside an article that holds most of the page's text, in elements
or under names of boilerplate). Blocks with clear evidence are good or bad; no article makes a block good by itself. The
rest stays ambiguous, and in the second pass inherits the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Limits of the first pass: characters of a short and of a long block, stop-word and link densities.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.15, 0.25, 0.33
GOOD, BAD, NEAR, BRIEF, WEAK = "good", "bad", "near", "brief", "weak"
#: No part of an article, and no neighbour to the blocks around it either.
OUT = "out"
#: Outside of articles because of a form, or of a header, only; an article's own header may hold its headings.
FORM, HEADER = "form", "header"
STRENGTH = {False: 0, FORM: 1, HEADER: 2, True: 3}
#: What a block stands in, and how much a character of each label counts when articles are weighed against the rest.
DOUBTFUL, MAIN, ARTICLE = -1, 1, 2
WEIGHT = {GOOD: 3, NEAR: 2, BRIEF: 1, WEAK: 1, BAD: 1}
#: Evidence against a block: many links, beside articles that hold the text, under a name of boilerplate, in such an element.
#: From CLEAR on a block is good, from -UNCLEAR down it is bad.
LINKED, BESIDE, NAMED, BOILERPLATE, CLEAR, UNCLEAR = 3, 3, 4, 6, 3, 2
#: Words of a page that are needed to tell its own frequent words, how many of them count, their length, and their densities.
OWN_WORDS, OWN_KINDS, OWN_LENGTH, OWN_LOW, OWN_HIGH = 100, 30, 4, 0.05, 0.12

#: Frequent function words (fixed values).
STOP_WORDS = {
    "en": "the of and a to in is was that it for on with as his he be at by i this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many must before back through years where much your way down should because long each just those people too",
    "de": "der die das und in zu den ist im nicht von mit sich des auf für als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ein eine wenn kann ihr diese dieser",
    "fr": "le la les de des du un une et en à que qui est dans il elle pour pas ce cette sur se ne par plus au aux avec son sa ses sont mais comme on ou nous vous leur être tout fait été même y deux dont",
    "es": "el la los las de del y en que a un una por con no se su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi",
}
STOPS = [frozenset(words.split()) for words in STOP_WORDS.values()]

#: Elements whose content is never text; that hold blocks; that begin a block; that are no part of an article (fixed values).
SILENT = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|button|title"
HOLDERS = frozenset("html body div section article main nav header footer aside form dialog figure fieldset details ul ol dl table tbody thead tr menu center blockquote address".split())
BREAKS = HOLDERS | frozenset("head p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption summary pre hr option legend label".split())
OUTSIDE = frozenset("nav header footer aside form dialog menu head fieldset".split())
#: Of these, the ones that some pages put around all they have.
FORMS = frozenset(("form", "fieldset"))
#: Names of a class, id or role that mark such elements, also put together with words that say nothing of the content.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside widget cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus respond reply pagination pager toolbar copyright "
    "disclaimer skip hidden complementary contentinfo search form".split()
)
FILLERS = frozenset(
    "js wp site page main global top bottom left right inner outer primary secondary wrap wrapper container box bar block area section group row col column list item items link links button buttons btn icon icons "
    "media slot unit google content text title label toggle panel posts articles article entry stories reading message policy to".split()
)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>|<(?P<silent>{SILENT})(?=[\s/>])[^>]*>.*?(?:</(?P=silent)(?=[\s/>])[^>]*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
MARKED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
UNSEEN = re.compile(r"""(?<![\w-])hidden(?=[\s/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
WORDS = re.compile(r"\w+")
#: Scripts written without spaces, whose characters say about as much as three letters.
DENSE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


@lru_cache(maxsize=10_000)
def is_mark(name: str) -> bool:
    """Whether a whole name marks an element: ``sidebar``, ``cookie-notice`` and ``share-buttons`` do, ``no-sidebar`` and
    ``category-social`` don't."""
    words = {part.lower() for part in PARTS.findall(name)}
    return not words.isdisjoint(MARKS) and words <= MARKS | FILLERS


def marked(attrs: str) -> bool:
    if not attrs or attrs.isspace():
        return False
    return any(is_mark(name) for a, b, c in MARKED.findall(attrs) for name in (a or b or c).split())


def unseen(attrs: str) -> bool:
    return bool(attrs) and bool(UNSEEN.search(attrs))


class Block:
    __slots__ = ("text", "linked", "inside", "outside", "marked", "heading", "length")

    def __init__(self, text, linked, inside, outside, marked, heading):
        self.text, self.linked, self.inside, self.outside, self.marked, self.heading = text, linked, inside, outside, marked, heading
        self.length = len(text) + 2 * len(DENSE.findall(text))

    @property
    def links(self) -> bool:
        return self.linked > LINKS * len(self.text)


def blocks(page: str) -> list[Block]:
    """Non-empty blocks in page order. Unclosed elements end where an element around them ends."""
    out: list[Block] = []
    stack = [("", 0, False, False)]  # holder, inside main or an article, outside of any, marked
    parts: list[str] = []
    linked, in_link, own, mine, heading, broken = 0, False, False, False, False, False
    at = 0

    def flush():
        nonlocal parts, linked, own, mine, heading
        text = " ".join("".join(parts).split())
        if text:
            _, inside, outside, mark = stack[-1]
            out.append(Block(text, linked, inside, True if own else False if heading and inside and outside == HEADER else outside, mark or mine, heading))
        parts, linked, own, mine, heading = [], 0, False, False, False

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = html.unescape(page[at : m.start()])
            parts.append(piece)
            if not piece.isspace():
                broken = False
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"] or m["close2"])
        if tag == "br":
            parts.append(" ")
            if broken:
                flush()
            broken = not broken
        elif tag == "a":
            in_link = not closing
        elif tag in BREAKS:
            flush()
            broken = in_link = False
            if tag in HOLDERS:
                if closing:
                    found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                    if found:
                        del stack[found:]
                elif not page.startswith("/>", m.end() - 2):
                    _, inside, outside, mark = stack[-1]
                    attrs = m["attrs"] or ""
                    if tag in ("article", "main"):
                        if not (hidden := tag == "article" and unseen(attrs)):
                            outside, mark = outside if any(t in OUTSIDE for t, *_ in stack) else False, False
                            if tag == "article" and marked(attrs):
                                inside = inside or DOUBTFUL
                            else:
                                inside = max(inside, ARTICLE if tag == "article" else MAIN)
                        stack.append((tag, inside, True if hidden else outside, mark))
                    elif tag in ("html", "body"):
                        stack.append((tag, inside, outside, mark))
                    else:
                        here = True if unseen(attrs) else FORM if tag in FORMS else HEADER if tag == HEADER else tag in OUTSIDE
                        stack.append((tag, inside, max(outside, here, key=STRENGTH.get), mark or marked(attrs)))
            elif not closing:
                attrs, heading = m["attrs"] or "", tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                own, mine = unseen(attrs), not heading and marked(attrs)
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    # A marked article is one where the page has no other, else like any element; its text stays.
    lone = not any(b.inside > 0 for b in out)
    for block in out:
        if block.inside == DOUBTFUL:
            block.inside = ARTICLE if lone else 0
    return out


def known_density(words: list[str]) -> float:
    return max(sum(w in stops for w in words) for stops in STOPS) / len(words)


def densities(found: list[Block]) -> list[int]:
    """What the stop words of each block say: 2, 1 or -2 for many, some and few; 0 where nothing can be told.

    Where less than a quarter of a page's longer text has stop words of the known languages, its own frequent short words
    take their place; a page of too few words, or without spaces between them, tells nothing.
    """
    words = [[w.lower() for w in WORDS.findall(b.text)] for b in found]
    is_longer = [b.length >= SHORT and not b.links and bool(w) for b, w in zip(found, words, strict=True)]
    longer = [w for w, x in zip(words, is_longer, strict=True) if x]
    total = sum(map(len, longer))
    if not total or 4 * sum(len(w) for w in longer if known_density(w) >= STOP_LOW) >= total:
        level = [known_density(w) if w else 0.0 for w in words]
        return [2 if d >= STOP_HIGH else 1 if d >= STOP_LOW else -2 for d in level]
    seen = Counter(w for block in longer for w in block if len(w) <= OWN_LENGTH and not w.isdigit())
    own = {w for w, n in seen.most_common(OWN_KINDS) if n > 1}
    level = [sum(w in own for w in block) / len(block) if block else 0.0 for block in words]
    if total < OWN_WORDS or sum(d * len(w) for d, w, x in zip(level, words, is_longer, strict=True) if x) < OWN_LOW * total:
        return [0] * len(found)
    return [2 if d >= OWN_HIGH else 1 if d >= OWN_LOW else -2 for d in level]


def content(block: Block, density: int) -> int:
    """The evidence of a block's own text: links, or else length and stop words. A short block has none."""
    if block.links:
        return -LINKED
    if block.length < SHORT:
        return 0
    size = 2 if block.length > LONG else 1
    return size + (density if density else size - 1)


def label(score: int) -> str:
    if score >= CLEAR:
        return GOOD
    if score <= -UNCLEAR:
        return BAD
    return NEAR if score > 0 else BRIEF if score == 0 else WEAK


def article_leads(found: list[Block], scores: list[int]) -> bool:
    """Whether articles hold most of the page's text, so that they are more than teasers."""
    held = {True: 0, False: 0}
    for block, score in zip(found, scores, strict=True):
        if not (block.outside or block.marked or block.links):
            held[block.inside > 0] += WEIGHT[label(score)] * len(block.text)
    return held[True] > 0 and held[True] >= held[False]


def first_pass(found: list[Block]) -> list[str]:
    """The label of each block; OUT for what stands within a leading article and is clearly none of it."""
    scores = [content(b, d) for b, d in zip(found, densities(found), strict=True)]
    leads = article_leads(found, scores)
    # A form or names around all the text of a page tell nothing, so they only count beside other text.
    plain = [b for b, x in zip(found, scores, strict=True) if b.outside in (False, FORM) and (x > 0 or (leads and b.inside > 0 and not b.links))]
    forms = any(not b.outside for b in plain)
    names = any(not b.marked for b in plain if not (forms and b.outside))
    out = []
    for block, score in zip(found, scores, strict=True):
        outside = block.outside in (True, HEADER) or (block.outside == FORM and forms)
        if outside:
            score -= BOILERPLATE
        if block.marked and names and not block.heading:
            score -= NAMED
        if leads:
            score += block.inside if block.inside > 0 else -BESIDE
        told = label(score)
        out.append(OUT if told == BAD and leads and block.inside > 0 and (outside or block.marked) else told)
    return out


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """Whether each block is kept. Ambiguous ones take the label that both nearest decided neighbours have; between a
    good and a bad one (or the page's end), near-good blocks are kept and weak ones dropped, headings go with what
    follows, the others with the nearer of the two, or the one before. Without any good block the near ones are kept."""
    before, gap = [], (BAD, len(labels) + 1)
    for x in labels:
        gap = (gap[0], gap[1] + 1)
        before.append(gap)
        if x in (GOOD, BAD):
            gap = (x, 0)
    after, gap = [], (BAD, len(labels) + 1)
    for x in reversed(labels):
        gap = (gap[0], gap[1] + 1)
        after.append(gap)
        if x in (GOOD, BAD):
            gap = (x, 0)
    keep = []
    for x, heading, (b, far_b), (a, far_a) in zip(labels, headings, before, reversed(after), strict=True):
        if x in (GOOD, BAD):
            keep.append(x == GOOD)
        elif a == b:
            keep.append(a == GOOD or (x == NEAR and GOOD not in labels))
        elif x in (NEAR, WEAK):
            keep.append(x == NEAR)
        elif heading:
            keep.append(a == GOOD)
        else:
            keep.append((b if far_b <= far_a else a) == GOOD)
    return keep


def extract(page: str | None) -> str:
    found = blocks(page or "")
    told = [(b, x) for b, x in zip(found, first_pass(found), strict=True) if x != OUT]
    keep = second_pass([x for _, x in told], [b.heading for b, _ in told])
    return "\n".join(b.text for (b, _), k in zip(told, keep, strict=True) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    A null or empty page, and one without article text, gives the empty text. Null ids and urls and repeated rows pass
    through; rows are independent; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
