"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels each block: blocks in navigation,
forms, adverts, comments and the like are boilerplate by their element or name; all others, in an article or not, are
judged by link density, length and stop-word density. In the second pass, blocks too short to judge take the
label of their nearest decided neighbour, and middling ones are text beside text.

An article element is evidence, not a verdict: few stop words don't condemn a block in one, and what stands outside
counts only if it holds several times the article's text, which then is a teaser.

What a form or a class name says is doubted: a form around an article says nothing, and a form without
one, or an article in an element with a name of boilerplate, counts as text if it holds more text than
all else that would be kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""", re.S)
ATTR = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {t: re.compile(rf"</{t}\s*+[^>]*+>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER = frozenset("nav header footer aside form button select option datalist dialog menu svg math object canvas audio video map head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole class and id names that mark boilerplate, and those that mark content (fixed values). Parts of names say little: has-sidebar, comments-open.
BOILER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus related recommended widget toolbar pagination pager copyright legal disclaimer site-header page-header site-footer page-footer main-nav site-nav top-nav nav-menu main-menu main-navigation site-navigation cookie-banner cookie-notice cookie-consent ad-slot ad-container ad-wrapper ad-banner google-ad adsbygoogle social-share share-buttons social-links related-posts related-articles newsletter-signup sidebar-widget widget-area".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus comment-list commentlist comments-area comments-section comment-body comment-form comment-respond disqus-thread".split())
CONTENT_NAMES = frozenset("article main content post entry story text".split())
#: Nouns that mark boilerplate at either end of a compound name, and words that make a compound say something about its surroundings instead (fixed values).
BOILER_NOUNS = frozenset("ad ads advert advertisement sponsor sponsored promo cookie cookies consent gdpr newsletter related recommended share sharing social popup modal breadcrumb breadcrumbs pagination".split())
COMMENT_NOUNS = frozenset("comment comments disqus replies".split())
STATE_WORDS = frozenset("has no is not with without open closed enabled disabled active free layout page single template body wrapper container-fluid post article content".split())
#: Frequent function words of some European languages (fixed values).
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each how them then she many some so these would into has more her two him see no could my than been who its now did get may "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "le la les de des et un une du en que qui dans pour pas sur ce il au avec plus par je ne se est son sont aux mais comme ou si leur y dont elle deux ces sans nous vous tout fait être cette "
    "el los las y del se por con no su para al lo como o pero sus le ha me sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos "
    "il di che è e per una sono non si da come più ma anche nel della alla dei os as um uma com não na mais dos foi ao ele das à seu het een van ik te dat niet zijn op aan met voor er maar om hem dan zou wat".split()
)
WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"
#: How many times an article's text what stands outside it must hold to make it a teaser.
TEASER = 4
MAX_LINKS, SHORT_CHARS, LONG_CHARS, STOP_LOW, STOP_HIGH = 0.5, 70, 200, 0.2, 0.3
#: The stop words fit a page's language if blocks with so large a share of its longer blocks' characters reach STOP_LOW.
FIT_SHARE = 0.25
#: What an element says about its content; boilerplate by form, name, comment name or element, the surest last.
ARTICLE, NOTHING, FORM, NAME, COMMENT, ELEMENT = -1, 0, 1, 2, 3, 4
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Block:
    __slots__ = ("parts", "links", "article", "boiler", "heading", "doubt", "text", "label", "rule", "apart")

    def __init__(self, article: bool, boiler: int, heading: bool, doubt: int):
        self.parts: list[str] = []
        self.links, self.article, self.boiler, self.heading, self.doubt = 0, article, boiler, heading, doubt
        self.rule, self.apart = "", False


def _ends(names: set[str], nouns: frozenset[str]) -> bool:
    """Whether a compound name begins or ends with one of the nouns and says nothing about a state."""
    parts = [n.split("-") for n in names if "-" in n]
    return any((p[0] in nouns or p[-1] in nouns) and not STATE_WORDS.intersection(p) for p in parts)


def _role(tag: str, attrs: str) -> int:
    """What an element says about its content."""
    names: set[str] = set()
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names.update(value.replace("_", "-").split())
        elif name == "role" and value in ROLES or name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return ELEMENT
    if tag == "main" or tag == "article" and (names & CONTENT_NAMES or not names & COMMENT_NAMES):
        return ARTICLE
    if tag in ("body", "html"):
        return NOTHING
    if tag in BOILER and tag != "form":
        return ELEMENT
    if names & COMMENT_NAMES or _ends(names, COMMENT_NOUNS):
        return COMMENT
    if (names & BOILER_NAMES or _ends(names, BOILER_NOUNS)) and not names & CONTENT_NAMES:
        return NAME
    return FORM if tag == "form" else NOTHING


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what their elements say."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, bool, int]] = []  # tag, article, boilerplate, link, heading, number of the doubted element
    start = state = (False, NOTHING, False, False, 0)
    doubts = 0
    current: Block | None = None
    breaks, at, n = 0, 0, len(page)

    def say(s: str) -> None:
        nonlocal current, breaks
        if not s:
            return
        if current is None:
            if s.isspace():
                return
            article, boiler, _, heading, doubt = state
            current = Block(article, boiler, heading, doubt)
            out.append(current)
        if "&" in s:
            s = html.unescape(s)
        current.parts.append(s)
        if state[2]:
            current.links += len("".join(s.split()))
        if not s.isspace():
            breaks = 0

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:  # an end tag: back to the element that it closes, if there is one
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    state = stack[-1][1:] if stack else start
                    break
            if tag in BLOCK:
                current = None
            continue
        attrs = m[4] or m[7] or ""
        if tag == "br":
            breaks += 1
            if breaks > 1:
                current = None
            elif current is not None:
                current.parts.append(" ")
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            current = None
            # an open paragraph ends where a block begins, an open item where the next begins
            for i in range(len(stack) - 1, -1, -1):
                open_ = stack[i][0]
                if open_ in CLOSES and tag in CLOSES[open_]:
                    del stack[i:]
                    state = stack[-1][1:] if stack else start
                    break
                if open_ in BLOCK:
                    break
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        article, boiler, link, heading, doubt = state
        role = _role(tag, attrs) if attrs or tag in BOILER or tag in ("article", "main") else NOTHING
        if role == ARTICLE:
            # navigation or a page header left open doesn't hold the article, and a form around it says nothing; main is never a part of a comment
            holds = [x[2] for x in stack if x[0] not in ("nav", "header")]
            if boiler and max(holds, default=NOTHING) <= (COMMENT if tag == "main" else FORM):
                boiler, doubt = NOTHING, 0
            elif boiler and max(holds) == NAME and not (article and doubt):
                doubts += 1
                doubt = doubts
            article = True
        elif role:
            if role == FORM and not boiler and not article:
                doubts += 1
                doubt = doubts
            elif role > FORM or boiler != FORM:
                doubt = 0
            boiler = max(boiler, role)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = True
            if article and boiler:
                # the title in an article's own header
                around = next((x for x in reversed(stack) if x[0] != "header"), None)
                if around is None or not around[2] or around[5]:
                    boiler, doubt = (around[2], around[5]) if around else (NOTHING, 0)
        state = (article, boiler, link or tag == "a", heading, doubt)
        stack.append((tag, *state))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def first_pass(found: list[Block]) -> None:
    """Labels by element and name, then by links, length and stop words; ``rule`` says which of these decided."""
    long: list[tuple[Block, bool, float]] = []
    for b in found:
        chars = len(b.text.replace(" ", ""))
        linked = b.links / max(1, chars)
        b.apart = False
        if b.boiler:
            b.label, b.rule = BAD, "element" if b.boiler == ELEMENT else "name"
        elif linked > MAX_LINKS and not b.heading:
            b.label, b.rule, b.apart = BAD, "links", b.article  # links in an article say nothing about the text beside them
        elif len(b.text) < SHORT_CHARS:
            b.label, b.rule = (BAD, "links") if b.links and not b.article and not b.heading else (SHORT, "length")
        else:
            words = WORD.findall(b.text.lower())
            stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            latin = b.text.isascii() or sum(c < "ɐ" for c in b.text) > len(b.text) / 2
            long.append((b, latin, stop))
    in_latin = sum(len(b.text) for b, latin, _ in long if latin)
    fits = sum(len(b.text) for b, latin, stop in long if latin and stop >= STOP_LOW) >= FIT_SHARE * in_latin
    for b, latin, stop in long:
        # the stop words say nothing about other scripts and languages
        if not latin or not fits or stop >= STOP_HIGH:
            b.label = GOOD if b.article or len(b.text) > LONG_CHARS else NEAR
        else:
            b.label = NEAR if stop >= STOP_LOW or b.article else BAD
        b.rule = "stop words" if latin and fits else "length"
    if not any(b.label == GOOD for b in found):  # a page of middling blocks: the likeliest are its text
        for b, latin, stop in long:
            if b.label == NEAR and (not latin or not fits or stop >= STOP_HIGH):
                b.label = GOOD
    inside = sum(len(b.text) for b in found if b.article and b.label != BAD)
    outside = sum(len(b.text) for b in found if not b.article and b.label == GOOD)
    if inside:
        for b in found:
            if not b.boiler and b.article == (outside > TEASER * inside):
                b.label, b.rule, b.apart = BAD, "article", True


def second_pass(found: list[Block]) -> None:
    """Undecided blocks by their decided neighbours, those judged by their text: short ones take the nearest's label (headings look
    ahead), middling ones are text if either is; with no neighbour they stay."""
    n = len(found)
    before, after = [-1] * n, [-1] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = -1
        for i in order:
            near[i] = last
            if found[i].label in (GOOD, BAD) and not found[i].boiler and not found[i].apart:
                last = i
    decided = [b.label for b in found]
    for i, b in enumerate(found):
        if decided[i] in (GOOD, BAD):
            continue
        b.rule = "neighbour"
        p, q = before[i], after[i]
        if p < 0 and q < 0:
            b.label = GOOD
        elif decided[i] == NEAR:
            b.label = GOOD if GOOD in (decided[p] if p >= 0 else "", decided[q] if q >= 0 else "") else BAD
        elif p < 0 or q < 0:
            b.label = decided[max(p, q)]
        elif b.heading or q - i < i - p:
            b.label = decided[q]
        elif i - p < q - i or decided[p] == decided[q]:
            b.label = decided[p]
        else:
            b.label = BAD


def settle(found: list[Block]) -> None:
    """Both passes, and the doubted elements that hold more than all else that is kept."""
    first_pass(found)
    second_pass(found)
    doubted: dict[int, list[Block]] = {}
    for b in found:
        if b.doubt:
            doubted.setdefault(b.doubt, []).append(b)
    if not doubted:
        return
    kept = sum(len(b.text) for b in found if b.label == GOOD)
    for article in (True, False):
        parts = [x for x in doubted.values() if x[0].article == article]
        if not parts or not article and any(b.article and not b.boiler for b in found):
            continue
        verdict = parts[0][0].boiler
        for b in (b for x in parts for b in x):
            b.boiler = NOTHING
        first_pass(found)
        for part in parts:
            if sum(len(b.text) for b in part if b.label in (GOOD, NEAR)) <= kept:
                for b in part:
                    b.boiler = verdict
    first_pass(found)
    second_pass(found)


def main_text(page: str) -> tuple[str, int]:
    """The main text, kept blocks joined by newlines, and the number of blocks of the page."""
    found = blocks(page)
    settle(found)
    return "\n".join(b.text for b in found if b.label == GOOD), len(found)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows with ``text``, ``n_chars`` (code points) and ``n_blocks`` added.

    Null html counts as empty; a page without main text gets an empty string. Nothing is cut. Input
    columns of those names are replaced, should ``html_col`` be one of them after it was read.
    """
    own = [c for c in pages.columns if c not in ("text", "n_chars", "n_blocks")]
    df = pages.select(*own, text_of(F.col(html_col)).alias("__he_html"))
    schema = df.drop("__he_html").select(*own, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_blocks")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema).select(*own, "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
