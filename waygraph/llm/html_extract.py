"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by where they stand
(menus, page headers, footers and sidebars are out; so are notices, adverts, forms and reader comments by their class words,
unless they hold most of the page's text), by link density, by length and by stop-word density. Short blocks that this
leaves open then inherit the label of the nearest decided neighbours in the second pass. An article speaks for its blocks
where it holds most of the text.

Defined results: null or empty html gives an empty text; a page without a closing tag, with stray
'<' or with unclosed quotes is read as far as it goes; a very long page is one row like others; equal rows give equal rows; an empty table
gives an empty table. ``extract_pages`` keeps all columns but the html and those of its own names, which it replaces.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_struct

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|math|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
      | <(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)
      | <[!?/][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""([a-zA-Z_:@][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of an article.
OUT_TAGS = frozenset("nav footer aside button select dialog menu object audio video canvas map search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class and id values that mark what is not the article, unless most of the page's text lies in it.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar side menu nav"
    " navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended comment comments commentlist disqus replies respond footer"
    " masthead widget pagination pager toolbar skip topbar copyright disclaimer paywall".split()
)
#: Readers' texts may be longer than the article: marked by these, an element needs a title or the article in it to count as the page.
READER_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: A name of several parts with one of these is a phrase (notice-of-intent, side-by-side): only its last part says what it is.
_PHRASE = frozenset("and as at by for from in of on or the to with".split())
#: Blocks of exactly these words are labels of the page, not text of the article.
LABELS = frozenset(
    {"advertisement", "advertisements", "sponsored", "sponsored content", "read more", "continue reading", "share this", "share this article", "back to top", "skip to content"}
)
_NAME_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Frequent function words (fixed values).
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were what which who will with you".split(),
    "fr": "a au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer es für hat ich im in ist mit nach nicht sich sie sind so und von war wie wird zu zum zur".split(),
    "es": "a al como con de del el ella en es esta este ha la las lo los más me mi no o para pero por que se si sin son su sus un una y ya".split(),
}
_STOPS = {lang: frozenset(words) for lang, words in STOP_WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Rules:
    """Thresholds of the first pass; lengths in characters, densities from 0 to 1."""

    max_link_density: float = 0.5
    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.30


@dataclass
class Doubt:
    """An element that is out by a class word or as a form, if it does not hold most of the page's text."""

    readers: bool
    titled: bool = False  # holds a title or the article
    weight: int = 0


@dataclass
class Block:
    tag: str
    out: bool  # by its place in the page
    inside: int  # 2 in an article, 1 in the main part, 0 elsewhere
    doubts: tuple[Doubt, ...] = ()  # the elements around it that a class word or a form speaks against
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: str = ""


def _marks(value: str) -> set[str]:
    """The words of a class or id value that say what the element is."""
    found: set[str] = set()
    for token in value.split():
        parts = _NAME_PART.findall(_CAMEL.sub(" ", token).lower())
        phrase = len(parts) > 2 and not _PHRASE.isdisjoint(parts)
        if not (phrase and parts[-1] == parts[0]):  # side-by-side
            found.update(parts[-1:] if phrase else parts)
    return found


def _is_out(name: str, attrs: str, inside: int) -> tuple[bool, Doubt | None]:
    """Whether an element is out for certain, and the doubt that its name or class raises."""
    if name in OUT_TAGS or name == "header" and not inside:
        return True, None
    doubt = Doubt(False) if name == "form" else None
    if not attrs or attrs.isspace():
        return False, doubt
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            parts = _marks(value)
            if name not in ("html", "body", "article", "main") and not OUT_WORDS.isdisjoint(parts) or (
                name == "article" and not {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo", "related"}.isdisjoint(parts)
            ):
                doubt = Doubt(not READER_WORDS.isdisjoint(parts) or doubt is not None and doubt.readers)
        elif key == "role":
            if value.lower() in OUT_ROLES:
                return True, None
            if value.lower() == "form":
                doubt = doubt or Doubt(False)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, None
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, None
    return False, doubt


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of a page, in page order."""
    found: list[Block] = []
    # open elements: name, whether it is out, how far inside, the doubts around it
    stack: list[tuple[str, bool, int, tuple[Doubt, ...]]] = []
    block: Block | None = None
    links = breaks = at = 0

    def end() -> None:
        nonlocal block, breaks
        if block is not None:
            found.append(block)
        block, breaks = None, 0

    def put(text: str) -> None:
        nonlocal block, breaks
        if not text:
            return
        if block is None:
            if text.isspace():
                return
            tag = next((n for n, *_ in reversed(stack) if n in BLOCK), "body")
            block = Block(tag, *(stack[-1][1:] if stack else (False, 0, ())))
        if not text.isspace():
            breaks = 0
        block.parts.append(text)
        if links:
            block.link_chars += len(text.strip())

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m["raw"] and m["raw"].lower() in ("textarea",):
                end()
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if name in BLOCK:
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    links -= sum(n == "a" for n, *_ in stack[k:])
                    del stack[k:]
                    break
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name == "br":
            breaks += 1
            if breaks > 1:
                end()
            put(" ") if block is not None else None
            continue
        if name in BLOCK:
            end()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in ("a", "b", "i", "em", "strong", "span", "u", "font") and any(n == "p" for n, *_ in stack[-6:])) and name not in ("option",):
                links -= stack[-1][0] == "a"
                stack.pop()
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
        elif name == "img":
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name != "a":
            continue
        out, inside, doubts = stack[-1][1:] if stack else (False, 0, ())
        if name in ("h1", "article", "main"):
            for d in doubts:
                d.titled = True
        if not out:
            out, doubt = _is_out(name, attrs, inside)
            if doubt:
                doubts = (*doubts, doubt)
        if name == "article":
            inside = 2
        elif name == "main" or "main" in attrs and re.search(r"role\s*=\s*[\"']?main", attrs, re.I):
            inside = max(inside, 1)
        stack.append((name, out, inside, doubts))
        links += name == "a"
    if at < len(page):
        put(page[at:])
    end()
    kept = []
    for b in found:
        b.text = " ".join(_html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def stop_density(text: str) -> float:
    """The share of the block's words that are function words, in the language that fits best."""
    words = _WORD.findall(text.lower())
    return max(sum(w in s for w in words) for s in _STOPS.values()) / len(words) if words else 0.0


def _density(b: Block) -> float:
    return b.link_chars / max(1, len(b.text))


def _settle(blocks: list[Block], rules: Rules) -> int:
    """Puts out what doubts speak against and gives the container's level: neither a class word, nor a form, nor a
    container may speak against most of the page's text with few links (a little more on a page of few words is not a story)."""
    likely = [(b, len(b.text)) for b in blocks if not b.out and _density(b) <= rules.max_link_density]
    total = sum(n for _, n in likely)
    for b, n in likely:
        for d in b.doubts:
            d.weight += n
    for b in blocks:
        b.out = b.out or any(2 * d.weight <= total or d.weight <= rules.long and d.weight < total or d.readers and not d.titled for d in b.doubts)
    likely = [(b, n) for b, n in likely if not b.out]
    total = sum(n for _, n in likely)
    levels = {b.inside for b in blocks if not b.out}
    held = {k: sum(n for b, n in likely if b.inside >= k) for k in (2, 1)}
    return next((k for k in (2, 1) if any(x >= k for x in levels) and (2 * held[k] >= total or total - held[k] <= rules.long)), 0)


def classify(blocks: list[Block], rules: Rules = Rules()) -> None:
    """Labels each block good or bad."""
    container = _settle(blocks, rules)
    usable = [b for b in blocks if not b.out]
    stops = {id(b): stop_density(b.text) for b in usable if len(b.text) >= rules.short and _density(b) <= rules.max_link_density}
    long = sum(len(b.text) for b in usable if id(b) in stops)
    # a language without a list of stop words: only length and links count
    unlisted = sum(stops[id(b)] * len(b.text) for b in usable if id(b) in stops) < rules.stop_low * long
    within = []
    for b in blocks:
        inner = bool(container) and b.inside >= container
        if b.out:
            b.label = "bad"
            continue
        if inner:
            within.append(b)
        elif container:  # beside the article only what is text beyond doubt
            b.label = "good" if len(b.text) > rules.long and id(b) in stops and (unlisted or stops[id(b)] >= rules.stop_high) else "bad"
            continue
        if b.text.strip(" .:…!").casefold() in LABELS:
            b.label = "bad"
        elif _density(b) > rules.max_link_density:
            b.label = "open" if inner and b.tag in HEADINGS else "bad"
        elif len(b.text) < rules.short:
            b.label = "open"
        elif unlisted or stops[id(b)] >= rules.stop_high:
            b.label = "good"
        elif stops[id(b)] >= rules.stop_low:
            b.label = "good" if inner or len(b.text) > rules.long else "open"
        else:
            b.label = "open" if inner else "bad"
    if container:
        _inherit_within(within)
    else:
        _inherit(blocks)


def _neighbours(blocks: list[Block]) -> list[tuple[int | None, int | None]]:
    """The nearest decided blocks before and after each."""
    before, left = [], None
    for k, b in enumerate(blocks):
        before.append(left)
        if b.label != "open":
            left = k
    after, right = [], None
    for k in range(len(blocks) - 1, -1, -1):
        after.append(right)
        if blocks[k].label != "open":
            right = k
    return list(zip(before, after[::-1]))


def _inherit_within(blocks: list[Block]) -> None:
    """Pass two in an article, which speaks for its blocks: open ones are bad only between two bad ones, headings
    only over nothing but bad ones. What stands outside of the article says nothing about them."""
    told = any(b.label == "good" for b in blocks)
    body = [b for b in blocks if b.tag not in HEADINGS or b.label != "open"]
    labels = ["bad" if told and None not in near and {body[j].label for j in near} == {"bad"} else "good" for near in _neighbours(body)]
    for b, label in zip(body, labels):
        if b.label == "open":
            b.label = label
    good = some = False
    for b in reversed(blocks):
        if b.tag not in HEADINGS:
            good, some = good or b.label == "good", True
        else:
            if b.label == "open":
                b.label = "bad" if told and some and not good and b.tag != "h1" else "good"
            good = some = False


def _inherit(blocks: list[Block]) -> None:
    """Pass two in a page without an article: open blocks take the label of the nearest decided one."""
    near = _neighbours(blocks)
    labels = {}
    for k, b in enumerate(blocks):
        if b.label != "open":
            continue
        decided = [j for j in near[k] if j is not None]
        if not decided:
            labels[k] = "good"  # nothing speaks against it
        elif b.tag in HEADINGS and near[k][1] is not None:
            labels[k] = blocks[near[k][1]].label
        else:
            labels[k] = blocks[min(decided, key=lambda j: (abs(j - k), blocks[j].label != "good"))].label
    for k, label in labels.items():
        blocks[k].label = label


def main_text(page: str | None, rules: Rules = Rules()) -> tuple[str, int, int]:
    """The main text, blocks kept and blocks in all."""
    if not page:
        return "", 0, 0
    blocks = blocks_of(page)
    classify(blocks, rules)
    good = [b.text for b in blocks if b.label == "good"]
    return "\n".join(good), len(good), len(blocks)


def extract_pages(pages: DataFrame, html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``pages`` without its html, with text, n_chars, n_kept_blocks and n_blocks in place of columns of these names.

    No shuffle: each page is handled where it is read.
    """

    @F.pandas_udf("text string, n_chars long, n_kept_blocks long, n_blocks long")
    def extract(htmls: pd.Series) -> pd.DataFrame:
        rows = [main_text(h, rules) for h in htmls]
        return pd.DataFrame(
            {"text": [r[0] for r in rows], "n_chars": [len(r[0]) for r in rows], "n_kept_blocks": [r[1] for r in rows], "n_blocks": [r[2] for r in rows]}
        )

    return with_struct(pages, extract(F.col(f"`{html_col}`")), drop=(html_col,))
