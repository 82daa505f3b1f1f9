"""Main text of web pages by two passes of block rules.

Pass one classifies every block by where it stands (inside an article, or inside a menu, footer, form, advert ...),
its link density, its length and its stop-word density as good, bad, near good or short.  Pass two decides what pass
one left open: a near-good or short block takes the label of its nearest decided neighbours; where they disagree, a
near-good one is good, a short one is bad, and a short heading goes with what follows it.  Marks of articles speak for
the blocks inside them; what stands outside of marks is judged by the text rules as on pages without marks.

Few stop words make a block open, never bad (code, table cells, names).  On a page whose sentences hold too few of the
listed stop words, its language is an unlisted one: the short words that come back in its sentences are its stop words.
Scripts without blanks are judged by their punctuation, and each of their characters counts as three.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.textnum import blocks, ready_for_python, need_columns

MAX_LINKS = 0.33
SHORT, LONG = 70, 200  # characters
LOW_STOPS, HIGH_STOPS = 0.25, 0.32
# Stop words learned from a page have at most so many letters and are at least that share of its sentences' words.
LEARNED_LETTERS, LEARNED_STOPS = 4, 0.1
UNSPACED_WEIGHT, UNSPACED_MARKS = 3, 40  # length of a character without blanks; most characters for a mark of punctuation

STOP_WORDS = frozenset(
    # English, German, French, Spanish
    "the of and to in is that it for was on are with as be at by this from have or an not but his they which you were"
    " her all she there would their we him been has when who will more no if out so said what up its about into than"
    " der die das und ist nicht ein eine zu den mit sich auf für im dem von des auch es an werden aus er hat dass sie"
    " nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch"
    " le la les de des et un une du que qui est dans pour pas sur au avec ce il sont par plus ne se son sa ses mais"
    " comme on nous vous aux ou elle leur tout cette ces été être si même"
    " el los las y en del que un una por con no para es al lo como más pero sus su le ha me sin sobre este ya entre"
    " cuando todo esta ser son dos también fue había era muy hasta desde".split()
)

# Elements whose content is never text, and elements that bound blocks.
_RAW = frozenset(("script", "style"))
_SKIPPED = frozenset((
    "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea", "button", "canvas", "audio",
    "video", "map", "dialog", "title", "head",
))
_BLOCK = frozenset((
    "html", "body", "head", "p", "div", "li", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6",
    "section", "article", "main", "header", "footer", "nav", "aside", "form", "fieldset", "table", "thead", "tbody",
    "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details",
    "summary", "menu", "center",
))
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
_IN_HEAD = frozenset(("base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"))
# A new one of these closes an open one of the same kind.
_SELF_CLOSING = frozenset(("p", "li", "dt", "dd", "td", "th", "tr"))
_AWAY = frozenset(("nav", "footer", "aside", "menu"))
_AWAY_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"))
# Names are read as whole class tokens: 'cookie-notice' and 'tag-list' are names, 'tag-politics' and 'no-sidebar' are not.
_COMMENT_WORD = r"(?:comments?|commentlist|reply|replies|disqus|respond)"
_AWAY_WORD = (
    r"(?:ad|ads|adv|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|banner|nav|navbar|navigation|menu[^\W_]*|breadcrumbs?|crumbs?"
    r"|sidebar[^\W_]*|side|footer|foot|masthead|topbar|toolbar|cookies?[^\W_]*|consent|gdpr|notices?|notifications?|alerts?"
    r"|popup|modal|overlay|comments?|commentlist|reply|replies|disqus|respond|related|recommend[^\W_]*|teasers?|share|sharing"
    r"|social|newsletter|subscribe|subscription|signup|login|widgets?|pagination|pager|tags?|tagcloud|copyright|legal"
    r"|disclaimer|search[^\W_]*)"
)
_PLAIN_WORD = (
    r"(?:site|page|post|posts|entry|entries|article|articles|story|stories|news|top|bottom|left|right|upper|lower|primary"
    r"|secondary|global|box|bar|block|list|item|items|link|links|button|buttons|icons?|wrap|wrapper|container|inner|outer"
    r"|area|section|region|column|col|row|panel|content|body|text|title|form|cloud|unit|slot|media|\d+(?:x\d+)?)"
)
_AWAY_NAMES = re.compile(
    rf"(?<!\S)(?:{_PLAIN_WORD}[-_]+)*{_AWAY_WORD}(?:[-_]+(?:{_AWAY_WORD}|{_PLAIN_WORD}))*(?!\S)", re.I
)
_COMMENT_NAMES = re.compile(
    rf"(?<!\S)(?:(?:{_PLAIN_WORD}|user|reader)[-_]+)*{_COMMENT_WORD}(?:[-_]+(?:{_COMMENT_WORD}|{_PLAIN_WORD}))*(?!\S)", re.I
)
_PAGE_HEADER = re.compile(
    r"(?<!\S)(?:(?:site|page|main|top|global)[-_]*)?header(?:[-_]+(?:wrap|wrapper|container|inner|bar|top|main))?(?!\S)", re.I
)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post-?(?:body|content)|entry-?content|main-?content|story\w*)(?:$|[\s_-])", re.I)

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z))",
    re.S,
)
_NOTABLE = re.compile(r"class|id|role|hidden|style", re.I)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>"']|$)""", re.I)
_RAW_END = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in (*_RAW, "title", "textarea")}
_SENTENCE_END = re.compile(r"[.!?\u2026\u061f\u06d4\u0964][\"')\]\u2019\u201d\u00bb]*(?:\s|\Z)|[\u3002\uff01\uff1f\uff0e]")
# Scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_UNSPACED_MARK = re.compile(r"[\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f]")


@dataclass
class Block:
    """Text of a block and what pass one needs to know about it."""

    away: bool
    main: int  # the outermost mark around it, counted from 1; 0 without one
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: int = 0  # its level
    named: tuple[int, ...] = ()  # the elements around it whose names speak against it
    text: str = ""
    label: str = ""
    unspaced: int = 0  # characters of scripts without blanks

    @property
    def size(self) -> int:
        return len(self.text) + (UNSPACED_WEIGHT - 1) * self.unspaced

    @property
    def links(self) -> float:
        return self.linked / len(self.text)

    @property
    def unlinked(self) -> int:
        return self.size - self.linked * self.size // len(self.text)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or not _NOTABLE.search(raw):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _stands(name: str, attrs: dict[str, str], main: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element takes its content away from the main text, marks it as main text, has a name against it, or
    the name of reader comments.  A form speaks against its content as a name does: some forms hold the whole page."""
    away = name in _AWAY or (name == "header" and not main)
    if not attrs:
        return away, name in ("article", "main") and not away, name == "form", False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    named = comments = False
    if name not in ("html", "body"):
        comments = bool(_COMMENT_NAMES.search(names))
        named = comments or bool(_AWAY_NAMES.search(names)) or (not main and bool(_PAGE_HEADER.search(names)))
        named |= name == "form" or attrs.get("role", "").lower() == "form"
        away |= attrs.get("role", "").lower() in _AWAY_ROLES
        away |= "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
        away |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))
    marks = name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or (
        bool(names.strip()) and name in ("div", "section") and bool(_MAIN_NAMES.search(names))
    )
    # A name against an article takes its mark, not its text, which the text rules then judge; a comment may be an article.
    return away, marks and not away and not named, named and (comments or name not in ("article", "main")), comments


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out."""
    out: list[Block] = []
    open_: list[tuple[str, bool, int, bool, tuple[int, ...]]] = []  # element, away, main, skipped, named
    away = skipped = False
    named: tuple[int, ...] = ()
    main = names = regions = 0
    marks: dict[str, list[tuple[int, ...]]] = {"article": [], "main": []}  # the named elements around each
    links = 0
    said: set[int] = set()  # the names of reader comments
    block = Block(False, 0)
    at = 0

    def text(piece: str) -> None:
        if skipped and open_ and open_[-1][0] == "head" and piece.strip():
            close(len(open_) - 1)  # a head holds no text of its own
        if piece and not skipped:
            block.parts.append(piece)
            if links:
                block.linked += len((html.unescape(piece) if "&" in piece else piece).strip())

    def cut() -> None:
        nonlocal block
        whole = "".join(block.parts)
        block.text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
        if block.text:
            if not block.text.isascii():
                block.unspaced = len(_UNSPACED.findall(block.text))
            out.append(block)
        block = Block(away, main, named=named)

    def close(to: int) -> None:
        nonlocal away, main, skipped, named
        del open_[to:]
        away, main, skipped, named = open_[-1][1:] if open_ else (False, 0, False, ())

    while at < len(page):
        tag = _TAG.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at : tag.start()])
        at = tag.end()
        if tag["name"] is None:
            continue
        name, ends = tag["name"].lower(), tag["end"] is not None
        if name in _RAW_END:
            if not ends:
                stop = _RAW_END[name].search(page, at)
                if stop or name in _RAW:
                    at = stop.end() if stop else len(page)
                    continue
            elif name in _RAW:
                continue
        if open_ and not ends and name not in _IN_HEAD and (name in _BLOCK or open_[-1][0] == "head"):
            # What cannot stand in a head ends it; an open title ends with it.
            if open_[-1][0] in ("head", "title") and (held := [i for i, o in enumerate(open_) if o[0] == "head"]):
                close(held[-1])
        if name == "a":
            links = 0 if ends else 1
        elif name == "br":
            text(" ")
        blocky = name in _BLOCK
        if not blocky and name not in _SKIPPED:
            # Inline elements matter only where they may hide their content.
            if ends and not (open_ and open_[-1][0] == name) or not ends and (name in _VOID or not _NOTABLE.search(tag["attrs"])):
                continue
        if blocky:
            cut()
            links = 0
        if name in _VOID:
            continue
        if ends:
            inside = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if inside is not None:
                close(inside)
        else:
            if name in _SELF_CLOSING and open_ and open_[-1][0] == name:
                close(len(open_) - 1)
            if name in ("body",):
                close(0)
            attrs = _attributes(tag["attrs"])
            leaves, marked, against, comments = _stands(name, attrs, bool(main))
            if name in marks and not away and not comments:
                marks[name].append(named)
            if marked and not main:
                regions += 1
                main = regions
            if against:
                names += 1
                named = (*named, names)
                if comments:
                    said.add(names)
            away, skipped = away or leaves, skipped or name in _SKIPPED
            if not tag["attrs"].endswith("/") or blocky:
                open_.append((name, away, main, skipped, named))
            else:
                close(len(open_))
        if blocky:
            block.away, block.main, block.named = away, main, named
            block.heading = int(name[1]) if not ends and name in _HEADINGS else 0
        elif (away, named) != (block.away, block.named) and not block.parts:
            block.away, block.named = away, named
    cut()
    if names:
        around = marks["main"] + (marks["article"] if len(marks["article"]) == 1 else [])
        weigh_names(out, {n for m in around for n in m}, said)
    return out


def weigh_names(found: list[Block], lifted: set[int], comments: set[int]) -> None:
    """Takes away the blocks in named elements, but for names that are ``lifted`` or that other evidence outweighs.

    A name does not count around a main element or the only article, nor where its element holds most of the page's
    unlinked text.  Beside marked main text that is long, or as short as the element itself, it counts even there.
    Names of reader ``comments`` count whatever they hold where text that is not short stands beside them in the same
    mark or in front of them in another one, or where good text without a mark stands in front of them.
    """
    seen = [(b, b.unlinked) for b in found if not b.away]
    total = sum(size for _, size in seen)
    inside, marked = Counter(), Counter()  # by name; by mark and the names around
    for b, size in seen:
        inside.update(dict.fromkeys(b.named, size))
        if b.main:
            marked[b.main, b.named] += size
    counts = set()
    for n in inside:
        outside = Counter()
        for (region, names), size in marked.items():
            if n not in names:
                outside[region] += size
        most = max(outside.values(), default=0)
        if 2 * inside[n] <= total or most > 2 * LONG or (most and inside[n] <= 2 * LONG):
            counts.add(n)
    for n in comments & inside.keys():
        first = next(i for i, (b, _) in enumerate(seen) if n in b.named)
        regions = {b.main for b, _ in seen if n in b.named}
        beside = (b for i, (b, _) in enumerate(seen) if n not in b.named and (i < first or b.main and b.main in regions))
        if any(b.size >= SHORT and b.links <= MAX_LINKS if b.main else judge(b) == "good" for b in beside):
            counts.add(n)
    counts -= lifted
    for b, _ in seen:
        b.away = not counts.isdisjoint(b.named)


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?\"'()") for w in text.lower().split()]


def reads_as_sentences(b: Block) -> bool:
    """Whether a block has the form of sentences in any language: one ends, and most words begin small (or without case).

    A script without blanks must have a mark of punctuation for ``UNSPACED_MARKS`` characters.
    """
    if not _SENTENCE_END.search(b.text):
        return False
    if 2 * b.unspaced > len(b.text):
        return UNSPACED_MARKS * len(_UNSPACED_MARK.findall(b.text)) >= len(b.text)
    heads = [w[0] for w in b.text.split() if w[0].isalpha()]
    return 2 * sum(not (c.isupper() or c.istitle()) for c in heads) > len(heads)


def learn_stop_words(found: list[Block]) -> frozenset[str] | None:
    """The stop words of a page in an unlisted language: short words that come back in its sentences.

    None where the sentences hold enough listed stop words, or where the page has none.
    """
    prose = [b for b in found if not b.away and b.size >= SHORT and b.links <= MAX_LINKS and reads_as_sentences(b)]
    words = [_words(b.text) for b in prose]
    known = sum(b.size * sum(w in STOP_WORDS for w in ws) / len(ws) for b, ws in zip(prose, words))
    if not prose or known >= LOW_STOPS * sum(b.size for b in prose):
        return None
    often = Counter(w for ws in words for w in ws if w.isalpha() and len(w) <= LEARNED_LETTERS)
    return frozenset(w for w, n in often.items() if n > 1)


def judge(b: Block, learn: Callable[[], frozenset[str] | None] = lambda: None) -> str:
    """Label of a block by its text alone; ``learn`` gives the stop words of a page in an unlisted language."""
    size = b.size
    if size < SHORT and "\N{COPYRIGHT SIGN}" in b.text:
        return "bad"
    if size < SHORT or (b.heading and b.links > MAX_LINKS):
        return "short"
    if b.links > MAX_LINKS:
        return "bad"
    words = _words(b.text)
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if stops >= HIGH_STOPS:
        return "good" if size > LONG else "near"
    if stops >= LOW_STOPS:
        return "near"
    # Few stop words: code, cells, names, or another language than the listed ones.
    if not reads_as_sentences(b):
        return "short"
    learned = learn()
    if learned is not None:
        known = 2 * b.unspaced > len(b.text) or sum(w in learned for w in words) >= LEARNED_STOPS * len(words)
        return "good" if known and size > LONG else "near"
    return "near" if size > LONG else "short"


def classify(found: list[Block]) -> None:
    """Pass one.

    A mark makes the blocks inside good below the link limit and short above it (titles that are links, reference lists),
    so that nothing in it is bad for its links, and decides nothing outside.  It is believed where it is
    the page's only one, holds more than ``2 * LONG`` unlinked characters, or a quarter of the good text outside marks;
    else (a teaser card beside an unmarked body) the text rules judge its blocks as all others.
    """
    sizes = Counter()
    outside = 0
    learn = cache(lambda: learn_stop_words(found))
    for b in found:
        if b.main and not b.away:
            sizes[b.main] += b.unlinked
            continue
        b.label = "bad" if b.away else judge(b, learn)
        if b.label == "good":
            outside += b.size
    for b in found:
        if b.main and not b.away:
            if len(sizes) > 1 and sizes[b.main] <= 2 * LONG and 4 * sizes[b.main] < outside:
                b.main, b.label = 0, judge(b, learn)
            else:
                b.label = "short" if b.links > MAX_LINKS else "good"


def settle(found: list[Block]) -> None:
    """Pass two: open blocks inherit from the nearest decided block on either side; the page's ends count as bad."""
    first = [b.label for b in found]
    decided = [k if k in ("good", "bad") else None for k in first]
    before, last = [], "bad"
    for k in decided:
        before.append(last)
        last = k or last
    after, last = [], "bad"
    for k in reversed(decided):
        after.append(last)
        last = k or last
    after.reverse()
    # Inside a mark only neighbours of the same mark count, and what is decided there (but for what is away) is good.
    told = {b.main for b in found if b.main and b.label == "good"}
    for i, (b, kind, left, right) in enumerate(zip(found, first, before, after)):
        if kind in ("short", "near"):
            b.label = left if left == right else ("good" if kind == "near" else "bad")
            if b.heading and kind == "short":
                b.label = right  # a heading goes with what follows it
                if b.links > MAX_LINKS:
                    # One that is a link may belong to a teaser: only what stands below it, up to the next heading, counts.
                    below = takewhile(lambda j: not 0 < found[j].heading <= b.heading, range(i + 1, len(found)))
                    b.label = "good" if any(first[j] == "good" for j in below) else "bad"
            if b.main in told:
                b.label = "good"
    if not any(b.label == "good" for b in found):
        for b, kind in zip(found, first):
            b.label = "good" if kind == "near" or (kind == "short" and b.main) else b.label


def main_text(page: str) -> str:
    """Main text of a page: its good blocks, each with single blanks, joined by line feeds."""
    found = read_blocks(page)
    classify(found)
    settle(found)
    return "\n".join(b.text for b in found if b.label == "good")


@F.arrow_udf(T.StringType())
def main_text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The main text of each page; null counts as empty."""
    for batch in batches:
        yield pa.array([main_text(p) for b in blocks(batch) for p in b.to_pylist()], pa.string())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null and empty pages, and pages without main text, give the empty text.  Broken markup (open tags, lone brackets,
    cut comments) is read as far as it goes.  Repeated rows are extracted each; an empty table gives no rows; other
    columns are ignored.
    """
    need_columns(pages, "page_id", "url", "html")
    ready_for_python(pages.sparkSession)
    done = pages.select("page_id", "url", main_text_of(F.col("html")).alias("text"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
