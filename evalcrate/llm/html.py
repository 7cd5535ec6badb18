"""Operator 1: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, comments, forms
and hidden parts never enter one.  First pass, per block: length, stop-word
density and link density, together with what the markup around it says
(navigation, footer, advert, sidebar, reader comments; article or main part),
decide it as good or bad, or leave it open when it is short or in between.
Second pass: an open block takes the label of its nearest decided neighbours; at
equal distance a heading follows what comes after it, a block of middling
density is kept, and other short blocks follow what comes before.

Where a page marks its article, the blocks inside it are kept unless they are
marked as boilerplate or mostly links, and blocks outside it go; density
decides only on pages without such marks.  There the stop words are the listed ones of
four languages and, for every language that pages declare in ``<html lang>`` (pages
without one are a group too), the words with a share of ``FREQUENT`` or more in the
texts of at least ``EVIDENCE`` pages.  Where less than a third of a page's running text is
dense in them, no list fits the page, and length and link density decide.

Edge cases: null or empty html and pages without article text give an empty
text; broken or cut markup is read as far as it goes (an unclosed script or
comment hides the rest); repeated rows are extracted each; very long pages are
read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcrate.llm import bytescan
from evalcrate.llm.shared import for_python, saved

SHORT, LONG = 70, 200
LOW_DENSITY, HIGH_DENSITY = 0.1, 0.2
LINKS_OPEN, LINKS_ARTICLE = 0.33, 0.66
FREQUENT, EVIDENCE = 0.002, 50

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can do for from had has have he her his i if in into is it its
more my no not of on one or our out she so some than that the their them there they this to up was we were what when
which who will with would you
au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur lui mais même ne nous on ou où par
pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous
aber alle als am auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für
haben hat ich ihr im ist man mit nach nicht noch nur oder sich sie sind über um und uns von vor war was wenn werden wie
wir wird zu zum zur
al como con cuando del el ella ellos entre era es esta este fue ha hay la las lo los más me mi muy nos o para pero
por porque qué se ser si sin sobre su sus también todo tu una uno y ya yo
""".split())

BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section
select summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head form button select template svg math object canvas audio video dialog datalist".split())
HEAD = frozenset("base basefont bgsound link meta template".split()) | RAW
BOILERPLATE = frozenset("nav footer aside menu".split())
# fixed values: words of class, id and role that mark boilerplate; the second list only outside an article
MARKED = frozenset("""alert banner notice notices notification notifications ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs captcha comment
comments commentlist consent cookie cookies copyright disqus disclaimer footer gdpr login menu modal nav navbar
navigation newsletter outbrain pager pagination popup promo promotion related replies reply respond search share sharing
sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets complementary
contentinfo""".split())
MARKED_OUTSIDE = frozenset("header masthead topbar".split())
CONTENT = frozenset("article articlebody entry post story content main".split())

# comments, declarations, tags (a quote counts after an equals sign only); last, tags with an unclosed quote
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|(?!["'])))*)(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_UNQUOTED = re.compile(r"=\s*[^\s\"']+$")  # a slash at its end belongs to the value
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\w+")
_WIDE = re.compile("[\u1100-\u115f\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\U00020000-\U0003fffd]")
_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)


def _marks(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id, role and itemprop, and whether the element is hidden."""
    words, hidden = set(), False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words.update(w.lower() for w in _PART.findall(value))
            words.update(value.lower().split())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return words, hidden


class _Block:
    __slots__ = ("text", "linked", "heading", "marked", "marked_at", "content", "label")

    def __init__(self, text, linked, heading, marked, content):
        self.text, self.linked, self.heading = text, linked, heading
        # content rank of the place where the innermost boilerplate mark stands, None without a mark
        self.marked, self.marked_at, self.content, self.label = marked is not None, marked, content, None


def blocks(html: str) -> list[_Block]:
    """Visible blocks in page order."""
    out: list[_Block] = []
    # open elements: (name, dropped, marked, content rank, link, heading)
    stack: list[tuple] = [("", False, None, 0, False, False)]
    parts: list[tuple[str, bool]] = []

    def close():
        if parts:
            raw = "".join(t for t, _ in parts)
            text = " ".join(unescape(raw).split())
            if text:
                top = state
                linked = sum(len("".join(unescape(t).split())) for t, a in parts if a)
                size = max(len("".join(text.split())), 1)
                out.append(_Block(text, linked / size, top[5], top[2], top[3]))
            parts.clear()

    state = stack[-1]
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at:m.start() if m else end]
        if stack[-1][0] == "head" and text.strip():
            stack.pop()
        if text and not stack[-1][1]:
            if not parts or (parts and all(not t.strip() for t, _ in parts)):
                state = stack[-1]
            elif stack[-1][2] is not None or stack[-1][3] > state[3]:
                state = stack[-1]
            parts.append((text, stack[-1][4]))
        if not m:
            break
        at = m.end()
        slash, name, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        name = (name or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name in BLOCK:
            close()
        if slash:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        attrs = attrs or ""
        if name == "body":
            del stack[next((i for i, x in enumerate(stack) if x[0] == "head"), len(stack)):]
        elif stack[-1][0] == "head" and name not in HEAD:  # </head> is optional
            stack.pop()
        if name in RAW:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if not stop:
                break
            at = html.find(">", stop.start())
            at = end if at < 0 else at + 1
            continue
        closed = attrs.rstrip().endswith("/") and not _UNQUOTED.search(attrs.rstrip())
        if name in VOID or closed and name in ("path", "use", "svg", "math"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these close an open one of their kind
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name or (name == "p" and stack[i][0] == "p"):
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK and stack[i][0] != "p":
                    break
        elif name in BLOCK:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        _, dropped, marked, content, link, heading = stack[-1]
        words, hidden = _marks(attrs) if attrs.strip() else (set(), False)
        dropped = dropped or hidden or name in DROPPED
        if name == "body" or name == "html":
            marked = None
        elif name in BOILERPLATE or words & MARKED or (
                not content and (name == "header" or (words & MARKED_OUTSIDE and not words & CONTENT))):
            marked = content  # the innermost mark
        if name == "article":
            content = max(content, 3)
        elif name == "main" or "main" in words and "role" in attrs.lower():
            content = max(content, 2)
        elif words & CONTENT and name in ("div", "section", "td"):
            content = max(content, 1)
        heading = heading or (len(name) == 2 and name[0] == "h" and name[1].isdigit())
        stack.append((name, dropped, marked, content, link or name == "a", heading))
        if not parts:
            state = stack[-1]
    close()
    return out


def _size(text: str) -> int:
    """Length in columns: ideographs, kana and hangul count two."""
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def _density(text: str, stop_words: frozenset[str]) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in stop_words for w in words) / max(len(words), 1)


def _fits(page: list[_Block], stop_words: frozenset[str]) -> bool:
    """Whether at least a third of the page's running text is dense in the stop words."""
    running = [(_size(b.text), _density(b.text, stop_words)) for b in page
               if not b.marked and b.linked <= LINKS_OPEN and _size(b.text) >= SHORT]
    return 3 * sum(n for n, d in running if d >= HIGH_DENSITY) >= sum(n for n, _ in running)


def _first_pass(b: _Block, best: int, stop_words: frozenset[str] | None) -> str:
    """``stop_words`` None: no list fits the page."""
    if b.marked:
        return "bad"
    if best:
        if b.content < best:
            return "bad"
        if b.linked > LINKS_ARTICLE:
            return "bad"
        return "good" if len(b.text) >= SHORT else "short"
    size = _size(b.text)
    if b.linked > LINKS_OPEN or ("©" in b.text and size <= LONG):
        return "bad"
    if size < SHORT:
        return "short"
    density = HIGH_DENSITY if stop_words is None else _density(b.text, stop_words)
    if density >= HIGH_DENSITY:
        return "good" if size > LONG else "near"
    return "near" if density >= LOW_DENSITY else "bad"


def _second_pass(page: list[_Block], inside: bool) -> None:
    """Open blocks inherit; inside an article, marked blocks are no neighbours and no neighbour means good."""
    line = [b for b in page if not (inside and b.marked)] if inside else page
    first = [b.label for b in line]
    n = len(line)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if first[i] in ("good", "bad") and not (inside and line[i].content < max(b.content for b in line)):
            last = (i, first[i])
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if first[i] in ("good", "bad") and not (inside and line[i].content < max(b.content for b in line)):
            last = (i, first[i])
    for i, b in enumerate(line):
        if first[i] in ("good", "bad"):
            continue
        p, q = before[i], after[i]
        if not p and not q:
            b.label = "good" if inside or first[i] == "near" else "bad"
        elif not p or not q:
            b.label = (p or q)[1]
            if inside and b.label == "bad" and not b.heading:
                b.label = "good"
        elif p[1] == q[1]:
            b.label = p[1] if not inside or b.heading else "good"
        elif first[i] == "near" or (inside and not b.heading):
            b.label = "good"
        elif i - p[0] != q[0] - i:
            b.label = p[1] if i - p[0] < q[0] - i else q[1]
        else:
            b.label = q[1] if b.heading else p[1]


def _main(html: str | None, stop_words: frozenset[str]) -> tuple[str, int, int, bool]:
    """``main_text``, and whether stop words had a part in it."""
    page = blocks(html) if html else []
    top = max((b.content for b in page), default=0)
    if top >= 2 and all(b.marked for b in page if b.content == top):
        # a wrapper's class named a boilerplate part: inside the article only marks set there count
        for b in page:
            if b.content == top and b.marked_at < top:
                b.marked = False
    best = max((b.content for b in page if not b.marked), default=0)
    words = stop_words if not best and _fits(page, stop_words) else None
    for b in page:
        b.label = _first_pass(b, best, words)
    if page:
        _second_pass(page, best > 0)
    good = [b.text for b in page if b.label == "good"]
    return "\n\n".join(good), len(good), len(page) - len(good), bool(page) and not best


def main_text(html: str | None, stop_words: frozenset[str] = STOP_WORDS) -> tuple[str, int, int]:
    """Main text, number of blocks kept, number of blocks dropped."""
    return _main(html, stop_words)[:3]


def _extract(lists: dict[str, frozenset[str]]):
    """Rows with their text; ``again`` holds the html of pages that another list may read otherwise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytescan.slices(batches, "html"):
            pages = b.column("html").to_pylist()
            langs = [(m.group(1).lower() if (m := _LANG.search(h or "", 0, 4096)) else "") for h in pages]
            got = [_main(h, lists.get(x, STOP_WORDS)) for h, x in zip(pages, langs)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array([g[2] for g in got], pa.int64()), pa.array(langs, pa.string()),
                 pa.array([h if g[3] else None for h, g in zip(pages, got)], pa.string())],
                names=["page_id", "url", "text", "n_chars", "n_kept", "n_dropped", "lang", "again"])
    return run


_TEXTS = ("page_id long, url string, text string, n_chars long, n_kept long, n_dropped long, lang string, again string")


def frequent_words(texts: DataFrame) -> dict[str, frozenset[str]]:
    """Per ``lang`` the words with a mean share of ``FREQUENT`` or more in its texts (at most 1 / ``FREQUENT`` words)."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    texts = texts.select("lang", words.alias("words")).where(F.size("words") > 0)
    pages = {r.lang: r.k for r in texts.groupBy("lang").agg(F.count("*").alias("k")).collect() if r.k >= EVIDENCE}
    if not pages:
        return {}
    sizes = F.create_map(*(F.lit(x) for p in sorted(pages.items()) for x in p))
    found = (texts.where(F.col("lang").isin(list(pages))).select("lang", (1 / F.size("words")).alias("share"), F.explode("words").alias("w"))
             .groupBy("lang", "w").agg(F.sum("share").alias("share"))
             .where(F.col("share") >= FREQUENT * F.element_at(sizes, F.col("lang"))).collect())
    return {x: frozenset(r.w for r in found if r.lang == x) for x in pages}


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars, n_kept, n_dropped`` (blocks)."""
    for_python(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    first = saved(rows.mapInArrow(_extract({}), _TEXTS), "texts")
    waiting = first.where("again IS NOT NULL")
    langs = [r.lang for r in waiting.select("lang").distinct().collect()]
    lists = frequent_words(first.where(F.col("lang").isin(langs))) if langs else {}
    if lists:
        more = {x: STOP_WORDS | w for x, w in lists.items()}
        waits = F.col("again").isNotNull() & F.col("lang").isin(list(more))
        second = first.where(waits).select("page_id", "url", F.col("again").alias("html")).mapInArrow(_extract(more), _TEXTS)
        first = first.where(~waits).unionByName(second)
    return first.drop("lang", "again")
