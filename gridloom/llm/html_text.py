"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags.  A word's score is the log odds
that it is content, given the elements it stands in (names, and words of
class, id and role); a tag's score is negative.  One linear scan finds the
contiguous run with the greatest sum.  Like scripts and styles, blocks whose
own elements speak against them (an advert or a form inside the article) are
no part of the sequence; a run of them counts as one tag.  All weights are
fitted on the labelled pages below.

What an element says against its words is not believed where it holds the page
itself: more than half of the page's words and with them a main heading or an
article, or nearly all words and these mostly in paragraphs.  So a form or a
"has-sidebar" around everything hides nothing.

Tags are read by the rules for HTML tokens (values with and without quotes,
stray quotes, end tags that may be left out, markup that ends an open svg), in
time linear in the page.

Defined cases: a null or empty page has the empty text; markup that never
closes ends with the page; a page without a positive word has the empty text;
rows that repeat are extracted each.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .subwords import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no markup, and those whose content is no text of the page.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SILENT = frozenset("script style title noscript template svg math iframe object canvas audio video head noembed noframes".split())
#: A start tag closes an open element of its group, unless one of the bounds lies between.
CLOSES = {"p": ({"p"}, None), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements of the head; any other start tag ends it.
IN_HEAD = frozenset("title base basefont bgsound link meta style script noscript noframes template".split())
#: Start tags that end an open svg or math element.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements that never are what holds the page.
NEVER_THE_PAGE = frozenset("nav footer aside header button select label textarea fieldset dialog menu option ul ol li".split())
_TAG = re.compile(
    r"""<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|(?P<odd>[!?][^>]*+(?:>|\Z))|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>|\Z)))?+)*+)(?:>|\Z))""", re.S
)
_CLOSES_SILENT = re.compile(r"</(noscript|template|svg|math|iframe|object|canvas|audio|video)\b", re.I)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def keys_of(name: str, attrs: str) -> tuple[str, ...]:
    """What an element says about the words in it: its name and the words of its class, id and role."""
    keys = [name]
    if attrs and "=" in attrs or "hidden" in attrs:
        for kind, value in _NAMED.findall(attrs):
            kind, value = kind.lower(), value.strip("\"'")
            if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                keys.append("#hidden")
            elif kind != "style":
                keys += ["." + (w[:-1] if len(w) > 3 and w.endswith("s") else w) for w in _PART.findall(_CAMEL.sub(" ", value).lower())]
    return tuple(dict.fromkeys(keys))


class Element:
    """An open element: its name, what it says about its words, and what it turned out to hold."""

    __slots__ = ("name", "keys", "words", "in_paragraphs", "heading")

    def __init__(self, name: str, keys: tuple[str, ...]):
        self.name, self.keys, self.words, self.in_paragraphs, self.heading = name, keys, 0, 0, name in ("main", "h1")


class _Stack:
    """Open elements, with how many there are of each name, so that no tag is searched for in vain."""

    def __init__(self, events: list):
        self.open: list[Element] = []
        self.names: dict[str, int] = {}
        self.events, self.silent = events, 0

    def push(self, element: Element) -> None:
        self.open.append(element)
        self.names[element.name] = self.names.get(element.name, 0) + 1
        self.silent += element.name in SILENT
        self.events.append(("open", element))

    def pop(self) -> None:
        element = self.open.pop()
        self.names[element.name] -= 1
        self.silent -= element.name in SILENT
        self.events.append(("close", element))
        if self.open:
            above = self.open[-1]
            above.words += element.words
            above.in_paragraphs += element.words if element.name == "p" else element.in_paragraphs
            above.heading |= element.heading

    def pop_to(self, name: str) -> None:
        while self.open[-1].name != name:
            self.pop()
        self.pop()

    def close_one_of(self, group, bounds) -> None:
        """Close the innermost open element of a group, unless a bound comes first."""
        if any(self.names.get(n) for n in group):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].name in group:
                    while len(self.open) > k:
                        self.pop()
                    return
                if self.open[k].name in bounds:
                    return


_P_BOUNDS = frozenset(ENDS_P | {"li", "td", "th", "body", "button"})


def events_of(page: str) -> list[tuple]:
    """("open", element), ("close", element), ("tag", name) and ("text", string) in page order.

    Comments, silent elements and declarations give no tag and no text.
    """
    events: list[tuple] = []
    stack = _Stack(events)
    closing: dict[str, int] = {}
    for m in _CLOSES_SILENT.finditer(page):
        closing[m[1].lower()] = m.start()
    at = 0

    def text_of(value: str) -> None:
        events.append(("text", value))
        if stack.open:
            stack.open[-1].words += len(value.split())

    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and stack.names.get("head") and not text.isspace() and stack.open[-1].name == "head":
            stack.pop_to("head")  # text does not stand in a head
        if text and not stack.silent:
            text_of(text)
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if stack.names.get(name):
                stack.pop_to(name)
            if not stack.silent and name not in SILENT:
                events.append(("tag", "/" + name))
            continue
        if stack.names.get("head") and name not in IN_HEAD and name != "head":
            stack.pop_to("head")
        if name in BREAKS_OUT and stack.silent:
            for foreign in ("svg", "math"):
                if stack.names.get(foreign):
                    stack.pop_to(foreign)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if name == "textarea" and not stack.silent:
                events.append(("tag", name))
                stack.push(Element(name, keys_of(name, m["attrs"])))
                text_of(body)
                stack.pop()
            continue
        if name in CLOSES:
            group, bounds = CLOSES[name]
            stack.close_one_of(group, bounds or _P_BOUNDS)
        elif name in ENDS_P:
            stack.close_one_of({"p"}, _P_BOUNDS)
        if not stack.silent and name not in SILENT:
            events.append(("tag", name))
        if name in VOID or m["attrs"].endswith("/") and name not in ENDS_P:
            continue
        if name in SILENT and name != "head" and closing.get(name, -1) < at:
            continue  # one that never closes hides nothing
        stack.push(Element(name, keys_of(name, m["attrs"])))
    while stack.open:
        stack.pop()
    return events


# ---------------------------------------------------------------- labelled pages

#: What encloses articles, and what encloses anything else, in the labelled pages.
ARTICLES = ["<article>", '<article class="post">', "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<section class="story">', '<div class="entry-content">', '<div class="article-text">', '<div role="main">', "<div>", "<section>", "<table><tr><td>", "", '<div class="col">', '<div id="page">', '<div class="container">', '<div class="main text">', '<div class="story-body">', '<div class="page">', '<div class="column"><div>', '<div class="article-content">']
OTHERS = [
    "<nav>", '<ul class="menu">', '<div class="navbar">', '<div id="navigation">', '<div class="breadcrumbs">', '<div class="pagination">', '<div role="navigation">', "<header>", '<div class="header">', '<div id="site-header">', '<div class="topbar">', '<div role="banner">', '<div class="masthead">',
    "<footer>", '<div class="footer">', '<div id="site-footer">', '<div role="contentinfo">', '<div class="copyright">', '<p class="legal">', "<aside>", '<div class="sidebar">', '<div id="sidebar-right">', '<div role="complementary">', '<div class="widget">', '<div class="related">', '<div class="recommended">', '<div class="popular">', '<div class="tags">',
    '<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="notice">', '<div class="consent">', '<div class="gdpr">', '<div class="alert">', '<div class="popup">', '<div class="modal">', '<div class="overlay">', '<div role="dialog">', '<div role="alert">', '<div class="disclaimer">', '<div class="warning message">',
    '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div id="ad-top">', '<div class="banner">', '<div class="promo">', '<div class="promotion">', '<div class="sponsored">', '<div class="sponsor">', '<ins class="adsbygoogle">', '<div class="teaser">', '<section class="advert">', '<p class="ad">', '<span class="ad">', '<section class="sponsored">', '<section class="related">',
    "<form>", '<div class="form">', '<div class="newsletter">', '<div class="subscribe">', '<div class="signup">', '<div class="login">', '<div class="search">', '<form class="contact">', "<button>", "<select>", "<label>", "<textarea>", "<fieldset>", "<dialog>", "<menu>",
    '<div class="comments">', '<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="commentlist">', '<div class="reply">', '<section id="responses">', '<div class="discussion">', '<div id="disqus_thread">', '<article class="comment">', '<li class="comment">',
    '<div class="share">', '<div class="social">', '<div class="toolbar">', '<div class="meta">', '<div class="byline">', '<div hidden>', '<div style="display:none">', '<div class="skip-link">', '<div class="outbrain">', '<div class="feedback">', '<div class="survey">', '<div class="paywall">', '<div class="author bio">', '<div class="rating">', '<div class="print">',
    '<div class="cookie">', '<div id="cookies">', '<div class="cookie-bar">', '<div class="col-md-4 sidebar">', '<aside class="col">', '<div class="widget-text">', '<div class="widget-area">', '<div class="promo-box">', '<div class="ad-slot">', '<div class="ad-container">', '<div class="newsletter-box">', '<div class="signup-form">',
    '<div class="reader-comments">', '<div id="comment-list">', '<div class="comments-area">', '<section class="reader-responses">', '<ul class="menu-main">', '<nav class="main-nav">', '<div class="main-menu">', '<div class="page-header">', '<header class="main-header">', '<div class="page-footer">', '<footer class="main-footer">', '<div class="nav-links">', '<nav class="post-navigation">',
    '<div class="related-posts">', '<div class="related-articles">', '<div class="more-stories">', '<div class="author-box">', '<div class="tag-cloud">', '<form class="search-form">', '<div class="login-form">', '<div class="top-bar">', '<div class="entry-meta">', '<div class="post-meta">', '<div class="share-buttons">', '<div class="content-sidebar">', '<div class="article-ad">', '<div class="notice-info notice">', '<div class="alert-box">', '<div class="page-notice">', '<div class="info-bar">',
]
#: What may stand around everything.
WRAPPERS = ["", "", "", '<div class="wrapper">', '<div class="container">', '<div id="page">', '<div class="page">', '<div class="row"><div class="col">', '<div class="site">', '<div class="layout column">', '<div class="main">', '<section class="section">', '<div id="content">', "<div>", "<table><tr><td>"]


def _close(opening: str) -> str:
    return "".join(f"</{n}>" for n in reversed(re.findall(r"<(\w+)", opening)))


def labelled_pages(n: int = 800, seed: int = 11) -> list[list[tuple[str, bool]]]:
    """Pages as lists of (markup, is content), put together by a rule; every other element comes in some of them."""
    rng, out = random.Random(seed), []
    words = lambda lo, hi: " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(lo, hi)))
    others = itertools.cycle(OTHERS)

    def other():
        opening = next(others)
        style = rng.randrange(6)
        body = ["".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))), words(2, 30), "".join(f"<p>{words(3, 25)}</p>" for _ in range(rng.randint(1, 3))), f"<span>{words(1, 6)}</span> <a>{words(1, 4)}</a>", f"<h{k % 3 + 2}>{words(1, 6)}</h{k % 3 + 2}><p>{words(3, 25)}</p>", f"<h2>{words(1, 4)}</h2><p><b>{words(1, 9)}</b> {words(1, 9)}</p><ul><li>{words(1, 9)}</li></ul>"][style]
        if style == 0 and "<ul" not in opening and "<ol" not in opening:
            body = f"<ul>{body}</ul>"
        return (opening + body + _close(opening), False)

    for k in range(n):
        opening = ARTICLES[k % len(ARTICLES)]
        page = [("<html><body>", False)]
        around = rng.choice(WRAPPERS)  # holds all of the page, and so says nothing
        page.append((around, False))
        page += [other() for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.3:
            page.append(('<div class="wrapper">', False))
        page.append((opening, True))
        if rng.random() < 0.6:
            page.append((f"<h1>{words(2, 9)}</h1>", True))
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            text = words(1, 70)
            if kind < 0.6:
                page.append((f"<p>{text}</p>", True))
            elif kind < 0.7:
                page.append((f"<p><b>{text}</b> <a>{words(1, 5)}</a> {words(1, 30)}<br><i>{words(1, 9)}</i></p>", True))
            elif kind < 0.76:
                page.append((f"<h2>{words(1, 8)}</h2>", True))
            elif kind < 0.82:
                page.append(("<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>", True))
            elif kind < 0.86:
                page.append((rng.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<div>{}</div>", "<section>{}</section>", "<dl><dd>{}</dd></dl>"]).format(text), True))
            elif kind < 0.9:
                page.append((text, True))
            else:
                page.append(other())
        page.append((_close(opening), True))
        page += [other() for _ in range(rng.randint(1, 4))]
        page.append((_close(around) + "</body></html>", False))
        out.append(page)
    return out


class Weights:
    """Log odds of keys, and scores of tags."""

    def __init__(self, keys: dict[str, float], bias: float, tags: dict[str, float], other_tag: float):
        self.keys, self.bias, self.tags, self.other_tag = keys, bias, tags, other_tag

    def believed(self, element: Element, total: int) -> dict[str, float]:
        """The element's keys with their weights, without what it says against the page that it holds."""
        said = {k: self.keys.get(k, 0.0) for k in element.keys}
        share = element.words / max(1, total)
        holds = share > 0.5 and (element.heading or element.name == "article") or share > 0.8 and total >= 50 and element.in_paragraphs > 0.6 * element.words
        if element.name in ("html", "body") or holds and element.name not in NEVER_THE_PAGE:
            return {k: w for k, w in said.items() if w >= 0}
        return said


def fit_weights(pages, rounds: int = 1500, rate: float = 2.0, decay: float = 2e-4) -> Weights:
    """Logistic regression of words on the keys around them; tag scores from how often tags stand inside and outside."""
    rows: dict[tuple, list[int]] = {}
    inside, outside = {}, {}
    mark = {True: "", False: ""}
    for page in pages:
        text = "".join(re.sub(r"(?<![\w<\"=/-])w+(?![\w\"=>-])", lambda m, c=mark[y]: c + m[0], part) for part, y in page)
        content, path = False, []
        for kind, value in events_of(text):
            if kind == "open":
                path.append(value.keys)
            elif kind == "close":
                path.pop()
            elif kind == "text":
                keys = tuple(dict.fromkeys(itertools.chain.from_iterable(path)))
                for c in value:
                    if c in mark.values():
                        content = c == mark[True]
                        rows.setdefault(keys, [0, 0])[content] += 1
            else:
                side = inside if content else outside
                side[value] = side.get(value, 0) + 1
    names = sorted({k for keys in rows for k in keys})
    place = {k: i for i, k in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    n, y = np.zeros(len(rows)), np.zeros(len(rows))
    for i, (keys, (no, yes)) in enumerate(rows.items()):
        x[i, [place[k] for k in keys]] = 1
        n[i], y[i] = math.sqrt(no + yes), yes / (no + yes)
    w, b, n = np.zeros(len(names)), 0.0, n / n.sum()
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-(x @ w + b))) - y) * n
        w -= rate * (x.T @ gap * 8 + decay * w)
        b -= rate * gap.sum()
    total = sum(inside.values()) / max(1, sum(outside.values()))
    tags = {t: min(-0.05, 0.5 * math.log((inside.get(t, 0) + 1) / (outside.get(t, 0) + 1) / total)) for t in {*inside, *outside}}
    return Weights({k: float(v) for k, v in zip(names, w)}, float(b), tags, min(tags.values()))


_fitted: list[Weights] = []


def weights() -> Weights:
    if not _fitted:
        _fitted.append(fit_weights(labelled_pages()))
    return _fitted[0]


class _Path:
    """The sum of the weights on the way to a text, each key once: of all elements, and of those that say something about blocks."""

    def __init__(self, fitted: Weights, total: int):
        self.fitted, self.total = fitted, total
        self.sums, self.seen = [(fitted.bias, fitted.bias)], [{}, {}]
        self.added: list[tuple[list[str], list[str]]] = []

    def open(self, element: Element) -> None:
        word, block = self.sums[-1]
        own = element.name not in INLINE or len(element.keys) > 1
        added: tuple[list[str], list[str]] = ([], [])
        for key, w in self.fitted.believed(element, self.total).items():
            if key not in self.seen[0]:
                self.seen[0][key] = True
                added[0].append(key)
                word += w
            if own and key not in self.seen[1]:
                self.seen[1][key] = True
                added[1].append(key)
                block += w
        self.added.append(added)
        self.sums.append((word, block))

    def close(self) -> None:
        self.sums.pop()
        for seen, keys in zip(self.seen, self.added.pop()):
            for k in keys:
                del seen[k]


def blocks(page: str, fitted: Weights) -> list[tuple[str, float, float, float]]:
    """(text, tags, score, standing) of each block: scores of the tags before it and of its words, and that of its block elements.

    Pieces whose own elements speak against them are left out of a block that has others.
    """
    events = events_of(page)
    path = _Path(fitted, sum(len(v.split()) for k, v in events if k == "text"))
    out, text, pending = [], [], 0.0  # text: (piece, score, standing); blanks have no standing

    def close():
        nonlocal text, pending
        kept = text
        if any(s is not None and s < 0 for _, _, s in text) and any(s is not None and s > 0 for _, _, s in text):
            kept = [t for t in text if t[2] is None or t[2] >= 0]
        joined = " ".join(entities.unescape("".join(t for t, _, _ in kept)).split())
        if joined:
            stands = [s for _, _, s in kept if s is not None] or [0.0]
            out.append((joined, pending, sum(s for _, s, _ in kept), min(stands[:1] + [s for s in stands if s < 0])))
            pending = 0.0
        text = []

    opened: list[Element] = []
    for kind, value in events:
        if kind == "open":
            path.open(value)
            opened.append(value)
        elif kind == "close":
            path.close()
            opened.pop()
        elif kind == "text":
            n = len(value.split())
            if n:
                word, block = path.sums[-1]
                text.append((value, n * word, block))
            elif text:
                text.append((value, 0.0, None))
        else:
            name = value.lstrip("/")
            around = opened[-1] if opened else None
            if name not in INLINE:
                close()
                pending += fitted.tags.get(value, fitted.other_tag)
            elif around is not None and around.name in INLINE and len(around.keys) > 1 or name == "ins":
                close()
    close()
    return out


def best_run(gains: list[tuple[float, float]]) -> tuple[int, int]:
    """(first, end) of the run with the greatest sum of (before, own) scores, where what stands before the first does not count.

    Of equal sums the first found; (0, 0) if no sum is positive.
    """
    best, span, run, first = 0.0, (0, 0), 0.0, 0
    for k, (before, own) in enumerate(gains):
        if run + before <= 0:
            run, first = own, k
        else:
            run += before + own
        if run > best:
            best, span = run, (first, k + 1)
    return span


def main_text(page: str | None, fitted: Weights | None = None) -> str:
    """The text of the best contiguous run of a page's blocks, those that their own elements speak against being silent."""
    if not page:
        return ""
    fitted = fitted or weights()
    texts, gains, silent = [], [], False
    for text, before, score, standing in blocks(page, fitted):
        if standing <= 0:
            silent = True
            continue
        texts.append(text)
        gains.append((before + (fitted.other_tag if silent else 0.0), score))
        silent = False
    return " ".join(texts[slice(*best_run(gains))])


def _extract(fitted: Weights):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "html", rows=1024):
                texts = [main_text(p, fitted) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(weights()), "page_id long, url string, text string, n_chars long")


def html_query(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
