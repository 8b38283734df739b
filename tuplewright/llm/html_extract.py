"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is read in one linear pass into leaf blocks: stretches of text between block-level tags, each with its
chain of open elements, summed up as `State`, so that the pass is linear however deep elements nest. Scripts, styles,
comments and the head are no text; an element or text that a head can't hold ends it. Features of a block are its
ancestors' tags, the kinds of words in their class, id and role attributes, and the length, links, punctuation and words of
its text. The CRF is trained on pages that `labelled` makes by rule and decoded by Viterbi in numpy batches.

In a block, character references are decoded, runs of white space become one space and the ends are trimmed; a line
break element is white space. Blocks found to be main text are joined in page order by line feeds.

Cases: null html is an empty page; an empty page, and one without main text, gives the empty string; tags that
are never closed or never opened are tolerated, and of those only a script or style takes the rest of the page with
it; a page that ends inside a tag keeps what came before; repeated rows give equal results. Columns text and n_chars
of the input are replaced.
"""

import functools
import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SEGMENT, bounded, runs
from .crf import Chain, Index

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not the page's, if they are closed; the first two take the rest of the page if they are not.
RAW = frozenset("script style noscript template textarea iframe svg title select".split())
HEAD = frozenset("html head base basefont bgsound link meta title noscript script style template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mspace mpadded mphantom mtable mtr mtd semantics annotation".split()
)
SEMANTIC = frozenset("article main nav header footer aside form section table ul ol dl figure blockquote pre dialog menu address details".split())
#: Kinds of attribute words, by the words' beginnings.
CUES = {
    "ad": ("ad", "ads", "adv", "advert", "sponsor", "promo", "banner", "affiliate", "outbrain", "taboola"),
    "nav": ("nav", "menu", "breadcrumb", "crumb", "pagination", "pager", "toc", "skip", "tabs"),
    "side": ("side", "sidebar", "aside", "widget", "rail", "related", "recommend", "more", "tag", "tags", "popular", "trending"),
    "foot": ("foot", "footer", "copyright", "legal", "colophon"),
    "head": ("header", "masthead", "top", "topbar", "logo", "brand", "hero"),
    "talk": ("comment", "comments", "reply", "replies", "discuss", "disqus", "respond", "review", "reviews"),
    "note": ("notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "toast", "overlay", "paywall"),
    "share": ("share", "social", "follow", "byline", "meta", "author"),
    "form": ("form", "search", "login", "signup", "signin", "contact"),
    "body": ("content", "article", "post", "entry", "story", "main", "text", "body", "page"),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}
_NOTE = re.compile(r"cookie|copyright|©|all rights|subscribe|sign up|log ?in|privacy|share|newsletter|advert|sponsored|repl(?:y|ies)\b|comments?\b", re.I)


def cues(attributes: str) -> frozenset:
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        for w in NAME_PART.findall((m[1] or m[2] or m[3] or "").lower()):
            k = _CUE.get(w) or _CUE.get(w.rstrip("s"))
            if k:
                found.add(k)
    return frozenset(found)


#: Private-use characters that begin other text and main text on labelled pages.
MARKS = ("\ue000", "\ue001")


class State(NamedTuple):
    """What features need of a chain of open elements, inline ones apart."""

    tag: str = ""
    near: str = ""  # the innermost SEMANTIC tags
    next: str = ""
    article: bool = False
    main: bool = False
    body: bool = False  # an article, a main element or one whose attributes say so
    found: frozenset = frozenset()  # kinds of attribute words of all elements, and of those inside that body
    inner: frozenset = frozenset()
    chrome: frozenset = frozenset()

    def within(self, tag: str, words: frozenset) -> "State":
        body = tag in ("article", "main") or "body" in words
        near, next_ = (tag, self.near) if tag in SEMANTIC else (self.near, self.next)
        chrome = self.chrome | {tag} if tag in CHROME else self.chrome
        return State(tag, near, next_, self.article or tag == "article", self.main or tag == "main", self.body or body, self.found | words, (frozenset() if body else self.inner) | (words - {"body"}), chrome)


CHROME = frozenset(("nav", "footer", "aside", "form", "header", "dialog", "menu"))
OUTSIDE = State()
_BLOCK_STOP = SEMANTIC | {"div", "li", "td", "th", "dd"}


def blocks(page: str) -> list[tuple[str, float, State]]:
    """(text, share of its characters in links, state) of each leaf block with text."""
    out = []
    stack: list[list] = []  # tag, state, open links
    depth: dict[str, list[int]] = {}  # where in the stack each tag is open
    links, outer = 0, 0  # open links, and those outside all elements
    parts: list[str] = []
    linked, state = 0, OUTSIDE
    endless: set[str] = set()  # raw tags that no later tag ends
    at, n = 0, len(page)

    def close():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, min(1.0, linked / len(text)), state))
        parts, linked = [], 0

    def cut(k: int):
        """Close the elements from number k of the stack on."""
        nonlocal links
        while len(stack) > k:
            tag, _, own = stack.pop()
            depth[tag].pop()
            links -= own

    def last(tags) -> int:
        return max((depth[t][-1] for t in tags if depth.get(t)), default=-1)

    def put(s: str):
        nonlocal linked, state
        if not s:
            return
        if depth.get("head"):
            if s.isspace():
                return
            cut(depth["head"][-1])
        s = html.unescape(s) if "&" in s else s
        if not parts:
            if s.isspace():
                return
            state = stack[-1][1] if stack else OUTSIDE
        parts.append(s)
        if links:
            linked += len(s)

    def drop(tags: tuple, stop: frozenset):
        """Close the innermost of tags, if none of stop is nearer."""
        k = last(tags)
        if k >= 0 and k >= last(stop):
            cut(k)

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                if (stack[-1][2] if stack else outer) > 0:
                    links -= 1
                    if stack:
                        stack[-1][2] -= 1
                    else:
                        outer -= 1
            elif tag not in INLINE:
                close()
                if depth.get(tag):
                    cut(depth[tag][-1])
            continue
        if tag not in HEAD and depth.get("head"):
            cut(depth["head"][-1])
        empty = m[3].rstrip().endswith("/")
        if tag in RAW:
            if empty:
                continue
            end = None if tag in endless else END[tag].search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(tag)
            if tag in ("script", "style"):
                break
            if tag == "title":  # its own text only
                k = page.find("<", at)
                at = n if k < 0 else k
                continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a" and not empty:
                links += 1
                if stack:
                    stack[-1][2] += 1
                else:
                    outer += 1
            continue
        close()
        if tag not in ("html", "head", "body"):
            drop(("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag != "li" else ("p",), _BLOCK_STOP)
        if tag == "li":
            drop(("li",), frozenset(("ul", "ol", "menu")))
        elif tag in ("td", "th"):
            drop(("td", "th"), frozenset(("tr", "table")))
        elif tag == "tr":
            drop(("tr",), frozenset(("table",)))
        elif tag in ("dt", "dd"):
            drop(("dt", "dd"), frozenset(("dl",)))
        if tag not in VOID and not empty:
            depth.setdefault(tag, []).append(len(stack))
            stack.append([tag, (stack[-1][1] if stack else OUTSIDE).within(tag, cues(m[3]) if m[3] else frozenset()), 0])
    close()
    return out


END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


def _size(n: int) -> str:
    return str(min(n.bit_length(), 10))


def describe(block: tuple[str, float, State]) -> tuple:
    """What the features of a block are made of; few distinct values, so that they can be remembered."""
    text, linked, of = block
    return (
        of.tag,
        of.near,
        of.next,
        "article" if of.article else "main" if of.main else "cue" if of.body else "",
        of.found - {"body"},
        of.inner if of.body else frozenset(),
        int(linked * 4),
        _size(len(text)),
        text[-1] in ".!?:…\"'»",
        len(text) < 300 and _NOTE.search(text) is not None,
        of.chrome,
    )


def names(d: tuple) -> list[str]:
    tag, near, next_, inside, found, inner, linked, size, ended, note, chrome = d
    out = [f"t:{tag}", f"n:{near}", f"m:{next_}", f"i:{inside}", f"ti:{tag}|{inside}", f"l:{linked}", f"s:{size}", f"e:{ended}", f"w:{note}", f"il:{inside}|{linked}", f"is:{inside}|{size}"]
    out += [f"c:{k}|{bool(inside)}" if k in found else "" for k in CUES]
    out += [f"ci:{k}" if k in inner else "" for k in CUES]
    out += [f"x:{k}" if k in chrome else "" for k in ("nav", "footer", "aside", "form", "header", "dialog", "menu")]
    return out


class Extractor:
    def __init__(self, pages: list[str], marks=MARKS, steps: int = 90):
        """Fits on pages whose every text begins with a mark: the first for other text, the second for main text."""
        self.index, self.rows = Index(), {}
        table = []
        for page in pages:
            found = blocks(page)
            labels = [int(t[0] == marks[1]) for t, _, _ in found]
            clean = [(re.sub("[" + "".join(marks) + "]", "", t) or "x", k, p) for t, k, p in found]
            table.append(([names(describe(b)) for b in clean], labels))
        self.index.of[""] = -1
        sequences = []
        for steps_of, _ in table:
            for f in steps_of:
                for name in f:
                    if name and name not in self.index.of:
                        self.index.of[name] = len(self.index.of) - 1
        self.n = len(self.index.of) - 1
        self.index.of[""] = self.n
        self.index.open = False
        for steps_of, _ in table:
            sequences.append(np.array([self._numbers(f) for f in steps_of], np.int32))
        self.chain = Chain(self.n, 2).fit(sequences, [np.array(y) for _, y in table], steps=steps)

    def _numbers(self, f: list[str]) -> list[int]:
        return [self.index.of.get(name, self.n) for name in f]

    def row(self, block: tuple) -> np.ndarray:
        d = describe(block)
        r = self.rows.get(d)
        if r is None:
            if len(self.rows) > 50_000:
                self.rows.clear()
            r = self.rows[d] = np.array(self._numbers(names(d)), np.int32)
        return r

    def extract(self, pages: list[str]) -> list[str]:
        found = [blocks(p) for p in pages]
        some = [f for f in found if f]
        tags = iter(self.chain.decode([np.stack([self.row(b) for b in f]) for f in some]) if some else ())
        return ["\n".join(b[0] for b, y in zip(f, next(tags), strict=True) if y) if f else "" for f in found]


def labelled(n: int = 320, seed: int = 3) -> list[str]:
    """Pages by rule: several layouts, with and without telling tags and attributes; every text begins with its mark."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick(*"abcdefghiklmnoprstuv") for _ in range(rng.integers(2, 10)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    no, yes = MARKS

    def sentences(a: int, b: int) -> str:
        return " ".join(words(2, 16).capitalize() + pick(".", ".", ".", "?", "!", ".***", ".&amp;&amp;") for _ in range(rng.integers(a, b)))

    def menu(tag: str = "nav", attr: str = "") -> str:
        items = "".join(f"<li><a href='/{word()}'>{no}{pick(word(), words(1, 3))}</a></li>" if chance(0.9) else f"<li>{no}{word()}</li>" for _ in range(rng.integers(2, 9)))
        return f"<{tag}{attr}><ul>{items}</ul></{tag}>"

    def cls(*names_: str) -> str:
        return f' {pick("class", "class", "id")}="{pick(*names_)}"' if chance(0.9) else ""

    def advert() -> str:
        return f"<{(t := pick('div', 'div', 'aside', 'section'))} class=\"{pick('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo-box', 'banner')}\">{no}{sentences(1, 4)}</{t}>"

    def notice() -> str:
        t = pick("div", "section", "aside", "dialog")
        return f"<{t} class=\"{pick('cookie-notice', 'notice', 'consent', 'newsletter', 'alert', 'popup', 'subscribe')}\"><p>{no}{pick('', 'We use cookies. ', 'Subscribe to our newsletter. ')}{sentences(1, 3)}</p></{t}>"

    def talk() -> str:
        t = pick("section", "div", "aside", "ol")
        each = "".join(f"<{pick('div', 'li', 'p')} class=\"comment\">" + (f"<b>{no}{word()}</b> " if chance(0.5) else "") + f"{no}{sentences(1, 5)}</{pick('div', 'p')}>" for _ in range(rng.integers(1, 5)))
        return f"<{t} {pick('class', 'id')}=\"{pick('comments', 'comment-list', 'replies', 'reader-comments', 'discussion comments')}\"><h3>{no}{pick('Comments', words(1, 3))}</h3>{each}</{t}>"

    def side() -> str:
        return f"<{(t := pick('aside', 'aside', 'div'))} class=\"{pick('sidebar', 'side', 'related', 'widget', 'right-rail')}\"><h3>{no}{words(1, 3)}</h3>" + pick(f"<p>{no}{sentences(1, 5)}</p>", menu("div"), f"<ul><li>{no}{words(2, 6)}</li></ul>") + f"</{t}>"

    def form() -> str:
        return f"<form><label>{no}{words(1, 3)}</label><input name=q><p>{no}{sentences(1, 2)}</p><button>{no}{word()}</button></form>"

    def foot() -> str:
        t, a = pick(("footer", ""), ("footer", ""), ("div", ' class="footer"'), ("div", ' id="foot"'))
        return f"<{t}{a}>" + pick(f"{no}&copy; {word()}.example &middot; {sentences(1, 3)}", f"<p>{no}&copy; {words(1, 4)}</p>" + menu("div"), f"<p>{no}{sentences(1, 3)}</p>") + f"</{t}>"

    def head() -> str:
        t, a = pick(("header", ""), ("header", ""), ("div", ' class="header"'), ("div", ' class="masthead"'))
        return f"<{t}{a}>" + pick(f"<h1>{no}{words(1, 4)}</h1>", f"<a href='/'>{no}{words(1, 3)}</a>", f"<div class='logo'>{no}{word()}</div><p>{no}{sentences(1, 2)}</p>") + (menu() if chance(0.5) else "") + f"</{t}>"

    def paragraph() -> str:
        s = sentences(1, pick(2, 3, 6, 12))
        if chance(0.15):
            s = words(1, 3).capitalize() + "."
        if chance(0.1):
            s = s + f" <a href='/{word()}'>{words(1, 3)}</a> " + words(1, 6) + "."
        return pick(f"<p>{yes}{s}</p>", f"<p>{yes}{s}</p>", f"<p>{yes}{s}", f"<p><b>{yes}{s}<br>", f"<p>{yes}<em>{s}</em></p>")

    def body() -> str:
        out = []
        if chance(0.8):
            out.append(f"<h1>{yes}{pick(words(1, 8).capitalize(), sentences(1, 2))}</h1>")
        for _ in range(rng.integers(1, 14)):
            x = rng.random()
            out.append(
                paragraph() if x < 0.78 else f"<h2>{yes}{words(1, 6)}</h2>" if x < 0.82 else f"<ul>{''.join(f'<li>{yes}{words(1, 12)}</li>' for _ in range(rng.integers(1, 5)))}</ul>" if x < 0.86
                else f"<blockquote>{yes}{sentences(1, 4)}</blockquote>" if x < 0.88 else f"<table><tr><th>{yes}{word()}</th><td>{yes}{words(1, 4)}</td></tr></table>" if x < 0.9 else f"<pre>{yes}{words(3, 20)}</pre>" if x < 0.91
                else f"<figure><img src=x><figcaption>{yes}{words(2, 9)}</figcaption></figure>" if x < 0.92 else f"<div>{yes}{sentences(1, 5)}</div>" if x < 0.95 else pick(advert, notice, side, form, lambda: menu("nav"), lambda: menu("div", ' class="share"'))()
            )
        return "".join(out) + (talk() if chance(0.12) else "")

    out = []
    for _ in range(n):
        t, a = pick(("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ""))
        content = f"<{t}{a}>{body()}</{t}>"
        if t == "article" and chance(0.25):
            content = f"<main>{content}</main>"
        before = [f for f in (head, lambda: menu(pick("nav", "nav", "div"), pick("", cls("nav", "menu", "topnav"))), advert, notice, side, form) if chance(0.45)]
        after = [f for f in (side, advert, talk, notice, form, lambda: menu("nav")) if chance(0.3)] + ([foot] if chance(0.85) else [])
        out.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(f() for f in before) + content + "".join(f() for f in after) + pick("</body></html>", ""))
    return out


@functools.lru_cache
def trained(n: int = 320, seed: int = 3) -> Extractor:
    return Extractor(labelled(n, seed))


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """df without its html, with text (main text, empty if none) and n_chars (its code points)."""
    rest = [f for f in df.schema.fields if f.name not in (page, "text", "n_chars")]
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            sizes = [n or 0 for n in pc.binary_length(batch[page]).to_pylist()]
            for start, stop in runs(sizes, 4 * SEGMENT):
                texts += shared.value.extract([p or "" for p in batch[page].slice(start, stop - start).to_pylist()])
            yield pa.record_batch([*(batch[f.name] for f in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in rest), "text", "n_chars"])

    return bounded(df).mapInArrow(run, T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def contract(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
