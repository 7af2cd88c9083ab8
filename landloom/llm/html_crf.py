"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with character references decoded and white
space (Unicode's, and line-break tags) turned into one space. Scripts, styles, comments and other raw elements
hold no text. Each block gets features of its ancestors' tags, of words in their class, id and role, and of its
text. The field has two labels and is trained by maximum likelihood on labelled pages: layouts given here, whose
main blocks carry an attribute, and a bounded sample of the pages themselves, where an article or main
element labels its blocks. Viterbi decoding picks each page's main blocks.

Null and empty pages, and pages without a main block, have the empty text. Unclosed and misnested tags are
read as browsers do in the common cases: a block-level tag ends an open paragraph, an end tag ends what is open
inside it. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, slices

#: Pages of the table that are taken as labelled by their markup, and their longest html in characters.
FIT_PAGES, FIT_CHARS = 200, 60_000

BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = {"hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"'/]+|\"[^\"]*\"|'[^']*'|/(?!>))*+/>"  # empty, with no end tag
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|canvas|xmp)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
LABEL = "data-main"

#: Words of class, id and role attributes by what they speak for.
NAMED = {
    "ad": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors doubleclick adsense outbrain taboola".split(),
    "comment": "comment comments discussion disqus replies reply respond responses thread feedback".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip toolbar".split(),
    "side": "sidebar aside rail related recommended recommendations widget widgets trending popular more".split(),
    "foot": "footer foot copyright legal colophon bottom".split(),
    "head": "header masthead topbar logo branding site".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner warning announcement paywall disclaimer".split(),
    "form": "form search subscribe subscription newsletter signup login signin contact".split(),
    "share": "share sharing social follow tags tagcloud meta byline author".split(),
    "body": "article content entry post story text body main blog prose page articlebody maincontent".split(),
}
_KIND = {w: k for k, words in NAMED.items() for w in words}
_SAID = re.compile(r"cookie|subscribe|newsletter|sign up|log in|advert|sponsored|all rights reserved|©|copyright|privacy|terms of|share (?:this|on)|read more|related|comments?\b|reply", re.I)
_TAGS = "article main section nav header footer aside form ul ol li table figure figcaption blockquote p div h1 h2 h3 h4 h5 h6 title head button label select option td th pre body dl dt dd details summary legend caption".split()
FEATURES = {
    n: i
    for i, n in enumerate(
        ["bias", *(f"own:{t}" for t in _TAGS), *(f"in:{t}" for t in _TAGS), *(f"name:{k}" for k in NAMED), *(f"own_name:{k}" for k in NAMED), *(f"size:{i}" for i in range(6)), *(f"links:{i}" for i in range(4)), "ends", "said", "upper", "first", "last", "depth:3", "in_article&clean", "in_article&odd", "clean&long", "no_root"]
    )
}
_ODD_TAGS = {"nav", "footer", "aside", "form", "head", "title", "button", "select", "option", "label", "legend"}
_ODD_NAMES = {"ad", "comment", "menu", "side", "foot", "notice", "form", "share"}


@dataclass
class Block:
    text: str
    features: list[int]
    label: int


def _kinds(attrs: str) -> set[str]:
    return {_KIND[w] for m in _NAMES.finditer(attrs) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()) if w in _KIND} if attrs else set()


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Labels: 1 inside an element with the attribute ``data-main``, else 0."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, bool]] = []  # open block-level elements: tag, kinds of names, labelled
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block(text, _features(text, linked, stack), int(any(x[2] for x in stack))))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            own = page[at : m.start()]
            parts.append(html.unescape(own))  # a reference ends where a tag begins
            linked += len(own) * bool(in_link)
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        ending = m["end"] or m["end2"]
        if tag == "a":
            in_link = 0 if ending else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            if ending:
                if any(x[0] == tag for x in stack):
                    while stack.pop()[0] != tag:
                        pass
            else:
                while stack and stack[-1][0] == "p":
                    stack.pop()
                if tag in ("li", "option", "dt", "dd", "td", "th", "tr") and stack and stack[-1][0] == tag:
                    stack.pop()
                attrs = m["attrs"] or m["attrs2"] or ""
                if tag not in VOID:
                    stack.append((tag, frozenset(_kinds(attrs)), LABEL in attrs))
            in_link = 0 if tag not in ("p", "div", "h1", "h2", "h3", "h4") else in_link
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close()
    if out:
        out[0].features.append(FEATURES["first"])
        out[-1].features.append(FEATURES["last"])
    return out


def _features(text: str, linked: int, stack: list[tuple[str, frozenset, bool]]) -> list[int]:
    names = ["bias"]
    tags = {x[0] for x in stack}
    kinds = set().union(*(x[1] for x in stack)) if stack else set()
    if stack:
        names.append(f"own:{stack[-1][0]}")
        names += [f"own_name:{k}" for k in stack[-1][1]]
    names += [f"in:{t}" for t in tags] + [f"name:{k}" for k in kinds]
    n = len(text)
    names.append(f"size:{0 if n < 15 else 1 if n < 40 else 2 if n < 80 else 3 if n < 200 else 4 if n < 500 else 5}")
    density = min(1.0, linked / n)
    names.append(f"links:{0 if density == 0 else 1 if density < 0.3 else 2 if density < 0.8 else 3}")
    if text[-1] in ".!?…\"”":
        names.append("ends")
    if n < 400 and _SAID.search(text):
        names.append("said")
    if text.isupper():
        names.append("upper")
    if len(stack) <= 3:
        names.append("depth:3")
    odd = bool(tags & _ODD_TAGS or kinds & _ODD_NAMES)
    root = bool(tags & {"article", "main"} or "body" in kinds)
    names.append("in_article&odd" if root and odd else "in_article&clean" if root else "no_root")
    if not odd and n >= 80 and density < 0.3:
        names.append("clean&long")
    return [FEATURES[x] for x in names if x in FEATURES]


@dataclass
class Field:
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels

    def decode(self, features: list[list[int]]) -> list[int]:
        """Viterbi: the likeliest labels of a page's blocks."""
        if not features:
            return []
        best, back = self.emit[features[0]].sum(0), []
        for own in features[1:]:
            ways = best[:, None] + self.move
            back.append(ways.argmax(0))
            best = ways.max(0) + self.emit[own].sum(0)
        labels = [int(best.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def fit(pages: list[list[Block]], rounds: int = 120, rate: float = 0.15, l2: float = 1e-3) -> Field:
    """Maximum likelihood by forward and backward sums over all pages at once."""
    pages = [p for p in pages if p]
    emit, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    if not pages:
        return Field(emit, move)
    n, most = len(pages), max(map(len, pages))
    x, y, on = np.zeros((n, most, len(FEATURES)), np.float32), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, page in enumerate(pages):
        for t, b in enumerate(page):
            x[i, t, b.features] = 1
            y[i, t], on[i, t] = b.label, True
    flat = x[on].astype(np.float64)
    gold = np.eye(2)[y] * on[..., None]
    pairs = on[:, 1:] & on[:, :-1]
    gold_move = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], pairs)
    size, means = on.sum(), [np.zeros_like(emit), np.zeros_like(move)]
    squares = [np.zeros_like(emit), np.zeros_like(move)]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for r in range(1, rounds + 1):
        e = np.zeros((n, most, 2))
        e[on] = flat @ emit
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = e[:, 0]
        for t in range(1, most):
            fwd[:, t] = np.where(on[:, t, None], e[:, t] + lse(fwd[:, t - 1, :, None] + move, 1), fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            bwd[:, t] = np.where(on[:, t + 1, None], lse(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
        z = lse(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * on[..., None]
        edge = np.exp(fwd[:, :-1, :, None] + move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        for k, (w, g) in enumerate(((emit, flat.T @ (gold - node)[on] / size - l2 * emit), (move, (gold_move - edge.sum((0, 1))) / size - l2 * move))):
            means[k], squares[k] = 0.9 * means[k] + 0.1 * g, 0.99 * squares[k] + 0.01 * g * g
            w += rate * means[k] / (1 - 0.9**r) / (np.sqrt(squares[k] / (1 - 0.99**r)) + 1e-6)
    return Field(emit, move)


def layouts(seed: int = 1, copies: int = 6) -> list[list[Block]]:
    """Labelled pages in common layouts, filled with made-up words."""
    rng = np.random.default_rng(seed)

    def words(lo: int, hi: int) -> str:
        n = int(rng.integers(lo, hi))
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10)))) for _ in range(n)).capitalize()

    sentence = lambda lo=6, hi=60: words(lo, hi) + rng.choice([".", ".", "!", "?", ""])
    paras = lambda tag="p": "".join(f"<{tag}>{sentence(1, 70)}</{tag}>" for _ in range(int(rng.integers(2, 8))))
    links = lambda n=5: "<ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
    ad = lambda: f'<div class="{rng.choice(["ad", "advert", "ads sponsored", "promo-box", "banner-ad"])}">{sentence(3, 20)}</div>'
    nav = lambda: rng.choice([f"<nav>{links()}</nav>", f'<div class="{rng.choice(["menu", "navbar", "breadcrumbs"])}">{links(4)}</div>', f"<header><h2>{words(1, 4)}</h2><nav>{links(3)}</nav></header>"])
    foot = lambda: rng.choice([f"<footer>&copy; {words(1, 3)} &middot; {sentence(3, 15)}</footer>", f'<div id="footer"><p>{sentence(5, 20)}</p>{links(3)}</div>'])
    talk = lambda: f'<{(t := rng.choice(["section", "div", "ol"]))} class="{rng.choice(["comments", "comment-list", "discussion"])}"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{sentence(3, 40)}</p></div>' for _ in range(3)) + f"</{t}>"
    side = lambda: rng.choice([f"<aside><h3>{words(1, 3)}</h3><p>{sentence(4, 30)}</p>{links(3)}</aside>", f'<div class="sidebar"><p>{sentence(4, 30)}</p>{links(4)}</div>', f'<div class="related"><h3>{words(2, 4)}</h3><p>{sentence(5, 30)}</p></div>'])
    note = lambda: rng.choice([f'<div class="cookie-notice"><p>{sentence(5, 30)}</p><button>{words(1, 2)}</button></div>', f'<div class="notice" role="alert">{sentence(4, 20)}</div>', f'<form class="newsletter"><label>{words(2, 5)}</label><input><button>{words(1, 2)}</button></form>', f"<form><p>{sentence(4, 20)}</p><select><option>{words(1, 2)}</option></select></form>"])
    title = lambda: f"<h1>{words(2, 12)}</h1>"
    more = lambda: rng.choice([f"<ul><li>{sentence(3, 20)}</li><li>{sentence(3, 20)}</li></ul>", f"<h2>{words(1, 6)}</h2><p>{sentence()}</p>", f"<blockquote>{sentence()}</blockquote>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<pre>{words(4, 20)}</pre>", f"<p>{words(1, 2)}.</p>"])
    pages = []
    for _ in range(copies):
        for open_, shut in (("<article {0}>", "</article>"), ("<main {0}>", "</main>"), ("<main><article {0}>", "</article></main>"), ('<div class="content" {0}>', "</div>"), ('<div id="article-body" {0}>', "</div>"), ('<section class="post" {0}>', "</section>"), ("<div {0}>", "</div>"), ("<article><div {0}>", "</div></article>"), ('<article itemprop="articleBody" {0}>', "</article>")):
            inside = lambda: open_.format(LABEL)  # noqa: E731, B023
            again = lambda: shut + rng.choice([ad(), side(), note(), talk()]) + inside()  # noqa: E731, B023
            body = inside() + title() + paras() + (again() if rng.random() < 0.5 else "") + more() + paras() + (again() if rng.random() < 0.3 else "") + more() + shut
            page = f"<html><head><title>{words(2, 8)}</title></head><body>" + (note() if rng.random() < 0.4 else "") + nav() + (ad() if rng.random() < 0.5 else "") + (side() if rng.random() < 0.3 else "") + body + (talk() if rng.random() < 0.5 else "") + (side() if rng.random() < 0.5 else "") + (note() if rng.random() < 0.3 else "") + foot() + "</body></html>"
            pages.append(blocks(page))
            # the same parts with what doesn't belong inside the root element
            odd = [ad, side, note, talk]
            root = open_.format("").replace(" >", ">")
            mixed = root + "".join(rng.choice([f"<p {LABEL}>{sentence(1, 70)}</p>", f"<h2 {LABEL}>{words(1, 8)}</h2>", f"<ul {LABEL}><li>{sentence(2, 20)}</li><li>{sentence(2, 20)}</li></ul>", odd[int(rng.integers(4))]()], p=[0.6, 0.1, 0.1, 0.2]) for _ in range(9)) + shut
            pages.append(blocks(f"<html><head><title>{words(2, 8)}</title></head><body>{nav()}{mixed}{side()}{foot()}</body></html>"))
    return pages


def by_markup(page: str) -> list[Block]:
    """A page's blocks labelled by its own article or main element, without what is marked as something else in it; none if it has no such element."""
    found = blocks(page)
    clean = FEATURES["in_article&clean"]
    roots = {FEATURES["in:article"], FEATURES["in:main"]}
    for b in found:
        b.label = int(clean in b.features and bool(roots & set(b.features)))
    return found if any(b.label for b in found) else []


def train(pages: DataFrame, most: int = FIT_PAGES) -> Field:
    """A field of the given layouts and of at most ``most`` different pages, chosen by hashes of their id and html."""
    short = pages.where(F.char_length("html") <= FIT_CHARS).select("html", F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("of"))
    ranks = short.select("h", "of").distinct().orderBy("h", "of").limit(most).collect()  # hashes alone; then the pages up to the last of them
    chosen = []
    if ranks:
        last = ranks[-1]
        upto = (F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("of") <= last.of))
        chosen = short.where(upto).groupBy("h", "of").agg(F.min("html").alias("html")).orderBy("h", "of").collect()  # ``most`` rows
    return fit(layouts() + [by_markup(r.html) for r in chosen])


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, field.decode([b.features for b in found]), strict=True) if keep)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            found = [main_text(h or "", sent.value) for h in b.column("html").to_pylist()]
            yield batch_of(schema, b.column("page_id"), b.column("url"), found, list(map(len, found)))

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
