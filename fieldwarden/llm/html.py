"""HTML extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is read into a tree of block elements (unclosed and stray tags as browsers treat them). Each block has features of
its own tag, its class, id and role tokens, its depth and place, the density of text, links and marks in its subtree, and
of its parent and siblings. Boosted trees give the log-odds that a block belongs to the article. Decoding takes the best
consistent choice: a block that is dropped drops all below it, a kept block may drop any child; so no kept block stands
in a dropped one. Text that stands directly in a block is kept if the block is.

The trees are fitted on pages that `lesson` lays out: articles of many templates among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, where the place of every block is known. They number `LESSONS`, fixed by a
seed, so the model is the same in every run; it is broadcast. In a tenth of them names of parts tell nothing. Pages are read one by one, without a shuffle.

Text: character references decoded, white space inside a block to one space, trimmed, blocks in page order, one line
each. Scripts, styles and markup never give text. Null and empty pages give ''. A page without tags is one block and
kept. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldwarden.llm.hashing import chunks

LESSONS, SEED = 1000, 5

# Fixed values of the HTML standard: elements by how they are read. One that is on no list is read as an inline one, unless a block element is the first thing in it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WHOLE = frozenset("script style noscript template iframe noembed noframes xmp title textarea".split())
HIDDEN = frozenset("head svg object audio video canvas datalist map annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
BLOCKS = CLOSES_P | frozenset("button caption colgroup dd dt legend li listing marquee optgroup option select tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("table td th".split())
HOLDERS = frozenset("ul ol dl table select menu".split())

# The standard's tokenizer: a value in quotes may hold any character but its quote, one without quotes any but white space and ">". A quote that
# nothing closes is a character like others, so that a page's rest is not lost.
_ATTRIBUTE = r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
ATTRIBUTE = re.compile(_ATTRIBUTE)
TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|([/]?)([a-zA-Z][^\s/>]*+)((?:" + _ATTRIBUTE.replace("([^", "(?:[^", 1).replace("(\"", "(?:\"", 1) + r")*+[\s/]*+)>|[!?/][^>]*+>|[a-zA-Z!?/][^>]*+\Z)", re.DOTALL
)
FIRST = re.compile(r"\s*<([a-zA-Z][^\s/>]*)")
NAMED = frozenset("class id role aria-label itemprop".split())
TOKEN = re.compile(r"[a-z]+")

# Attribute tokens, and the part of a page that each is a sign of.
SIGNS = {
    "article": "article articlebody body content contentinfo entry entrycontent hentry main maincontent page pagecontent post postbody postcontent prose richtext story storybody text",
    "menu": "bar breadcrumb breadcrumbs dropdown links menu nav navbar navigation pager pagination sitemap skip tabs toc toolbar",
    "header": "banner brand head header hero logo masthead topbar",
    "footer": "bottom colophon copyright footer foot legal",
    "side": "aside complementary sidebar side rail recommended related recirc secondary trending widget widgets",
    "notice": "alert banner consent cookie cookies disclaimer gdpr modal notice overlay paywall popup privacy toast",
    "advert": "ad ads adbox adslot advert advertisement advertorial adverts dfp doubleclick outbrain promo promoted promotion sponsor sponsored taboola",
    "form": "form login newsletter register search signin signup subscribe subscription",
    "talk": "comment commentlist comments discussion disqus reply replies respond responses thread",
    "share": "author byline follow meta rating share sharing social tag tags tools",
}
SIGN_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(SIGNS.values()):
    for _w in _words.split():
        SIGN_OF.setdefault(_w, []).append(_k)
# Kinds of tags that blocks are told apart by, in the order of their bits.
KINDS = (
    "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "article main", "section div center", "nav aside dialog", "footer", "header hgroup",
    "form fieldset button select label search", "table thead tbody tfoot tr td th", "figure figcaption blockquote pre details summary address",
)
KIND_OF = {t: 1 << k for k, tags in enumerate(KINDS) for t in tags.split()}


@dataclass(slots=True)
class Block:
    tag: str
    parent: Block | None
    signs: int = 0  # bits of SIGNS
    items: list = field(default_factory=list)  # own runs of text and child blocks, in page order
    own: int = 0  # characters of own text without spaces
    linked: int = 0  # of those, in links
    marks: int = 0  # sentence marks in own text
    tags: int = 1  # with the inline ones in it


@lru_cache(1 << 14)
def signs(attributes: str) -> int:
    """The parts of a page that a tag's class, id, role, label and itemprop tokens are signs of, as bits."""
    bits = 0
    for name, value in ATTRIBUTE.findall(attributes):
        for part in value.strip("\"'").lower().split() if name.lower() in NAMED else ():
            words = TOKEN.findall(part)
            for word in {*words, "".join(words)}:
                for k in SIGN_OF.get(word, ()):
                    bits |= 1 << k
    return bits


@lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE)


def _above(at: Block, wanted: frozenset | tuple, scope: frozenset) -> Block | None:
    """The nearest open block of a wanted tag, unless one of the scope comes before it."""
    while at.parent and at.tag not in wanted:
        if at.tag in scope:
            return None
        at = at.parent
    return at if at.parent else None


def read(page: str) -> Block:
    """The tree of block elements; text of hidden elements is left out."""
    root = at = Block("body", None)
    link, hidden, done, n = False, 0, 0, len(page)
    opened: Counter[str] = Counter()  # blocks that are open by tag, so that only what is open is looked for

    def above(wanted: tuple | frozenset, scope: frozenset) -> Block | None:
        return _above(at, wanted, scope) if any(opened[w] for w in wanted) else None

    def behind(up: Block) -> Block:
        """Where the page goes on once a block is closed, and all that is open inside it."""
        inner = at
        while inner is not up.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return up.parent

    def holds_block(after: int) -> bool:
        first = FIRST.match(page, after)
        return bool(first) and first[1].lower() in BLOCKS

    while done < n:
        m = TAG.search(page, done)
        start = m.start() if m else n
        if start > done and not hidden:
            text = page[done:start]
            size = len(text) - text.count(" ")
            at.items.append(text)
            at.own += size
            at.marks += text.count(".") + text.count(",")
            if link:
                at.linked += size
        if not m:
            break
        done = m.end()
        if not m[2]:
            continue  # a comment, a declaration or a cut tag
        name, closing = m[2].lower(), bool(m[1])
        if name in WHOLE:
            if not closing:
                end = _end_of(name).search(page, done)
                done = end.end() if end else n
        elif name in HIDDEN:
            hidden = max(0, hidden + (-1 if closing else 1)) if not m[3].rstrip().endswith("/") else hidden
        elif name in ("html", "body"):
            hidden = 0
        elif hidden and name not in CLOSES_P:
            continue
        elif name in INLINE or name in VOID or name not in BLOCKS and not (opened[name] if closing else holds_block(done)):
            at.tags += not closing
            if name == "a":
                link = not closing
            elif name == "hr" and not hidden:  # stands between blocks
                at = behind(up) if (up := above(("p",), SCOPES)) else at
                at.items.append(Block(name, at))
            elif name in VOID and not hidden:
                at.items.append(" ")
        elif closing:
            link = False
            if up := above((name,), frozenset()):
                at = behind(up)
        else:
            link, hidden = False, 0
            if name in CLOSES_P and (up := above(("p",), SCOPES)):
                at = behind(up)
            if name in SIBLINGS and (up := above(SIBLINGS[name], HOLDERS)):
                at = behind(up)
                while name == "tr" and at.tag in ("tr", "td", "th"):
                    at = behind(at)
            new = Block(name, at, signs(m[3]) if "=" in m[3] else 0)
            at.items.append(new)
            opened[name] += 1
            at = new
    return root


def blocks(root: Block) -> tuple[list[Block], list[int], list[int]]:
    """All blocks in page order, the index of each one's parent and its depth."""
    found, parents, depths = [], [], []
    todo = [(root, -1, 0)]
    while todo:
        b, parent, depth = todo.pop()
        k = len(found)
        found.append(b)
        parents.append(parent)
        depths.append(depth)
        todo += [(x, k, depth + 1) for x in reversed(b.items) if type(x) is Block]
    return found, parents, depths


@dataclass
class Table:
    """The blocks of many pages, with the index of each one's parent (-1 for a page's root), and their features."""

    found: list[Block]
    parent: np.ndarray
    depth: np.ndarray
    features: np.ndarray
    roots: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """The blocks of each depth from 1 on, in page order; sorted once, so that deep pages take no longer a block."""
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)[1:]

    def upward(self, values: np.ndarray) -> np.ndarray:
        """Sums over each block's subtree."""
        total = values.astype(np.float64)
        for at in reversed(self.levels):
            np.add.at(total, self.parent[at], total[at])
        return total

    def downward(self, bits: np.ndarray) -> np.ndarray:
        """The bits of all blocks above each one."""
        above = np.zeros_like(bits)
        for at in self.levels:
            above[at] = above[self.parent[at]] | bits[self.parent[at]]
        return above


def tabulate(pages: list[str]) -> Table:
    found, parent, depth, roots = [], [], [], []
    for page in pages:
        own, up, deep = blocks(read(page))
        roots.append(len(found))
        parent += [u + len(found) if u >= 0 else -1 for u in up]
        found += own
        depth += deep
    t = Table(found, np.array(parent, np.int64), np.array(depth, np.int64), np.empty(0), np.array(roots, np.int64))
    n = len(found)
    kind, sign, own, linked, marks, tags = (np.array([f(b) for b in found]) for f in (lambda b: KIND_OF.get(b.tag, 0), lambda b: b.signs, lambda b: b.own, lambda b: b.linked, lambda b: b.marks, lambda b: b.tags))
    page = np.repeat(np.arange(len(roots)), np.diff([*roots, n]))
    size, links, inner, marked = (t.upward(x) for x in (own, linked, tags, marks))
    total = np.maximum(1.0, size[t.roots][page])
    family = np.where(t.parent < 0, -1 - page, t.parent)  # a page's root has no siblings
    order = np.argsort(family, kind="stable")  # siblings together, in page order
    first = np.append(True, family[order][1:] != family[order][:-1]) if n else np.empty(0, bool)
    run = np.flatnonzero(first)
    count = np.diff([*run, n])
    place, siblings = np.empty(n), np.empty(n)
    place[order], siblings[order] = np.arange(n) - np.repeat(run, count), np.repeat(count, count)
    ahead, behind = np.zeros(n), np.zeros(n)
    ahead[order[1:]] = np.where(first[1:], 0, size[order[:-1]])
    behind[order[:-1]] = np.where(first[1:], 0, size[order[1:]])
    same = np.unique(family * 8192 + kind, return_inverse=True)[1]
    alike = np.bincount(same)[same] if n else np.empty(0)
    before = np.cumsum(own) - own
    start = (before - before[t.roots][page]) / total
    up = np.where(t.parent < 0, np.arange(n), t.parent)
    bits = lambda x, width: (x[:, None] >> np.arange(width) & 1).astype(np.float64)
    numbers = (
        t.depth, place, siblings, place / siblings, alike, np.log1p(own), linked / np.maximum(1, own), marks / np.maximum(1, own), np.log1p(size), links / np.maximum(1, size),
        marked / np.maximum(1, size), size / inner, size / total, start, np.log1p(size[up]), links[up] / np.maximum(1, size[up]), np.log1p(ahead), np.log1p(behind), np.log1p(inner),
    )
    t.features = np.column_stack([*numbers, bits(kind, len(KINDS)), bits(t.downward(kind), len(KINDS)), bits(sign, len(SIGNS)), bits(t.downward(sign), len(SIGNS))]) if n else np.empty((0, 0))
    return t


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: a feature and a threshold for each inner node, a value for each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 5, rate: float = 0.3, bins: int = 24, ridge: float = 2.0) -> Trees:
    """Newton boosting of the log loss on binned features."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    code = [np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)]
    useful = [f for f in range(x.shape[1]) if len(edges[f]) and code[f].min() < code[f].max()]
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, low = 2**level, 2**level - 1
            best = np.zeros(width)
            for f in useful:
                n = len(edges[f]) + 1
                cell = (node - low) * n + code[f]
                gl = np.bincount(cell, g, width * n).reshape(width, n).cumsum(1)
                hl = np.bincount(cell, h, width * n).reshape(width, n).cumsum(1)
                gain = gl**2 / (hl + ridge) + (gl[:, -1:] - gl) ** 2 / (hl[:, -1:] - hl + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
                gain = gain[:, :-1]
                cut, top = gain.argmax(1), gain.max(1)
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[low : low + width][better] = f
                threshold[low : low + width][better] = edges[f][cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        score += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def decode(t: Table, score: np.ndarray) -> np.ndarray:
    """Which blocks are kept: the choice of greatest total score in which no kept block is below a dropped one."""
    best = score.copy()
    for at in reversed(t.levels):
        np.add.at(best, t.parent[at], np.maximum(best[at], 0))
    kept = best > 0
    kept[t.roots] = True  # a root without text of its own takes nothing; with text, it is asked below
    for at in t.levels:
        kept[at] &= kept[t.parent[at]]
    alone = np.diff([*t.roots, len(t.found)]) == 1
    kept[t.roots] = (score[t.roots] > 0) | alone
    return kept


def lines(found: list[Block], kept: np.ndarray) -> list[str]:
    """The text of kept blocks in page order: a line for each run of a block's own text."""
    keep = {id(b) for b, k in zip(found, kept.tolist(), strict=True) if k}
    out: list[str] = []

    def walk(b: Block) -> None:
        todo = [iter(b.items)]
        owner, run = [b], [""]
        while todo:
            x = next(todo[-1], None)
            if type(x) is str:
                run[-1] += x
                continue
            if run[-1] and id(owner[-1]) in keep and (line := " ".join(unescape(run[-1]).split())):
                out.append(line)
            run[-1] = ""
            if x is None:
                todo.pop(), owner.pop(), run.pop()
            else:
                todo.append(iter(x.items))
                owner.append(x)
                run.append("")

    walk(found[0])
    return out


def texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [p or "" for p in pages]
    t = tabulate(pages)
    if not len(t.found):
        return []
    kept = decode(t, trees.score(t.features))
    ends = [*t.roots[1:].tolist(), len(t.found)]
    return ["\n".join(lines(t.found[a:b], kept[a:b])) for a, b in zip(t.roots.tolist(), ends, strict=True)]


#: Marks that stand in the texts of a lesson for what they are: article, or anything else.
ARTICLE, OTHER = "\x01", "\x02"


def lesson(rng: random.Random) -> str:
    """A page of one of many layouts, each run of text marked as the article's or not."""
    pick, chance = rng.choice, lambda p: rng.random() < p
    neutral = chance(0.1)  # the page's names tell nothing, so that its parts are known by their tags, shape and place alone
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüß", k=rng.randint(1, 11)))

    def prose(mark: str, words: int) -> str:
        out = [word().capitalize()]
        for _ in range(words - 1):
            out.append(f'<a href="/{word()}">{word()}</a>' if chance(0.01) else f"<b>{word()}</b>" if chance(0.01) else word() + pick([""] * 9 + [",", ".", " &amp;"]))
        return mark + " ".join(out) + pick([".", ".", ".", ""])

    def named(*choices: str) -> str:
        c = word() if neutral else pick(choices)
        return "" if not c else f' {pick(["class", "class", "id"])}="{pick(["", "", "site-", "js-", "x1 "])}{c}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{OTHER}{" ".join(word() for _ in range(rng.randint(1, 4)))}</a></li>' for _ in range(n))

    def menu() -> str:
        tag = pick(["nav", "nav", "div"])
        a = named("menu", "nav", "main-nav", "navbar", "breadcrumbs") if tag == "div" else named("", "menu", "main-nav")
        return f"<{tag}{a}>{pick(['<ul>', '<ul class=links>'])}{links(rng.randint(2, 12))}</ul></{tag}>"

    def advert() -> str:
        return f"<div{named('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'advertisement')}>{pick(['', '<p>'])}{prose(OTHER, rng.randint(1, 40))}</div>"

    def notice() -> str:
        tag = pick(["div", "section", "aside"])
        return f"<{tag}{named('cookie-notice', 'cookie-banner', 'consent', 'notice', 'alert', 'gdpr', 'paywall', 'disclaimer')}><p>{prose(OTHER, rng.randint(3, 40))}</p>{pick(['', f'<button>{OTHER}{word()}</button>'])}</{tag}>"

    def form() -> str:
        return f"<form{named('', 'newsletter', 'search', 'login')}><p>{prose(OTHER, rng.randint(2, 15))}</p><label>{OTHER}{word()}</label><input name=q><button>{OTHER}{word()}</button></form>"

    def side() -> str:
        tag = pick(["aside", "div"])
        a = named("sidebar", "side", "related", "recommended", "widget") if tag == "div" else named("", "sidebar", "related")
        inside = "".join(pick([lambda: f"<p>{prose(OTHER, rng.randint(2, 60))}</p>", lambda: f"<ul>{links(rng.randint(2, 8))}</ul>", advert])() for _ in range(rng.randint(1, 4)))
        return f"<{tag}{a}>{pick(['', f'<h3>{OTHER}{word()}</h3>'])}{inside}</{tag}>"

    def head() -> str:
        tag = pick(["header", "header", "div"])
        a = named("site-header", "masthead", "banner", "topbar", "header") if tag == "div" else named("", "masthead", "banner")
        return f"<{tag}{a}>{pick(['', f'<p>{prose(OTHER, rng.randint(1, 12))}</p>', f'<div class=logo>{OTHER}{word()}</div>', f'<h1>{OTHER}{word()}</h1>'])}{pick(['', menu()])}</{tag}>"

    def foot() -> str:
        tag = pick(["footer", "footer", "div"])
        a = named("footer", "site-footer", "copyright", "bottom") if tag == "div" else named("", "footer")
        return f"<{tag}{a}>{pick(['', menu()])}{pick(['', '<p>'])}{OTHER}&copy; {word()}.example &middot; {prose(OTHER, rng.randint(1, 20))}</{tag}>"

    def talk() -> str:
        tag = pick(["section", "div", "ol"])
        each = pick(["div", "article", "li", "p"]) if tag != "ol" else "li"
        inside = "".join(f"<{each}{named('comment', 'reply', 'comment-body')}>{pick(['', '<p>']) if each != 'p' else ''}{prose(OTHER, rng.randint(1, 80))}</{each}>" for _ in range(rng.randint(1, 6)))
        return f"<{tag}{named('comments', 'comment-list', 'discussion', 'responses', 'replies')}>{pick(['', f'<h2>{OTHER}{word()}</h2>']) if tag != 'ol' else ''}{inside}</{tag}>"

    def share() -> str:
        return f"<div{named('share', 'social', 'share-buttons', 'tags', 'author-meta')}>{OTHER}{word()} <a href=/s>{word()}</a></div>"

    def content() -> str:
        longest = pick([3, 12, 60, 250, 250])
        size = lambda: rng.randint(1, min(longest, pick([3, 12, 60, 250])))
        kinds = [
            lambda: f"<h{rng.randint(2, 4)}>{prose(ARTICLE, rng.randint(1, 9))}</h2>", lambda: f"<blockquote><p>{prose(ARTICLE, size())}</p></blockquote>",
            lambda: "<ul>" + "".join(f"<li>{prose(ARTICLE, size())}{pick(['', '</li>'])}" for _ in range(rng.randint(1, 6))) + "</ul>",
            lambda: f"<figure><img src=x.png><figcaption>{prose(ARTICLE, rng.randint(1, 20))}</figcaption></figure>",
            lambda: "<table>" + "".join(f"<tr><td>{ARTICLE}{word()}</td><td>{ARTICLE}{word()}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>",
            lambda: f"<pre>{ARTICLE}{word()} = {word()}\n{word()}</pre>", lambda: f"<div>{prose(ARTICLE, size())}</div>",
        ]
        para = lambda: f"<p>{pick(['', '', '', '<b>'])}{prose(ARTICLE, size())}{pick(['</p>', '</p>', '</p>', '', '<br>'])}"
        return "".join(pick(kinds)() if chance(0.12) else para() for _ in range(rng.randint(1, pick([1, 2, 8, 25]))))

    title = f"<h1>{prose(ARTICLE, rng.randint(1, 12))}</h1>" if chance(0.8) else ""
    if title and chance(0.2):
        title = f"<header>{title}</header>"
    tag, a = pick([("article", ""), ("article", ""), ("main", ""), ("div", named("post-content", "entry-content", "article-body", "content", "story")), ("section", named("article", "story-body")), ("div", "")])
    inside = content()
    for part in (side, form) if neutral else (advert, notice, share, side, form):  # without names the others would be content
        if chance(0.1):
            inside = pick([inside + part(), part() + inside, inside + part() + content()])
    if chance(0.1):
        inside += talk()
    main = f"<{tag}{a}>{title}{inside}</{tag}>"
    if chance(0.3):
        main = f"<{pick(['main', 'div', 'section'])}{named('', 'wrapper', 'container', 'page')}>{main}"
    before = [f() for f in (head, menu, notice, advert, form) if chance(0.45)]
    after = [f() for f in (side, talk, advert, form, foot, share) if chance(0.45)]
    rng.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(before)}{main}{''.join(after)}"


@lru_cache(2)
def train(lessons: int = LESSONS, seed: int = SEED) -> Trees:
    rng = random.Random(seed)
    t = tabulate([lesson(rng) for _ in range(lessons)])
    own = np.array([any(type(x) is str and ARTICLE in x for x in b.items) for b in t.found])
    wanted = t.upward(own) > 0  # a block is the article's if any text of it, or below it, is
    told = wanted | (t.upward(np.array([b.own > 0 for b in t.found])) > 0)
    return boost(t.features[told], wanted[told].astype(float))


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(trees or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column("html").to_pylist(), 1 << 22):
                found = texts(part, sent.value)
                ids = [batch.column(c).slice(at, len(part)) for c in ("page_id", "url")]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
