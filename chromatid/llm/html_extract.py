"""Main text of web pages by tag-path ratios.

Every text node of a page belongs to the path of open tags from the root down to it (a tag with what its class, id or role marks). Nodes are
gathered by path: characters, nodes, punctuation marks, and characters inside links. A path's two ratios (unlinked characters a node, punctuation
marks a node) are smoothed over the paths that come next to it in page order and fused into one score relative to the page's mean.

1. Paths over the threshold, but those that are mostly links, hold content. The content's region is the ``article`` and ``main`` elements that hold
   enough of its characters, or else the deepest element that holds most of them.
2. Inside the region unmarked blocks are content, short ones, lists and tables as well; lists of links only where the region is an ``article`` or ``main``.
   Outside, and where a class, id or role names menus, adverts, notices, comments and the like, a path's score counts a fifth, so it has to be far over the mean.
   Elements for navigation, page headers and footers, sidebars and dialogs never hold content, nor do forms, unless one is around most of the page's text.

Ratios alone can't tell a short advert from a short paragraph: on pages whose markup names its parts, as most do, the names decide, and ratios where
they are missing or wrong (README has figures).

A class name counts as a mark only if all its words do (``menu-bar``, ``related-posts``, but not ``menu-of-the-day`` or ``related-work``).
Blocks are what block-level tags delimit; inline tags, buttons and ``br`` don't end one; a button by itself is none. Character references are decoded, white space in a
block becomes one space, blocks are trimmed and joined in page order by a line feed.

Null or empty html gives an empty text; a page without any markup is one block of text and is returned as it is. Malformed markup keeps its text: a tag
ends at the first ``>`` that isn't within a whole quoted value, and comments and elements without content that never end are taken for their
start tag alone, but scripts and styles run to the end of the page. Pages are independent rows, read once from start to end in
time and memory that grow with their length alone: repeated rows and very long pages need no shuffle, extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatid.llm.common import only

#: A tag from its ``<`` on; a quote begins a value after ``=`` only, and only if what follows its end can follow a value.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
#: Elements that have no end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others delimit blocks.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose contents aren't text of the page.
_SKIPPED = frozenset("script style template noscript svg iframe textarea select title".split())
#: Elements that never hold content.
_BOILER_TAGS = frozenset("nav header footer aside dialog menu head title template noscript svg iframe textarea select".split())
#: Elements that hold content whatever they are called.
_CONTENT_TAGS = frozenset("table pre code figure blockquote".split())
#: Words of class names, ids and roles that mark what isn't content, and words that may stand beside them.
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion nav navigation navbar menu menus breadcrumb breadcrumbs sidebar sidebars"
    " footer cookie cookies consent notice notices gdpr popup modal newsletter subscribe share sharing social comment comments reply replies respond disqus related recommended".split()
)
_BESIDE = frozenset(
    "area bar block body bottom box button buttons container content form group holder icons inner items left link links list main mobile module outer panel post posts article"
    " articles reader readers user users page primary right row secondary section site slot stories thread title toolbar top unit widget wrap wrapper banner header message text".split()
)
#: Words for reader comments that mark outside of ``article`` elements only, as inside one they may name a part of it.
_TALK_WORDS = frozenset("discussion discussions talkback".split())
#: Words that mark what isn't content outside an article only, as inside one they may name its own heading, and words beside them.
_PAGE_WORDS = frozenset("header masthead banner widget widgets complementary contentinfo search login signup".split())
_PAGE_BESIDE = frozenset("site page global top main bar box form container wrapper wrap inner area left right".split())
#: Elements that a new start tag of the same kind ends where its end tag is missing, and the elements that stop the search for it.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body article main section div ul ol dl table blockquote nav header footer aside form".split())
#: Block elements before which an open p ends.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text rather than other blocks; regions are made of others.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead table ul ol dl blockquote pre figcaption caption".split())
_PUNCTUATION = re.compile(r"[.,;:!?。，！？…]")
_SPACES = re.compile(r"\s+")
#: Weights of a path, the next ones and the ones after those; and the threshold as a share of the page's mean score.
SMOOTHING, THRESHOLD = (1.0, 0.5, 0.25), 0.5
#: Priors of paths: outside the region where there is one, and marked ones wherever they are; all others' is 1. Both leave room for a score far over the mean.
OUTSIDE, MARKED = 0.2, 0.2
#: A form that holds this share of the page's characters is around the page, not a part of it; what is known of paths within forms until that is settled.
FORM_HOLDS, FORM = 0.5, 1e-9
#: Shares of the content's characters that articles must hold to be its region, and that another element must.
ARTICLES_HOLD, REGION_HOLDS = 0.25, 0.8


class Block:
    """A run of text: number of its tag path, of its element, and of the article or main that it is in (0: none); characters in links and in buttons."""

    __slots__ = ("button", "element", "link", "path", "root", "text")

    def __init__(self, path: int, element: int, root: int):
        self.path, self.element, self.root, self.text, self.link, self.button = path, element, root, [], 0, 0


class Page:
    """A page's blocks in order. Paths are a tree: (parent, tag, prior of marks) by number; elements have parents and tags by number."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.paths: list[tuple[int, str, float]] = [(0, "", 1.0)]
        self.parents, self.tags = [0], [""]
        self._number: dict[tuple[int, str, float], int] = {}
        self._read(page)

    def _path(self, parent: int, tag: str, prior: float) -> int:
        key = (parent, tag, prior)
        n = self._number.get(key)
        if n is None:
            n = self._number[key] = len(self.paths)
            self.paths.append(key)
        return n

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int, int]] = []  # tag; path, element and article or main number here or above
        places: dict[str, list[int]] = defaultdict(list)  # of each tag, in the stack
        outer: list[int] = []  # places of elements that aren't inline
        scopes: list[dict[str, list[int]]] = [defaultdict(list)]  # places by tag since each element of _SCOPE
        now: Block | None = None
        links = roots = articles = buttons = 0
        over: set[str] = set()  # ends that don't come any more

        def put(text: str) -> None:
            nonlocal now
            if not text:
                return
            if now is None:
                if text.isspace():
                    return
                _, path, element, root = stack[outer[-1]] if outer else ("", 0, 0, 0)
                now = Block(path, element, root)
                self.blocks.append(now)
            now.text.append(text)
            now.link += len(text) if links else 0
            now.button += len(text.strip()) if buttons else 0

        def close(k: int) -> None:
            nonlocal now, links, articles, buttons
            while len(stack) > k:
                tag = stack.pop()[0]
                links -= tag == "a"
                articles -= tag == "article"
                buttons -= tag == "button"
                places[tag].pop()
                if tag in _SCOPE:
                    scopes.pop()
                scopes[-1][tag].pop()
                if tag not in _INLINE:
                    outer.pop()
                    now = None

        def find(what: str, at: int) -> int:
            if what in over:
                return -1
            k = page.find(what, at)
            if k < 0:
                over.add(what)
            return k

        at = begin = 0  # where the search goes on, where the text that isn't put yet begins
        while True:
            at = page.find("<", at)
            if at < 0 or (end := find(">", at)) < 0:
                break
            after = page[at + 1 : at + 2]
            if after in "!?":
                put(page[begin:at])
                if page.startswith("<!--", at) and (k := find("-->", at + 4)) >= 0:
                    end = k + 2
                at = begin = end + 1
                continue
            m = _TAG.match(page, at) if after == "/" or after.isalpha() and after.isascii() else None
            if m is None and (after == "/" or not after.isascii() or not after.isalpha()):
                if after != "/":
                    at += 1  # a less-than sign
                    continue
                put(page[begin:at])
                at = begin = end + 1
                continue
            put(page[begin:at])
            if m is None:
                shut, tag, attributes = False, re.match(r"[^\s/>]*", page[at + 1 : end])[0].lower(), page[at + 1 : end]
            else:
                shut, tag, attributes, end = bool(m[1]), m[2].lower(), m[3], m.end() - 1
            at = begin = end + 1
            if shut:
                if places[tag] and not (tag in _INLINE and outer and outer[-1] > places[tag][-1]):
                    close(places[tag][-1])
                elif tag not in _INLINE:
                    now = None
                continue
            if tag in _SKIPPED:
                k = -1
                if (what := f"</{tag}") not in over:
                    found = re.compile(rf"{what}(?![\w-])[^>]*+>?", re.I).search(page, at)
                    if found:
                        k = found.end()
                    else:
                        over.add(what)
                if k < 0 and tag in ("script", "style"):
                    return
                if k >= 0:
                    if tag not in _INLINE:
                        now = None
                    at = begin = k
                    continue
                now = None
                continue
            if tag not in _INLINE:
                now = None
            if tag == "br":
                put(" ")
            if tag in _VOID:
                continue
            ends = [x[-1] for t in (*_SELF_CLOSING.get(tag, ()), *(("p",) if tag in _ENDS_P else ())) if (x := scopes[-1].get(t))]
            if ends:
                close(max(ends))
            _, path, element, root = stack[-1] if stack else ("", 0, 0, 0)
            if tag not in _INLINE:
                prior = self.paths[path][2]
                if prior:
                    # Inside an article, header holds the article's own heading.
                    if tag in _BOILER_TAGS and not (tag == "header" and root):
                        prior = 0.0
                    elif tag == "form":
                        prior = min(prior, FORM * prior if prior >= MARKED else prior)
                    elif attributes and prior in (1.0, FORM) and _marked(tag, attributes, root > 0, articles > 0):
                        prior *= MARKED
                path = self._path(path, tag, prior)
                self.parents.append(element)
                self.tags.append(tag)
                element = len(self.parents) - 1
                outer.append(len(stack))
            if not root and tag in ("article", "main"):
                roots += 1
                root = roots
            links += tag == "a"
            articles += tag == "article"
            buttons += tag == "button"
            places[tag].append(len(stack))
            scopes[-1][tag].append(len(stack))
            stack.append((tag, path, element, root))
            if tag in _SCOPE:
                scopes.append(defaultdict(list))
        put(page[begin:])


def _words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+", name)}


def _marked(tag: str, attributes: str, inside: bool, in_article: bool) -> bool:
    if tag in ("html", "body", "article", "main") and not inside or tag in _CONTENT_TAGS:
        return False
    for a in _ATTRIBUTE.findall(attributes):
        for name in (a[0] or a[1] or a[2]).split():
            words = _words(name)
            if words & _TALK_WORDS and words <= _TALK_WORDS | _BESIDE and not in_article:
                return True
            if words & _BOILER_WORDS and words <= _BOILER_WORDS | _BESIDE or not inside and words & _PAGE_WORDS and words <= _PAGE_WORDS | _PAGE_BESIDE:
                return True
    return False


def path_scores(chars: np.ndarray, nodes: np.ndarray, marks: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Fused score of each path, in page order: the mean of two smoothed ratios, each relative to its mean over the page's nodes."""
    score = np.zeros(len(chars))
    for what in (chars - linked, marks):
        ratio = what / nodes
        smooth = np.zeros(len(chars))
        weight = np.zeros(len(chars))
        for d, w in enumerate(SMOOTHING):
            for s in {d, -d}:
                k = np.arange(len(chars)) + s
                ok = (k >= 0) & (k < len(chars))
                smooth[ok] += w * ratio[k[ok]]
                weight[ok] += w
        smooth /= weight
        mean = (smooth * nodes).sum() / nodes.sum()
        score += smooth / mean / 2 if mean > 0 else 0.5
    return score


def _region(page: Page, mass: dict[int, int], total: int) -> int:
    """The deepest element that isn't made for text and holds most of the content's characters; 0 if that is the whole page."""
    held = [0] * len(page.parents)
    for element, chars in mass.items():
        held[element] += chars
    best = 0
    for e in range(len(held) - 1, 0, -1):  # children come after their parents
        if best == 0 and held[e] >= REGION_HOLDS * total and page.tags[e] not in _TEXT_TAGS:
            best = e
        held[page.parents[e]] += held[e]
    return best if page.tags[best] not in ("html", "body") else 0


def _settle_forms(page: Page, found: list[tuple[Block, str]]) -> dict[int, float]:
    """What is known of each path: a form that holds most of the page's unlinked text counts for nothing, what else is in forms isn't content."""
    known = [page.paths[p][2] for p in range(len(page.paths))]
    chars = [0, 0]
    for b, t in found:
        if known[b.path] > 0:
            chars[known[b.path] <= FORM] += max(0, len(t) - b.link)
    around = chars[1] > 0 and chars[1] >= FORM_HOLDS * sum(chars)
    return {p: k / FORM if 0 < k <= FORM and around else 0.0 if k <= FORM else k for p, k in enumerate(known)}


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    page = Page(html or "")
    found = [(b, _SPACES.sub(" ", entities.unescape("".join(b.text))).strip()) for b in page.blocks]
    known = _settle_forms(page, found)
    # A button in a sentence is text; one by itself isn't.
    found = [(b, t) for b, t in found if t and known[b.path] > 0 and b.button < len(_SPACES.sub("", "".join(b.text)))]
    if not found:
        return ""
    place = {p: i for i, p in enumerate(dict.fromkeys(b.path for b, _ in found))}
    chars, nodes, marks, linked = (np.zeros(len(place)) for _ in range(4))
    for b, t in found:
        i = place[b.path]
        chars[i] += len(t)
        nodes[i] += 1
        marks[i] += len(_PUNCTUATION.findall(t))
        linked[i] += min(b.link, len(t))
    prior = np.array([known[p] for p in place])
    score = path_scores(chars, nodes, marks, linked) * prior
    plain = 2 * linked <= chars
    content = (score >= threshold) & plain

    mass: dict[int, int] = defaultdict(int)
    of_root: dict[int, int] = defaultdict(int)
    for b, t in found:
        if content[place[b.path]]:
            mass[b.element] += len(t)
            of_root[b.root] += len(t)
    total = sum(mass.values())
    roots = {r for r in of_root if r} if total - of_root[0] >= ARTICLES_HOLD * total else set()
    region = _region(page, mass, total) if total and not roots else 0
    inside = [False] * len(page.parents)
    for e in range(1, len(inside)):
        inside[e] = e == region or inside[page.parents[e]]

    out = []
    for b, t in found:
        i, tag = place[b.path], page.paths[b.path][1]
        # Where the region is the whole page, elements made for text belong to it.
        within = b.root in roots if roots else inside[b.element] if region else tag in _TEXT_TAGS
        if prior[i] < 1:  # marked: only a score far over the mean tells otherwise
            kept = content[i]
        elif within:  # nothing unmarked is left out of articles; elsewhere lists of links are
            kept = bool(roots) or plain[i] and (score[i] > 0 or not linked[i]) or tag in _HEADINGS
        else:
            kept = plain[i] and score[i] * (OUTSIDE if roots or region else 1.0) >= threshold
        if kept:
            out.append(t)
    return "\n".join(out)


def page_text(html: str) -> str:
    """All text that a reader would see, one block a line."""
    lines = (_SPACES.sub(" ", entities.unescape("".join(b.text))).strip() for b in Page(html).blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages (id, url, html)."""

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html.tolist()], dtype=object)

    rows = only(pages, id_col, "url", "html").withColumn("text", text_of("html"))
    return rows.select(id_col, "url", "text", F.char_length("text").cast("long").alias("n_chars"))
