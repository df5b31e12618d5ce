"""Main-text extraction: boosted trees over DOM nodes, decoded by the hierarchy.

A page becomes a tree of block elements, whose leaves are runs of text. Each node is described by the density of text, tags
and links in its subtree, its tag and attribute tokens and those above it, its depth, its place and its siblings. Boosted
trees give the chance that a node holds main text. Decoding finds the likeliest labelling in which a node is chosen only
under a chosen parent, and an element only with a chosen child, so no choice contradicts another. The chosen runs, in page
order, are the text.

The trees are trained here, on pages composed from labelled parts (`training_pages`).
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.boosting import BoostedTrees, train
from rasterloom.llm.common import batches_of

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video select textarea button title head".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg")
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote figure #root".split())

TAG_GROUPS = ["nav menu", "header", "footer", "aside", "form fieldset", "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody tr td th", "blockquote pre", "figure figcaption", "body html", "#text"]
TAG_INDEX = {t: i for i, names in enumerate(TAG_GROUPS) for t in names.split()}
#: Attribute tokens in groups; tokens of no group count by their checksum.
TOKEN_GROUPS = [
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "header masthead topbar top brand logo",
    "footer foot bottom copyright legal colophon",
    "sidebar side aside rail widget widgets related recommended more trending popular",
    "comment comments commentlist reply replies respond discussion disqus",
    "cookie cookies consent gdpr notice notification alert popup modal overlay banner",
    "share social follow subscribe newsletter signup login search form",
    "article content entry post story text body main page",
]
TOKEN_INDEX = {t: i for i, names in enumerate(TOKEN_GROUPS) for t in names.split()}
BUCKETS = 32
ABOVE = ["nav", "header", "footer", "aside", "form", "article", "main", "li"]
N_PLAIN = 22

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "depth", "text", "chars", "links", "tags", "start", "end", "n_links", "n_p", "n_li", "n_inputs", "marks", "digits", "upper", "label", "index")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.tokens = [t.lower() for m in _ATTR.finditer(attributes) for t in _TOKEN.findall(m[2] or m[3] or m[4] or "")] if attributes else []
        self.text, self.chars, self.links, self.tags, self.start, self.end = "", 0, 0, 0, 0, 0
        self.n_links = self.n_p = self.n_li = self.n_inputs = self.marks = self.digits = self.upper = 0
        self.label = attributes


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", tag, attributes) and ("close", tag, "") in page order; a `<` that opens no tag is text. Quoted
    values may hold `>`; from the first tag on whose quotes don't close, a tag ends at the next `>` whatever is quoted. No part
    of a page is read more than a few times."""
    at, n, last, quoted = 0, len(page), page.rfind(">"), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("--", lt + 4)
            while 0 <= end and not page.startswith((">", "!>"), end + 2):
                end = page.find("--", end + 1)
            at = n if end < 0 else page.index(">", end) + 1
            continue
        name = _NAME.match(page, lt + 1) if lt < last else None
        if lt > last or not (name or page.startswith(("<!", "<?"), lt)):
            yield "text", "", "<"
            at = lt + 1
            continue
        if not name:
            at = page.index(">", lt) + 1
            continue
        end = _ATTRIBUTES.match(page, name.end()).end() if quoted else n
        if end >= n or page[end] != ">":
            quoted, end = False, page.find(">", name.end())
            if end < 0:
                yield "text", "", "<"
                at = lt + 1
                continue
        closing, tag, attributes, at = name[1], name[2].lower(), page[name.end() : end], end + 1
        if closing:
            yield "close", tag, ""
            continue
        yield "open", tag, attributes
        if tag in _RAW_END and not attributes.endswith("/"):
            end = _RAW_END[tag].search(page, at) if at < last else None
            at = end.end() if end else n
            yield "close", tag, ""


def parse(page: str) -> list[Node]:
    """Nodes in page order, the root first; runs of text are leaves with the tag #text."""
    root = Node("#root", None)
    nodes, here, silent, links, link_depth = [root], root, 0, 0, 0
    run: list[str] = []

    def flush() -> None:
        nonlocal run, links
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            leaf = Node("#text", here)
            leaf.text, leaf.chars, leaf.links = text, len(text), min(links, len(text))
            leaf.marks = sum(map(text.count, ".,;!?"))
            leaf.n_links = link_count
            here.children.append(leaf)
            nodes.append(leaf)
        run, links = [], 0

    link_count = 0
    opened: defaultdict[str, list[Node]] = defaultdict(list)  # the elements that are open, by tag, innermost last

    def leave(to: Node) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag].pop()
            here = here.parent

    def innermost_scope(but: set[str] = frozenset()) -> int:
        return max((opened[t][-1].depth for t in SCOPES if t not in but and opened[t]), default=0)

    for kind, tag, value in pieces(page):
        if kind == "text":
            if not silent:
                run.append(value)
                if link_depth:
                    links += len(value.strip())
        elif tag in SILENT:
            silent = max(0, silent + (1 if kind == "open" and not value.endswith("/") else -1 if kind == "close" else 0))
            here.n_inputs += kind == "open" and tag in ("button", "select", "textarea")
        elif silent:
            continue
        elif tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                link_depth = 1 if kind == "open" else 0
                link_count += kind == "open"
        elif kind == "open":
            flush()
            link_count = 0
            here.n_inputs += tag == "input"
            if tag in VOID:
                continue
            stop = SAME_CLOSES.get(tag)
            ending = ({"p"} if tag in CLOSES_P else set()) | (stop or set())
            if any(opened[t] for t in ending):
                scope = innermost_scope(stop or frozenset())
                within = [opened[t][k] for t in ending if (k := bisect_right(opened[t], scope, key=lambda n: n.depth)) < len(opened[t])]
                if within:
                    leave(min(within, key=lambda n: n.depth).parent)
            if re.match("h[1-6]", here.tag) and re.match("h[1-6]", tag):
                leave(here.parent)
            child = Node(tag, here, value)
            here.children.append(child)
            nodes.append(child)
            here = child
            opened[tag].append(child)
        else:
            flush()
            link_count = 0
            if opened[tag] and not (tag == "p" and innermost_scope() > opened[tag][-1].depth):
                leave(opened[tag][-1].parent)
    flush()
    gather(nodes)
    return nodes


def gather(nodes: list[Node]) -> None:
    """Sums over subtrees, and the range of the page's text that each node covers."""
    at = 0
    for i, node in enumerate(nodes):
        node.index = i
        node.start = at
        at += node.chars if node.tag == "#text" else 0
        node.end = at
    for node in reversed(nodes):
        if node.tag != "#text":
            node.tags += 1
            node.n_p += node.tag == "p"
            node.n_li += node.tag == "li"
        if up := node.parent:
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags
            up.marks += node.marks
            up.n_links += node.n_links
            up.n_p += node.n_p
            up.n_li += node.n_li
            up.n_inputs += node.n_inputs
            up.end = max(up.end, node.end)


#: Nodes whose features are held at once.
SLICE_NODES = 20_000


def describe(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node."""
    return np.concatenate(list(described(nodes)))


def described(nodes: list[Node], size: int = SLICE_NODES) -> Iterator[np.ndarray]:
    """Rows of features in page order, of up to `size` nodes at a time. A parent comes before its children, which take over what stands
    above: of all rows, only that is kept."""
    log = np.log1p
    page = max(nodes[0].chars, 1)
    width_tags, width_groups = len(TAG_GROUPS), len(TOKEN_GROUPS)
    a, b, c, d, e = (N_PLAIN + k for k in (0, width_tags, 2 * width_tags, 2 * width_tags + len(ABOVE), 2 * width_tags + len(ABOVE) + width_groups))
    f = e + width_groups
    tops, groups = np.zeros((len(nodes), len(ABOVE)), bool), np.zeros((len(nodes), width_groups), bool)  # above and, groups, in a node
    for node in nodes:
        i, up = node.index % size, node.parent
        if i == 0:
            out = np.zeros((min(size, len(nodes) - node.index), f + BUCKETS), np.float32)
            plain = np.zeros((len(out), N_PLAIN))
        row = out[i]
        siblings = up.children if up else [node]
        n = len(siblings)
        chars, tags = node.chars, node.tags
        if up:
            row[c : c + len(ABOVE)] = tops[up.index]
            row[e : e + width_groups] = groups[up.index]
            if up.tag in ABOVE:
                row[c + ABOVE.index(up.tag)] = 1
            if (k := TAG_INDEX.get(up.tag)) is not None:
                row[b + k] = 1
        if (k := TAG_INDEX.get(node.tag)) is not None:
            row[a + k] = 1
        for token in node.tokens:
            k = TOKEN_INDEX.get(token)
            if k is not None:
                row[d + k] = 1
            else:
                row[f + zlib.crc32(token.encode()) % BUCKETS] = 1
        tops[node.index] = row[c : c + len(ABOVE)]
        groups[node.index] = np.maximum(row[d : d + width_groups], row[e : e + width_groups])
        at = node_place(node, siblings)
        before, after = (siblings[at - 1].chars if at else 0), (siblings[at + 1].chars if at + 1 < n else 0)
        least = max(chars, 1)
        parent_chars = max(up.chars, 1) if up else least
        plain[i] = (node.depth, chars, node.links / least, tags, chars / (tags + 1), chars / page, node.start / page, node.end / page, at / n, n, before, after, node.marks / least, node.n_links, node.n_li, node.n_p, node.n_inputs, chars / parent_chars, len(node.children), up.links / parent_chars if up else 0, up.n_p if up else 0, page)
        if i == len(out) - 1:
            for k in (1, 3, 4, 9, 10, 11, 13, 14, 15, 16, 18, 20, 21):
                plain[:, k] = log(plain[:, k])
            out[:, :N_PLAIN] = plain
            yield out


def node_place(node: Node, siblings: list[Node]) -> int:
    """The place of a node among its siblings; kept in `digits` once its parent's children were numbered."""
    if siblings[-1].digits != len(siblings) - 1 or (len(siblings) > 1 and siblings[0].digits):
        for k, s in enumerate(siblings):
            s.digits = k
    return node.digits


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The likeliest consistent labelling: chosen nodes have chosen parents, and chosen elements a chosen child."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    off, on = no[:], [0.0] * len(nodes)
    for node in reversed(nodes):
        i = node.index
        if node.tag == "#text":
            on[i] = yes[i]
            continue
        if not node.children:
            on[i] = -1e18
            continue
        gains = [on[c.index] - off[c.index] for c in node.children]
        rest = sum(off[c.index] for c in node.children)
        off[i] += rest
        won = sum(x for x in gains if x > 0)
        on[i] = yes[i] + rest + (won if won > 0 else max(gains))
    chosen = [False] * len(nodes)
    chosen[0] = on[0] > off[0] and on[0] > -1e17
    for node in nodes:
        if chosen[node.index] and node.children:
            gains = [on[c.index] - off[c.index] for c in node.children]
            best = max(range(len(gains)), key=gains.__getitem__)
            for k, child in enumerate(node.children):
                chosen[child.index] = on[child.index] > -1e17 and (gains[k] > 0 or (k == best and max(gains) <= 0))
    return chosen


def main_text(nodes: list[Node], p: np.ndarray) -> str:
    return " ".join(n.text for n, ok in zip(nodes, decode(nodes, p)) if ok and n.tag == "#text")


# ---- training pages -------------------------------------------------------------------------------------------------


class Composer:
    """Pages of labelled parts. Main text is written between \\x01 and \\x02, which the labelling takes out again."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghlmnprstvw") + self.r.choice("aeiouéöä") for _ in range(self.r.randrange(1, 3))) for _ in range(80)]

    def words(self, low: int, high: int) -> str:
        words = ["".join(self.r.choices(self.syllables, k=self.r.randrange(1, 4))) for _ in range(self.r.randrange(low, high + 1))]
        text = " ".join(w + (self.r.choice([",", "."]) if self.r.random() < 0.12 else "") for w in words)
        return text[:1].upper() + text[1:] + self.r.choice([".", ".", "", "!"])

    def named(self, tag: str, names: list[str], text: str, bare: float = 0.2) -> str:
        name = self.r.choice(names)
        attribute = "" if self.r.random() < bare else f' {self.r.choice(["class", "class", "id"])}="{name}"'
        return f"<{tag}{attribute}>{text}</{tag}>"

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def main(self, text: str) -> str:
        return f"\x01{text}\x02"

    def clutter(self) -> str:
        r, w = self.r, self.words
        kind = r.randrange(13)
        if kind == 0:
            return self.named(r.choice(["nav", "nav", "div"]), ["nav", "menu", "main-menu", "navbar"], f"<ul>{self.links(r.randrange(2, 12))}</ul>", 0.5 if r.random() < 0.5 else 0)
        if kind == 1:
            return self.named("div", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner"], r.choice(["", "<p>"]) + w(3, 30), 0)
        if kind == 2:
            return self.named(r.choice(["aside", "div"]), ["sidebar", "side", "widget", "related", "rail"], f"<h3>{w(1, 4)}</h3><ul>{self.links(r.randrange(2, 9))}</ul>" + (f"<p>{w(5, 40)}</p>" if r.random() < 0.5 else ""), 0.1)
        if kind == 3:
            rows = "".join(r.choice([f'<div class="comment"><b>{w(1, 2)}</b><p>{w(4, 50)}</p></div>', f"<li><p>{w(4, 50)}</p></li>", f'<article class="comment"><p>{w(5, 40)}</p></article>']) for _ in range(r.randrange(1, 7)))
            return self.named(r.choice(["section", "div", "ol"]), ["comments", "comment-list", "discussion", "replies", "respond"], f"<h2>{w(1, 3)}</h2>{rows}", 0)
        if kind == 4:
            return self.named("div", ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup"], r.choice([f"<p>{w(6, 40)}</p>", w(6, 40)]) + "<button>OK</button>", 0)
        if kind == 5:
            return self.named("form", ["search", "newsletter", "signup", "login"], f'<label>{w(1, 4)}</label><input name="q"><p>{w(2, 20)}</p><button>Go</button>', 0.4)
        if kind == 6:
            return self.named("div", ["share", "social", "follow-us", "breadcrumbs", "tags", "pagination"], " ".join(f'<a href="#">{w(1, 2)}</a>' for _ in range(r.randrange(2, 7))), 0.1)
        if kind == 7:
            return f"<script>var a = '<p>{w(3, 9)}</p>';</script><style>p{{margin:0}}</style><!-- {w(2, 5)} -->"
        if kind == 8:
            return self.named("section", ["related", "more-stories", "recommended", "popular"], f"<h2>{w(1, 4)}</h2>" + "".join(f'<div><a href="/x">{w(3, 9)}</a><p>{w(4, 18)}</p></div>' for _ in range(r.randrange(2, 5))), 0)
        if kind == 9:
            return self.named("header", ["header", "masthead", "site-header"], f"<div>{w(1, 4)}</div>" + (f"<nav><ul>{self.links(r.randrange(2, 7))}</ul></nav>" if r.random() < 0.6 else f"<p>{w(3, 9)}</p>"), 0.6)
        if kind == 10:
            return self.named(r.choice(["footer", "footer", "div"]), ["footer", "site-footer", "copyright"], "&copy; " + w(4, 40) + (f"<ul>{self.links(3)}</ul>" if r.random() < 0.3 else ""), 0)
        if kind == 11:
            return f"<noscript><p>{w(4, 12)}</p></noscript>"
        return self.named("div", ["ad", "notice", "promo"], f"<p>{w(5, 60)}</p>" * r.randrange(1, 3), 0)

    def block(self) -> str:
        r, w, m = self.r, self.words, self.main
        kind = r.randrange(12)
        if kind < 7:
            text = w(4, 200 if r.random() < 0.4 else 60)
            if r.random() < 0.3:
                half = len(text) // 2
                text = text[:half] + r.choice([" <b>{}</b> ", ' <a href="/y">{}</a> ', " <em>{}</em> ", "<br>{}", " &amp; {} "]).format(w(1, 4)) + text[half:]
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(m(text))
        if kind == 7:
            return f"<h2>{m(w(1, 7))}</h2>"
        if kind == 8:
            return "<{0}>{1}</{0}>".format(r.choice(["ul", "ol"]), "".join(f"<li>{m(w(2, 20))}</li>" for _ in range(r.randrange(2, 6))))
        if kind == 9:
            return f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(m(w(5, 50)))}</blockquote>"
        if kind == 10:
            return "<table>" + "".join(f"<tr><td>{m(w(1, 3))}</td><td>{m(w(1, 4))}</td></tr>" for _ in range(r.randrange(2, 5))) + "</table>"
        return f"<pre>{m(w(3, 20))}</pre>"

    def page(self) -> str:
        r, w = self.r, self.words
        title = w(2, 12)
        head = f"<h1>{self.main(title)}</h1>"
        if r.random() < 0.15:
            head = f"<header>{head}</header>"
        inner = [self.block() for _ in range(r.randrange(0 if r.random() < 0.1 else 1, 14))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner.insert(r.randrange(len(inner) + 1), self.clutter())
        body = head + "".join(inner)
        shape = r.randrange(6)
        if shape < 3:
            body = self.named("article", ["post", "entry", "story"], body, 0.7)
        elif shape == 3:
            body = self.named("main", ["main", "content"], body, 0.6)
        elif shape == 4:
            body = self.named("div", ["content", "article-body", "post", "entry-content", "main-content", "story"], body, 0.1)
        else:
            body = f'<main><section class="article">{body}</section></main>'
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.named("div", ["wrapper", "container", "page", "row", "col"], body, 0.3)
        above = "".join(self.clutter() for _ in range(r.randrange(0, 5)))
        below = "".join(self.clutter() for _ in range(r.randrange(0, 5)))
        foot = f"<footer>&copy; {w(3, 40)}</footer>" if r.random() < 0.6 else ""
        nav = f"<nav><ul>{self.links(r.randrange(2, 9))}</ul></nav>" if r.random() < 0.6 else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{nav}{above}{body}{below}{foot}</body></html>"


def training_pages(n: int, seed: int) -> list[str]:
    composer = Composer(seed)
    return [composer.page() for _ in range(n)]


def labelled(page: str) -> tuple[list[Node], np.ndarray, str]:
    """Nodes of a composed page without its marks, whether each holds main text, and the main text."""
    marked = [n for n in parse(page)]
    inside, wanted = False, []
    for node in marked:
        if node.tag == "#text":
            wanted.append("\x01" in node.text or inside)
            last = max(node.text.rfind("\x01"), node.text.rfind("\x02"))
            if last >= 0:
                inside = node.text[last] == "\x01"
    nodes = parse(page.replace("\x01", "").replace("\x02", ""))
    leaves = [n for n in nodes if n.tag == "#text"]
    y = np.zeros(len(nodes))
    for leaf, main in zip(leaves, wanted):
        up: Node | None = leaf
        while main and up and not y[up.index]:
            y[up.index] = 1
            up = up.parent
    return nodes, y, " ".join(leaf.text for leaf, main in zip(leaves, wanted) if main)


@lru_cache(2)
def trained(pages: int = 500, seed: int = 20240607) -> BoostedTrees:
    rows, labels = [], []
    for page in training_pages(pages, seed):
        nodes, y, _ = labelled(page)
        rows.append(describe(nodes))
        labels.append(y)
    x, y = np.concatenate(rows), np.concatenate(labels)
    return train(x, y, np.ones(len(y)))


def extract(pages: list[str], model: BoostedTrees) -> list[str]:
    found: list[str] = []
    waiting: list[list[Node]] = []

    def settle() -> None:
        if waiting:
            p = model.probability(np.concatenate([describe(t) for t in waiting]))
            ends = np.cumsum([len(t) for t in waiting])
            found.extend(main_text(t, p[e - len(t) : e]) for t, e in zip(waiting, ends))
            waiting.clear()

    for page in pages:
        nodes = parse(page)
        if len(nodes) + sum(map(len, waiting)) > SLICE_NODES:
            settle()
        if len(nodes) > SLICE_NODES:
            found.append(main_text(nodes, np.concatenate([model.probability(x) for x in described(nodes)])))
        else:
            waiting.append(nodes)
    settle()
    return found


def extract_pages(pages: DataFrame, model: BoostedTrees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`, from its whole html.

    Null and empty pages have an empty text, and so has a page without main text; ids and URLs may be null and are passed
    on; repeated rows stay; an empty table gives no rows; other columns aren't looked at.
    """
    model = model or trained()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    id_type = source.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in batches_of(batch, "html", 1_000_000):
                found = extract(texts, model)
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
