"""Raw HTML to a tree of blocks with their text, and trees aligned by simple tree matching."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np

# fixed values of HTML: void elements, elements whose content is no markup, block elements, and what a start tag closes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt listing main menu nav ol p pre search section summary table ul".split())
BLOCK = ENDS_P | frozenset("html head body caption colgroup legend noscript optgroup option tbody td template tfoot th thead tr".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "optgroup": ("select",)}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
# fixed values: elements, roles and words in class and id that mark what is no article
CHROME_TAGS = frozenset("head nav footer aside form noscript template dialog menu button select svg object canvas audio video map fieldset search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead banner topbar toolbar cookie cookies consent gdpr notice notices notification alert "
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted social share sharing related recommended recommendations "
    "comment comments commentlist respond reply replies disqus newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager paging skip search searchbox form copyright".split()
)
MAIN_WORDS = frozenset("articlebody entrycontent postcontent postbody storybody articlecontent articletext contentbody maincontent pagecontent".split())
#: Elements nested deeper become siblings at this depth, as in browsers.
DEEPEST = 256

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?P<close>>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    block: bool
    label: str
    #: chrome by element or role, by a word in class or id; main by element or role, by a word
    chrome: bool
    chrome_word: bool
    main: int


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (number of the block, node, text, inside a link), in page order
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)


def _node(tag: str, attrs: str, parent: int, block: bool) -> Node:
    classes, name, chrome, word, main = "", "", tag in CHROME_TAGS, False, 2 if tag == "article" else 1 if tag == "main" else 0
    if attrs and not attrs.isspace():
        for key, *values in _ATTR.findall(attrs):
            key, value = key.lower(), "".join(values)
            if key == "class":
                classes = classes or value
            elif key == "id":
                name = name or value
            elif key == "role":
                chrome = chrome or value.lower() in CHROME_ROLES
                main = max(main, {"main": 1, "article": 2}.get(value.lower(), 0))
            elif key == "itemprop":
                main = max(main, 2 * (value.lower() == "articlebody"))
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                chrome = True
        if (classes or name) and tag not in ("html", "body"):
            for one in f"{classes} {name}".split():
                parts = [p for p in _PARTS.split(_HUMP.sub("-", one).lower()) if p]
                if parts and parts[0] not in ("has", "with", "no", "is"):
                    word = word or not CHROME_WORDS.isdisjoint(parts)
                    if not main and "".join(parts) in MAIN_WORDS:
                        main = -1
    label = tag
    if block and (classes or name):
        label = _DIGITS.sub("#", f"{tag}.{'.'.join(sorted(set(classes.lower().split())))}#{'.'.join(name.lower().split())}")
    return Node(tag, parent, block, label, chrome, word, main)


def parse(html: str) -> Page:
    """Tree and text of a page, for any input: what is no tag is text, open elements end with the page."""
    page = Page([Node("", -1, True, "", False, False, 0)])
    nodes, runs = page.nodes, page.runs
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, nearest node that counts, inside a link
    block, at, size = 0, 0, len(html)

    def pop_to(index: int) -> None:
        nonlocal block
        if any(t in BLOCK for t, _, _ in stack[index:]):
            block += 1
        del stack[index:]

    def close(tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                found = k
            elif stack[k][0] in bounds or (stack[k][0] in ("table", "template", "button") and found == 0):
                break
        if found:
            pop_to(found)

    def add(text: str) -> None:
        if text:
            _, node, link = stack[-1]
            runs.append((block, node, unescape(text) if "&" in text else text, link))

    while at < size:
        tag = _TAG.search(html, at)
        if tag is None:
            add(html[at:])
            break
        add(html[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None or not tag["close"]:  # a comment, or a tag that the page's end cuts off
            continue
        name = name.lower()
        if tag["end"]:
            _end(name, stack, pop_to)
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            pop_to(len(stack) - 1)
        if name in ("html", "head", "body") and any(t == name for t, _, _ in stack):
            continue
        if name in ENDS_P:
            close(("p",), ("td", "th", "caption"))
        if name in CLOSES:
            close(CLOSES[name], SCOPE.get(name, ("table",)))
        if name in HEADINGS and stack[-1][0] in HEADINGS:
            pop_to(len(stack) - 1)
        if name in BLOCK or name in ("br", "hr"):
            block += 1
        if name in RAW:
            ended = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = ended.end() if ended else size
            continue
        if name in VOID or (tag["attrs"].endswith("/") and name in ("path", "circle", "rect", "use")):
            continue
        if len(stack) > DEEPEST:
            pop_to(DEEPEST)
        _, parent, link = stack[-1]
        made = _node(name, tag["attrs"], parent, name in BLOCK)
        if made.block or made.chrome or made.chrome_word or made.main:
            nodes.append(made)
            parent = len(nodes) - 1
        stack.append((name, parent, link or name == "a"))
    return page


def _end(name: str, stack: list, pop_to) -> None:
    tags = HEADINGS if name in HEADINGS else (name,)
    for k in range(len(stack) - 1, 0, -1):
        tag = stack[k][0]
        if tag in tags:
            if name not in ("html", "body"):  # what follows them still belongs to them
                pop_to(k)
            return
        if (name not in BLOCK and name not in CHROME_TAGS and tag in BLOCK) or (name in ("p", "li", "dd", "dt") and tag in ("td", "th", "table", "ul", "ol", "dl")):
            return


def shape(page: Page) -> tuple[str, list[int]]:
    """The tree of the page's block elements with runs of equal siblings folded into one, as text, and each node's place in it.

    One line for each folded node, in page order: its depth and its label.
    """
    nodes = page.nodes
    children: list[list[int]] = [[] for _ in nodes]
    above = [0] * len(nodes)  # nearest block element
    for i in range(1, len(nodes)):
        p = nodes[i].parent
        above[i] = p if nodes[p].block else above[p]
        if nodes[i].block:
            children[above[i]].append(i)
    kinds: dict[tuple, int] = {}
    kind = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].block:
            folded = []
            for c in children[i]:
                if not folded or folded[-1] != kind[c]:
                    folded.append(kind[c])
            kind[i] = kinds.setdefault((nodes[i].label, tuple(folded)), len(kinds))
    # folded nodes: the first of each run; the others' descendants fall on the first's
    place = [0] * len(nodes)
    slots: dict[tuple[int, int], int] = {}
    labels, parents = [nodes[0].label], [-1]
    for i in range(len(nodes)):
        if not nodes[i].block:
            place[i] = place[above[i]]
            continue
        run, before = -1, None
        for c in children[i]:
            if kind[c] != before:
                run, before = run + 1, kind[c]
            key = (place[i], run)
            if key not in slots:
                slots[key] = len(labels)
                labels.append(nodes[c].label)
                parents.append(place[i])
            place[c] = slots[key]
    order, depth, under = [], [0] * len(labels), [[] for _ in labels]
    for i in range(1, len(labels)):
        depth[i] = depth[parents[i]] + 1
        under[parents[i]].append(i)
    open_ = [0]
    while open_:
        i = open_.pop()
        order.append(i)
        open_.extend(reversed(under[i]))
    number = {i: n for n, i in enumerate(order)}
    return "\n".join(f"{depth[i]} {labels[i]}" for i in order), [number[p] for p in place]


def _read(text: str) -> tuple[list[str], list[list[int]], list[int]]:
    labels, children, parents, path = [], [], [], []
    for i, line in enumerate(text.split("\n")):
        depth, label = line.split(" ", 1)
        del path[int(depth) :]
        labels.append(label)
        children.append([])
        parents.append(path[-1] if path else -1)
        if path:
            children[path[-1]].append(i)
        path.append(i)
    return labels, children, parents


class TreeMatch:
    """Simple tree matching: the largest mapping of two trees that keeps labels, parents and the order of siblings."""

    def __init__(self, first: str, second: str):
        self.first, self.second = _read(first), _read(second)
        kinds: dict[tuple, int] = {}
        self.kinds = []
        for labels, children, _ in (self.first, self.second):
            kind = [0] * len(labels)
            for i in range(len(labels) - 1, -1, -1):
                kind[i] = kinds.setdefault((labels[i], tuple(kind[c] for c in children[i])), len(kinds))
            self.kinds.append(kind)
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    def weight(self, a: int, b: int) -> int:
        """Nodes matched below and with a and b."""
        return 1 + int(self._table(a, b)[-1, -1]) if self.first[0][a] == self.second[0][b] else 0

    def _table(self, a: int, b: int) -> np.ndarray:
        key = (self.kinds[0][a], self.kinds[1][b])
        if key not in self.tables:
            left, right = self.first[1][a], self.second[1][b]
            found: dict[tuple[int, int], int] = {}
            table = np.zeros((len(left) + 1, len(right) + 1), np.int64)
            for i, x in enumerate(left):
                row = np.zeros(len(right), np.int64)
                for j, y in enumerate(right):
                    if self.first[0][x] == self.second[0][y]:
                        pair = (self.kinds[0][x], self.kinds[1][y])
                        if pair not in found:
                            found[pair] = self.weight(x, y)
                        row[j] = found[pair]
                # the best of the row so far, with or without this pair
                table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + row))
            self.tables[key] = table
        return self.tables[key]

    def pairs(self) -> dict[int, int]:
        """Node of the second tree -> its partner in the first."""
        out, open_ = {}, [(0, 0)] if self.first[0][0] == self.second[0][0] else []
        while open_:
            a, b = open_.pop()
            out[b] = a
            table, left, right = self._table(a, b), self.first[1][a], self.second[1][b]
            i, j = len(left), len(right)
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    open_.append((left[i], right[j]))
        return out


@lru_cache(maxsize=10_000)
def slots(template: str, page: str) -> tuple[int, ...]:
    """For each folded node of ``page`` the node of ``template`` it is aligned with; without partner a negative number that stands for its labels' path."""
    import xxhash

    pairs = TreeMatch(template, page).pairs()
    labels, _, parents = _read(page)
    path = []
    for i, label in enumerate(labels):
        path.append(xxhash.xxh3_64_intdigest(label, path[parents[i]] if i else 0))
    return tuple(pairs[i] if i in pairs else -1 - (path[i] >> 2) for i in range(len(labels)))
