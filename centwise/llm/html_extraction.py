"""The main text of web pages: a wrapper for each host, induced by aligning its pages' trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centwise.llm.html_tree import HEADINGS, Page, parse, shape, slots
from centwise.llm.tokens import rows
from centwise.llm.url_filters import host
from centwise.storage import cut

#: A slot's text is template if at least this percent of the host's different pages hold it there, of this many pages at least.
SHARE, PAGES = 80, 5


class Blocks:
    """The blocks of a page that may be article: for each its text, its node, how much of it is in links."""

    def __init__(self, page: Page):
        nodes = page.nodes
        n = len(nodes)
        holds_main = [False] * n
        for i in range(n - 1, 0, -1):
            if nodes[i].main > 0 and not nodes[i].chrome_word or holds_main[i]:
                holds_main[nodes[i].parent] = True
        chrome, word, main, heading, header = [False] * n, [False] * n, [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            node, p = nodes[i], nodes[i].parent
            tag_chrome = node.chrome or (node.tag == "header" and main[p] <= 0)
            chrome[i] = chrome[p] or (tag_chrome and not (node.tag in ("header", "form") and holds_main[i]))
            word[i] = word[p] or (node.chrome_word and not holds_main[i])
            main[i] = max(main[p], node.main) if node.main > 0 else main[p] or node.main
            heading[i] = heading[p] or node.tag in HEADINGS
            header[i] = header[p] or (node.tag == "header" and main[p] > 0)  # an article's own header: its headings count
        own = lambda k: not chrome[k] and (not header[k] or heading[k])
        runs = [r for r in page.runs if own(r[1]) and not word[r[1]]]
        if not any(not r[2].isspace() for r in runs):  # all that the page has is marked: the words in classes misled
            runs = [r for r in page.runs if own(r[1])]
        levels = {main[r[1]] for r in runs if not r[2].isspace()}
        level = next((x for x in (2, 1, -1) if x in levels), 0)
        self.marked = level != 0
        self.found: list[tuple[str, int, int]] = []
        self.heading: list[bool] = []
        text: list[str] = []
        number, node, linked = None, 0, 0
        for block, at, piece, link in runs:
            if main[at] != level and self.marked:
                continue
            if block != number:
                self._put(text, node, linked, heading)
                text, number, node, linked = [], block, at, 0
            text.append(piece)
            linked += len("".join(piece.split())) if link else 0
        self._put(text, node, linked, heading)

    def _put(self, text, node, linked, heading) -> None:
        whole = " ".join("".join(text).split())
        if whole:
            self.found.append((whole, node, linked))
            self.heading.append(heading[node])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches, 128):
        out: list[tuple] = []
        for site, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = parse(html.as_py() or "")
            tree, place = shape(page)
            found = {(place[node], _hash(text)) for text, node, _ in Blocks(page).found}
            places, hashes = zip(*sorted(found)) if found else ((), ())
            out.append((site, tree, _hash(f"{tree}\n{places}{hashes}"), places, hashes))
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "tree", "page", "places", "hashes"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches, 4096):
        hosts, at, found = [], [], []
        for site, template, tree, places, hashes in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "tree", "places", "hashes"))):
            to = slots(template, tree)
            for slot, text in {(to[p], h) for p, h in zip(places, hashes)}:
                hosts.append(site)
                at.append(slot)
                found.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(at, pa.int64()), pa.array(found, pa.int64())], ["host", "slot", "text"])


def _site(pages: DataFrame) -> Column:
    """The page's host; null where the URL has none."""
    return F.when(host(pages["url"].cast("string")) != "", host(pages["url"].cast("string")))


def wrappers(pages: DataFrame, share: int = SHARE, least: int = PAGES) -> DataFrame:
    """host, template, constants of every host of ``pages`` (url, html) whose pages share text.

    ``template`` is the tree that most of the host's pages have (of equal ones
    the last in order), runs of equal siblings folded into one slot.  Every other
    tree of the host is aligned with it by simple tree matching.  ``constants``
    are the (slot, text hash) that ``share`` percent of the host's different
    pages hold, of ``least`` pages at least; other slots vary.  Exact copies of a
    page count once.  There are at most 100/``share`` constants a host for each
    block of its average page.
    """
    seen = cut(pages.select(_site(pages).alias("host"), pages["html"].alias("html")).where("host IS NOT NULL").mapInArrow(_survey, "host string, tree string, page bigint, places array<int>, hashes array<bigint>"), "page-trees")
    trees = seen.groupBy("host", "tree").count().groupBy("host").agg(F.max(F.struct("count", "tree")).alias("m")).select("host", F.col("m.tree").alias("template"))
    different = seen.groupBy("host", "page").agg(F.first(F.struct("tree", "places", "hashes")).alias("p")).select("host", "p.*")
    sizes = different.groupBy("host").count().where(F.col("count") >= least)
    known = cut(trees.join(sizes, "host"), "host-trees")
    placed = different.join(known.select("host", "template"), "host").mapInArrow(_placed, "host string, slot bigint, text bigint")
    often = placed.groupBy("host", "slot", "text").agg(F.count("*").alias("n")).join(known.select("host", "count"), "host").where(100 * F.col("n") >= share * F.col("count"))
    constants = often.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("constants"))
    return known.select("host", "template").join(constants, "host")


def article(page: Page, template: str | None = None, constants: frozenset[tuple[int, int]] = frozenset()) -> str:
    """A page's main text under its host's wrapper.

    Where the page marks its article (``article``, ``main``, a role, an item
    property or a class name such as entry-content), that is the candidate,
    elsewhere all that is not marked as chrome; constant slots go.  In a marked
    article headings stay, and it stays whole if constants are more than half of
    it: the pages are copies then.  Without a mark, blocks that are mostly links
    go as well.
    """
    blocks = Blocks(page)
    constant = [False] * len(blocks.found)
    if constants:
        tree, place = shape(page)
        to = slots(template, tree)
        constant = [(to[place[node]], _hash(text)) in constants for text, node, _ in blocks.found]
    if blocks.marked:
        drop = [c and not h for c, h in zip(constant, blocks.heading)]
        if 2 * sum(len(b[0]) for b, d in zip(blocks.found, drop) if d) > sum(len(b[0]) for b in blocks.found):
            drop = [False] * len(drop)
    else:
        drop = [c or 2 * linked > len(text.replace(" ", "")) for c, (text, _, linked) in zip(constant, blocks.found)]
        if all(drop):  # copies of one page, or a page of links
            drop = [False] * len(drop)
    return " ".join(text for (text, *_), d in zip(blocks.found, drop) if not d)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches, 64):
        texts = []
        templates, lists = batch.column("template").to_pylist(), batch.column("constants").to_pylist()
        for html, template, found in zip(batch.column("html"), templates, lists):
            texts.append(article(parse(html.as_py() or ""), template, frozenset((c["slot"], c["text"]) for c in found or ())))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, share: int = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    ``text`` is the article without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments: what the page's own marks leave
    (see ``article``), without what ``wrappers`` found constant on its host.
    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space in page order.

    Null, empty and text-less pages give an empty text; any input is parsed, open
    elements end with the page.  A null URL, or one without host, has no wrapper.
    page_id is passed through, null or repeated; other columns are not looked at;
    no rows give no rows.
    """
    given = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"), _site(pages).alias("site"))
    found = cut(wrappers(pages, share, least), "wrappers")
    joined = given.join(found, given["site"] == found["host"], "left").select("page_id", "url", "html", "template", "constants")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    return joined.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
