"""HTML extraction: parser and tree matching against plain versions, wrappers on planted sites, the given pages against their article element."""

import html as entities
import random
import re
from functools import lru_cache

import pytest

from centwise.llm.html_extraction import article, extract_text, wrappers
from centwise.llm.html_tree import TreeMatch, parse, shape, slots

DATA = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta", "to") for b in ("ber", "dan", "fol", "gis", "hem", "jun", "kel")]


def text_of(html):
    return article(parse(html))


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain  text\n here", "plain text here"), ("a < b &amp; c &lt;p&gt; d&nbsp;e &#8364; &bogus;", "a < b & c <p> d e € &bogus;"),
    ("<p>one<p>two<b>bo</b>ld", "one twobold"), ("<p><b>open<br><p>next</b> end", "open next end"), ("<div>a<div>b</div>c</div>d", "a b c d"),
    ("<article>x<script>if (a < b) '</p>'</script><style>p{}</style><!-- no <p>not</p> --> y</article>", "x y"),
    ("<article>x<script>never ended <p>y", "x"), ("<article>x<!-- never ended <p>y", "x"), ("<article>x<p class='a' title=\"1>2\">y</article>", "x y"),
    ("<article>x <textarea>in <b>form</b></textarea><button>Go</button><select><option>1<option>2</select>y</article>", "x y"),
    ("<nav>menu</nav><header>site</header><main><aside>side</aside><p>body</p><form>f</form></main><footer>foot</footer>", "body"),
    ("<div class=siteNav>m</div><div id=top-banner>t</div><article><header><h1>Title</h1><p>by X</header><p>body<p class='ad-slot'>buy</p></article><section id=comments><p>first!</section>", "Title body"),
    ("<body class='page has-sidebar'><div class='header-layout'><main><p>kept</p></main></div><div class=sidebar>s</div>", "kept"),
    ("<div class='menu'><p>only marked text</p></div>", "only marked text"), ("<div class='entry-content'><p>body</p></div><p>other</p>", "body"),
    ("<div role=main>m</div><div role=navigation>n</div><div hidden>h</div><div style='display: none'>d</div>", "m"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p>it's <a href='x>y'>li</a>nk", "it's link"),
    ("</p></div>stray</b>", "stray"), ("<p>cut off <a href='never", "cut off"), ("<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>words that are no links</p>", "words that are no links"),
    ("<article><p>see <a href=1>all of this</a></article>", "see all of this"), ("<svg><text>icon</text></svg><p>x</p>", "x"), ("<h1>t<h2>u</h1>v", "t u v"),
])
def test_texts(html, text):
    assert text_of(html) == text


def test_any_input_ends():
    r = random.Random(4)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<a href='", "\"", "'", ">", "<", "<!--", "-->", "<li>", "<table>", "</table>", "<td>", "=", "x", " ", "&#x0;", "&", "<article>", "</article>", "<br/>", "<script>", "</script >", "\x00", "<html>", "<head>", "<body>"]
    for _ in range(400):
        html = "".join(r.choices(bits, k=r.randint(1, 60)))
        page = parse(html)
        tree, place = shape(page)
        assert len(place) == len(page.nodes) and slots(tree, tree) == tuple(range(tree.count("\n") + 1))
        article(page)


def test_deep_wide_and_long_pages():
    deep = "<div>" * 20_000 + "in" + "</div>" * 20_000 + "<p>out"
    tree, _ = shape(parse(deep))
    assert text_of(deep) == "in out" and slots(tree, tree)
    wide = "<article>" + "<h2>h</h2><p>p</p><p>q</p>" * 4_000 + "</article>"
    assert text_of(wide).count("h p q") == 4_000 and slots(shape(parse(wide))[0], tree)
    long = "<article><p>" + "word " * 400_000 + "</article>"
    assert len(text_of(long)) == 5 * 400_000 - 1
    assert text_of("<a b='" * 3_000) == "" and text_of("<p " + "x=\"" * 20_001 + ">t") in ("t", "")


def plain_match(first, second):
    """Simple tree matching by its definition, on nested (label, children)."""

    @lru_cache(None)
    def weight(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1]):
            for j, y in enumerate(b[1]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(x, y))
        return best[-1][-1] + 1

    return weight(first, second)


def tree(r, depth):
    return (r.choice("ab") if depth < 3 else "r", tuple(tree(r, depth - 1) for _ in range(r.randint(0, 3))) if depth else ())


def written(t, depth=0):
    return "\n".join([f"{depth} {t[0]}", *(written(c, depth + 1) for c in t[1])])


def test_tree_matching_equals_its_definition():
    r = random.Random(1)
    for _ in range(150):
        a, b = tree(r, 3), tree(r, 3)
        match = TreeMatch(written(a), written(b))
        pairs = match.pairs()
        assert match.weight(0, 0) == len(pairs) == plain_match(a, b)
        assert len(set(pairs.values())) == len(pairs)
        (la, _, pa), (lb, _, pb) = match.first, match.second
        assert all(la[x] == lb[y] and (y == 0 or pairs[pb[y]] == pa[x]) for y, x in pairs.items())
        ordered = [pairs[y] for y in sorted(pairs)]
        assert ordered == sorted(ordered)


def sentence(r, n=12):
    return " ".join(r.choices(WORDS, k=n)).capitalize() + "."


def soup(r, host, i):
    """A page without any telling name: what repeats on its host is template, the rest is article."""
    body = [sentence(r) for _ in range(r.randint(1, 5))]
    lead = sentence(r, 6)
    top = f"<div><div>Welcome to {host}</div><div>Open daily from nine to five</div></div>"
    box = f"<div><p>Write to us at {host}</p></div>" if i % 2 else ""
    return f"<html><body>{top}{box}<div><h1>{lead}</h1>{''.join(f'<p>{b}</p>' for b in body)}<p>Thanks for reading {host}.</p></div><div><div>All rights with {host}</div></div></body></html>", " ".join([lead, *body])


def test_wrappers_of_sites_without_names(spark):
    r = random.Random(9)
    made = {}
    for host in ("one.test", "two.test"):
        for i in range(30):
            made[len(made)] = (f"https://{host}/{i}", *soup(r, host, i))
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in made.items()], SCHEMA).repartition(6)
    got = {x.page_id: x for x in extract_text(pages).collect()}
    for k, (url, _, text) in made.items():
        # the box is on half of the pages only, so it isn't constant
        want = {text, f"Write to us at {url.split('/')[2]} {text}"}
        assert got[k].text in want and got[k].n_chars == len(got[k].text) and got[k].url == url
    one = {x.host: x for x in wrappers(pages).collect()}
    assert {len(x.constants) for x in one.values()} == {4}
    again = {x.page_id: x.text for x in extract_text(pages.repartition(2)).collect()}
    assert again == {k: x.text for k, x in got.items()}


def test_constants_inside_a_marked_article_go_and_copies_stay(spark):
    r = random.Random(3)
    rows, want = [], {}
    for i in range(12):
        body = " ".join(sentence(r) for _ in range(3))
        rows.append((i, "http://a.test/x", f"<article><h1>News</h1><p>{body}</p><p>Read our paper on Sunday.</p></article>"))
        want[i] = f"News {body}"
    same = sentence(r, 60)
    for i in range(100, 130):  # near copies: constant all but for a word
        rows.append((i, "http://b.test/x", f"<article><p>{same}</p><p>Copy {i}</p></article>"))
        want[i] = f"{same} Copy {i}"
    for i in range(200, 240):  # exact copies
        rows.append((i, "http://c.test/x", f"<div><p>{same}</p></div>"))
        want[i] = same
    for i in range(300, 303):  # too few pages to tell
        rows.append((i, "http://d.test/x", f"<div><p>Fixed text</p><p>{i}</p></div>"))
        want[i] = f"Fixed text {i}"
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {x.page_id: x.text for x in extract_text(pages).collect()} == want


def test_given_pages_against_their_article(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for x in pages.join(extract_text(pages).select("page_id", "text", "n_chars"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", x.html, re.S).group(1)
        inside = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inside))
        assert x.text == " ".join(entities.unescape(inside).split()) and x.n_chars == len(x.text)


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    rows = [(1, None, "<p>a"), (None, "no url", "<p>b"), (2, "http://x.test/", None), (3, "http://x.test/", ""), (3, "http://x.test/", "")]
    pages = spark.createDataFrame(rows, SCHEMA)
    pages = pages.selectExpr("*", "1 AS text", "2 AS host", "3 AS site", "4 AS template", "5 AS `a.b`")
    got = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert got == sorted([(1, None, "a", 1), (None, "no url", "b", 1), (2, "http://x.test/", "", 0), (3, "http://x.test/", "", 0), (3, "http://x.test/", "", 0)], key=str)
    assert extract_text(pages.limit(0)).collect() == []
