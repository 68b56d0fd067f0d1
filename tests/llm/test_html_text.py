import re
from html import unescape

import pytest

from plansheet.llm import html_text as H
from plansheet.llm import queries

SCHEMA = "html string, page_id long, url string, b int, text string"


def text(page):
    blocks, _, rooted = H.parse(page)
    return H._content(blocks, rooted)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; <b>simple</b>\n text &lt;x&gt;", "plain & simple text <x>"),
        ("<p>one<p>two <br> three</p>four", "one\ntwo three\nfour"),
        ("<nav>menu</nav><article><h1>T</h1><p><b>a<br><p>b</article><footer>f</footer>", "T\na\nb"),
        ("<main><header><h1>T</h1><span>by me</span></header><p>x</p><aside>s</aside><div class='comments'><p>c</p></div></main>", "T\nx"),
        ('<div id="sideBar">s</div><div class="post-body">x</div><div class="adBox">y</div>', "x"),
        ("<script>var t='</p><p>no';</script><p>yes</p><style>p{}</style><!-- <p>no</p> -->", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("<p>a</p><form><input><p>no</p></form><p hidden>no</p><div role=banner>no</div><div style='display:none'>no</div><p>z", "a\nz"),
        ("<p title='a>b'>x&nbsp;&#x41;&copy;</p> 1 < 2 </p>", "x A©\n1 < 2"),
        ("<p>read</p><!-- open <p>no", "read"),
        ("<p>a</p><script>open", "a"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_long_pages_take_linear_time():
    assert len(text("<div><p>" * 30_000 + "x")) == 1
    assert text("<" * 100_000 + "<p>x") .endswith("x")
    assert text('<p title="' + "a" * 500_000) == ""


def test_templates_are_removed_by_host_counts(spark):
    rows = []
    for i in range(30):
        body = f"<div><span>Site slogan</span></div><div><p>Article number {i} says something.</p><p>Shared line.</p></div><div><p>About us</p><p>Legal</p></div>"
        rows.append((body, i, "http://www.Big.example/a", 0, ""))
    rows += [("<div><p>Copied page</p></div>", 100 + i, "https://copies.example/x", 0, "") for i in range(40)]
    rows += [("<div><p>Site slogan</p></div><p>other host</p>", 200, None, 0, ""), (None, 201, "x", 0, ""), ("", 202, "", 0, ""), ("<p>twice</p>", 203, "http://t/", 0, ""), ("<p>twice</p>", 203, "http://t/", 0, ""), ("<article><p>" + "long " * 100_000, None, "http://l/", 0, "")]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for i in range(30):
        assert by[i].text == f"Article number {i} says something."  # no article element: what recurs on the host goes
    assert by[100].text == "Copied page" and by[200].text == "Site slogan\nother host"
    assert by[201].text == by[202].text == "" and by[None].n_chars == 499_999
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def bare_pages(n):
    """Pages without an article element and without telling names; the menu is drawn from a set of three."""
    menus = [["Home", "News"], ["Home", "Sport"], ["Start", "Culture"]]
    for i in range(n):
        menu = "".join(f'<li><a href="/{i}/{k}">{k}</a></li>' for k in menus[i % 3])
        yield f"<div><ul>{menu}</ul></div><div><h2>Story {'abcdefghijkl'[i]}</h2><p>{'Some words. ' * (i + 1)}</p></div><section><p>Page {i} of {n}</p></section>", f"Story {'abcdefghijkl'[i]}\n{' '.join(['Some words.'] * (i + 1))}"


def test_counting_carries_the_result_where_names_say_nothing(spark):
    pages, want = zip(*bare_pages(9), strict=True)
    df = spark.createDataFrame([(h, i, "https://few.example/x", 0, "") for i, h in enumerate(pages)], SCHEMA)
    by = lambda **k: [r.text for r in sorted(H.extract(df, **k).collect(), key=lambda r: r.page_id)]
    assert by() == list(want) == by(rules=False)
    assert not any(a == b for a, b in zip(by(counting=False), want, strict=True))


def test_query_against_a_plain_reading(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.QUERIES["op10_html_extraction"](spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n".join(x for x in parts if x) and got[p.page_id].url == p.url
