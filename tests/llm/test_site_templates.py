import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from eventrate.llm.site_templates import Settings, extract, main_blocks, parse

FOLDER = "/root/testdata/sf0.01"


def blocks(source):
    return main_blocks(parse(source))


def plain_article(source):
    """Article of the generated pages, whose only blocks are p and h1, by cutting the source."""
    inside = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*(?:>|$)", " ", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_pages_by_cutting(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    sources = {r.page_id: r for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(sources)
    for r in got:
        assert (r.url, r.text) == (sources[r.page_id].url, plain_article(sources[r.page_id].html))
        assert r.n_chars == len(r.text)


def test_markup():
    assert blocks("") == [] and blocks("plain <b>words</b>\n &amp;amp; &eacute;&#233;") == ["plain words &amp; éé"]
    assert blocks("<p>a<p>b<br>c<div>d</div>e") == ["a", "b c", "d", "e"]
    assert blocks("<article><p>x</p><script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->y</article>z") == ["x", "y"]
    assert blocks('<div class="cookie-notice">no</div><p class="lead">yes</p><form><label>no</label></form>') == ["yes"]
    assert blocks("<main><header><h1>T</h1></header><p>x</p><aside>no</aside><nav>no</nav></main><footer>no</footer>") == ["T", "x"]
    assert blocks('<article><p>x</p><section id="comments"><article>no</article></section></article>') == ["x"]
    assert blocks("<ul><li>one<li>two</ul></div></p>tail <p") == ["one", "two", "tail"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks('<div role="banner">no</div><div hidden>no</div><a title="a > b">link</a>') == ["link"]
    assert blocks("<p>a\xa0 b\n\tc</p>") == ["a b c"] and blocks("1 < 2 <p>x") == ["1 < 2", "x"]
    assert blocks("<div>" * 20_000 + "deep") == ["deep"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/pdivarticle=\"'&;! -ab\n", max_size=200))
def test_any_markup_is_read(source):
    blocks(source)


def test_what_a_site_repeats_goes(spark):
    def page(i, site, extra):
        return (
            f"<body><div class='x1'>{extra}</div><p>All rights of {site}</p><div><p>Story number {i} of {site}</p></div></body>"
        )

    rows = [(i, f"http://one.example/{i}", page(i, "one", "Home and Contact")) for i in range(12)]
    rows += [(100 + i, f"http://two.example/{i}", page(i, "two", "Home and Contact")) for i in range(5)]
    # Copies of one page are no template.
    rows += [(200 + i, f"http://copy.example/{i}", page(7, "copy", "Welcome")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract(df, Settings(pages=10)).collect()}
    assert got[3] == "Story number 3 of one"
    assert got[101] == "Home and Contact\nAll rights of two\nStory number 1 of two"
    assert got[205] == "Welcome\nAll rights of copy\nStory number 7 of copy"
    from eventrate.runtime import Limits

    assert got == {r.page_id: r.text for r in extract(df, Settings(pages=10), limits=Limits(broadcast_rows=0)).collect()}


def test_edges(spark):
    rows = [(1, None, None), (2, "no host", ""), (None, "http://a.b/", "<p>x</p>"), (3, "http://A.B/", "<p>y</p>"),
            (3, "http://A.B/", "<p>y</p>"), (4, "http://a.b/l", "<p>" + "word " * 100_000 + "</p>")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, n_chars int, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id or 0, r.text[:5], r.n_chars) for r in got.collect()))
    assert found == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "y", 1), (3, "y", 1), (4, "word ", 499_999)]
    assert extract(df.limit(0)).collect() == []
