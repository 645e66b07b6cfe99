"""Wrappers of common page themes, and what recurs on hosts small and large."""

from eventrate.llm.site_templates import extract, main_blocks, parse


def blocks(source):
    return main_blocks(parse(source))


def test_layout_wrappers_keep_the_article():
    for wrapper in ('class="content-sidebar-wrap"', 'id="page" class="has-sidebar"', 'class="with-comments"', 'class="sidebar"'):
        assert blocks(f"<div {wrapper}><div class='menu'>no</div><main><p>x</p></main></div>") == ["x"], wrapper
    assert blocks('<article><div class="entry-header"><h1>T</h1></div><div class="header"><p>s</p></div><p>x</p></article>') == ["T", "s", "x"]
    assert blocks('<article class="commentary"><p>x</p></article>') == ["x"]


def test_names_of_other_parts_still_count():
    for name in ("site-header", "cookie_box", "ad-2", "comments-area", "menu"):
        assert blocks(f'<div class="a {name}">no</div><p>x</p>') == ["x"], name
    assert blocks('<article class="comment"><p>no</p></article><main><p>x</p><div id="comments"><article>no</article></div></main>') == ["x"]


def test_recurrence_is_a_share_of_the_host(spark):
    def page(i, n, shared):
        line = "<p>A passage that some pages quote</p>" if i < shared else ""
        return f"<div class='x1'><p>Home</p><p>Contact</p></div><p>Story {i}</p>{line}"

    rows = [(i, "http://large.example/", page(i, 60, 20)) for i in range(60)]
    rows += [(100 + i, "http://small.example/", page(i, 5, 2)) for i in range(5)]
    rows += [(200 + i, "http://tiny.example/", page(i, 2, 0)) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got[3] == "Story 3\nA passage that some pages quote" and got[30] == "Story 30"
    assert got[100] == "Story 0\nA passage that some pages quote" and got[104] == "Story 4"
    assert got[200] == "Home\nContact\nStory 0"
