"""What is inside what in markup that isn't well formed."""

import pytest

from quillwatch.operators import html


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<nav/>z", ""),
        ("a<br/>b<hr/>c", "abc"),
        ("<textarea><nav>x</nav></textarea>y", "<nav>x</nav>y"),
        ("<textarea>a &amp; b</textarea>", "a & b"),
        ("<title>T &lt;</title><p>x", "x"),
        ("<head><title>T</title></head>", "T"),
        ("<nav><footer>a</nav>b", "b"),
        ("</nav>a</footer>b", "ab"),
        ("<nav>a<table><tr><td></nav>b</td></tr></table>c</nav>d", "d"),
        ("<script/>a</script>b", "b"),
        ("<noscript><a href=privacy>x</a></noscript>y", "y"),
        ("<iframe><header></iframe>y", "<header>y"),
        ("<header><p>a<header>b</header>c</header>d", "d"),
        ("<title>t</title>  text <body>more</body> after", "text more after"),
        ("", ""),
    ],
)
def test_text(markup, want):
    page = html._read(markup)
    assert html.page_text(page) == want


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<a href=/a>one<a href=/privacy>two</a>", "/privacy"),
        ("<a href=/a>one<p>our privacy</p></a>", "/a"),
        ("<a href=/a>one</a>privacy <a href=/b>two</a>", None),
        ("<nav><a href=/a>Privacy</a></nav>", "/a"),
        ("<textarea><a href=/privacy>x</a></textarea><a href=/b>hipaa</a>", "/b"),
        ("<noscript><a href=/privacy>x</a></noscript>", None),
        ("<a href=/a/>privacy", "/a/"),
        ("<div><a href=/a>x</div>privacy</a>", None),
    ],
)
def test_links(markup, want):
    assert html.policy_href(html._read(markup)) == want


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<form><input type=email name=a><form><input name=b></form><input name=c></form>", ["a", "b"]),
        ("<div><form><input type=email name=a></div><input name=b></form>", ["a"]),
        ("<table><form><tr><td><input type=email name=a></td></tr></form></table>", None),
        ("<table><tr><td><form><input type=email name=a></form><input name=b></td></tr></table>", ["a"]),
        ("<form><textarea name=t><input name=x></textarea><input type=email name=a></form>", ["t", "a"]),
        ("<form/><input type=email name=a></form>", ["a"]),
        ("<form><label>Con<b>tact</b></label><input name=a>", ["a"]),
        ("<form><label>x</label>contact<input name=a></form>", None),
    ],
)
def test_forms(markup, want):
    form = html.primary_form(html._read(markup), "https://a.org/")
    assert (form and form["fields"]) == want


def test_parts_by_a_lateral_join(spark):
    rows = [(1, '<a href="/x">X  y</a><form action="/s"><input name=q></form><a href="/privacy">p</a><a href="/privacy">again</a>', "https://a.org/b/"), (2, None, None), (3, "<p>none", "https://b.org"), (4, "<form><input type=email name=e></form>", None)]
    got = html.page_parts(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(
        [(1, "link", 0, "/x", "X y", None, False), (1, "form", 0, "https://a.org/s", None, ["q"], False), (1, "link", 1, "/privacy", "p", None, True), (1, "link", 2, "/privacy", "again", None, False), (4, "form", 0, "", None, ["e"], True)],
        key=lambda r: (r[0], r[1], r[2]),
    )


def test_references_without_a_semicolon():
    from quillwatch.operators import html

    markup = '<h1>a &amp; b&amp</h1><a href="/privacy?a=1&copy=2">&lt&#38 &quot;</a><xmp>&amp &amp;</xmp>﷐'
    as_browsers, as_written = html._read(markup), html._read(markup, bare=False)
    assert html.page_text(as_browsers) == 'a & b&<& "&amp &amp;﷐'
    assert html.page_text(as_written) == 'a & b&amp&lt&#38 "&amp &amp;﷐'
    assert html.policy_href(as_written) == "/privacy?a=1&copy=2"


def test_whole_texts(spark, tmp_path):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    from oracle import compare

    from quillwatch.functions import text as texts
    from quillwatch.plans import registry

    shared = "é " * texts.TEXT_CAP
    rows = [(1, "https://a.org/", f"<body><p>{shared}one</p></body>"), (2, "https://a.org/", f"<body><p>{shared}two &amp; <b>more</b></p></body>"), (3, "https://a.org/", "<body>short</body>"), (4, "https://a.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    file = next((tmp_path / "pages.parquet").glob("*.parquet"))
    (tmp_path / "data").mkdir()
    file.rename(tmp_path / "data" / "pages.parquet")
    got = registry.QUERIES["privacy_text_parsed"](spark, f"{tmp_path}/data")
    assert got.select("text_md5").distinct().count() == 4  # the first two are equal up to the cap
    assert compare(spark, f"{tmp_path}/data", registry.QUERIES["privacy_text_parsed"], registry.ORACLES["privacy_text_parsed"]) == 4
    whole = {r["page_id"]: r["text"] for r in html.page_features(pages, cap=None).collect()}
    assert whole == {1: shared + "one", 2: shared + "two & more", 3: "short", 4: ""}
