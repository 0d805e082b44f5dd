"""The HTML tree: any input gives one; cleaning, selecting, rendering."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.sources import dom


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp dliv='\"!-&;\n", max_size=80))
def test_any_text_gives_a_tree(text):
    root = dom.parse(text)
    dom.markdown(dom.sanitize(text, "https://x.org/"))
    dom.links(root), dom.tables(root), dom.images(root), dom.code_blocks(root), dom.formulas(root)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="<>/abp dliv='\"!-&;\n", max_size=60))
def test_cleaning_twice_is_cleaning_once(text):
    once = dom.sanitize(text).html()
    assert dom.sanitize(once).html() == dom.sanitize(dom.sanitize(once).html()).html()


def test_sanitize():
    html = "<!--c--><script>x</script><nav>n</nav><div class='sidebar'>s</div><main class=reading><p style='a'>keep</p><a href='/p'>l</a><pre class='nav'>code</pre></main><footer>f</footer>"
    out = dom.sanitize(html, "https://x.org/d/").html()
    assert all(x not in out for x in ("<script", "<nav", "sidebar", "footer", "<!--", "style="))
    assert "keep" in out and 'href="https://x.org/p"' in out and "code" in out


def test_media_and_math():
    out = dom.sanitize("<iframe src='https://www.youtube.com/embed/abcdefghijk'></iframe><img data-src='a.png' src='data:image/gif;base64,R0'><script type='math/tex; mode=display'>x^2</script>", "https://x.org/")
    assert out.find("a").attrs["href"] == "https://www.youtube.com/watch?v=abcdefghijk"
    assert out.find("img").attrs["src"] == "https://x.org/a.png"
    assert "$$x^2$$" in out.text()


def test_selectors():
    root = dom.parse("<div id=a class='x y'><p>1</p><section><p>2</p></section></div><p lang='en-GB'>3</p>")
    text = lambda s: [n.text() for n in dom.select(root, s)]
    assert text("p") == ["1", "2", "3"]
    assert text("#a > p") == ["1"] and text(".x.y p") == ["1", "2"] and text('[lang^="en"], section p') == ["2", "3"]
    assert dom.extract(root, dom.normalize_config({"all": "p", "one": {"selector": "h1"}, "none": {"multiple": True}})) == {"all": ["1", "2", "3"], "one": [None], "none": []}


def test_markdown():
    html = "<body><h2>T</h2><p>a <b>bold</b> <i>it</i></p><ul><li>x</li><li>y<ol><li>z</li></ol></li></ul><blockquote>q</blockquote><table><tr><th>h|</th></tr><tr><td>c</td></tr></table><pre><code class='language-go'>f()</code></pre></body>"
    out = dom.markdown(dom.parse(html))
    for piece in ("## T", "a **bold** *it*", "- x\n- y", "1. z", "> q", "| h\\| |\n| --- |\n| c |", "```go\nf()\n```"):
        assert piece in out, piece


def test_main_content_needs_text():
    assert dom.main_content(dom.parse("<body><main>x</main><article>long enough a text</article></body>")).tag == "article"
    assert dom.main_content(dom.parse("<p>no body</p>")).tag == ""


def test_video_pages():
    forms = {
        "https://www.youtube.com/embed/abcdefghijk?x=1": "https://www.youtube.com/watch?v=abcdefghijk",
        "https://youtube.com/shorts/abcdefghijk": "https://www.youtube.com/watch?v=abcdefghijk",
        "http://youtu.be/abcdefghijk": "https://www.youtube.com/watch?v=abcdefghijk",
        "https://player.vimeo.com/video/123": "https://vimeo.com/123",
        "https://player.bilibili.com/player.html?a=1&bvid=BV1xx": "https://www.bilibili.com/video/BV1xx",
        "https://player.bilibili.com/player.html?aid=42": "https://www.bilibili.com/video/av42",
        "https://www.bilibili.com/video/BV1yy/": "https://www.bilibili.com/video/BV1yy",
        "https://bilibili.com/video/av7": "https://www.bilibili.com/video/av7",
        "https://youtu.be/short": "https://youtu.be/short",
        "https://x.org/?u=https://youtu.be/abcdefghijk": "https://x.org/?u=https://youtu.be/abcdefghijk",
    }
    assert {src: dom.video_page(src) for src in forms} == forms


def test_sharing_widgets_go():
    assert "gone" not in dom.sanitize("<div class='sharing-widget'>gone</div><p>kept</p>").html()


def test_plain_markdown():
    html = "<nav>n</nav><p>one\n two</p><table><tr><th>k</th></tr><tr><td>a|b</td></tr><tr></tr></table><style>s</style>end"
    assert dom.plain_markdown(html) == "one\n\ntwo\n\n| k |\n| --- |\n| a\\|b |\n\nend"
    assert dom.plain_markdown(None) == dom.plain_markdown("") == "" and dom.plain_markdown("<table></table>") == ""


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/abp tablerd='\"!-&;\n", max_size=80))
def test_any_text_has_plain_markdown(text):
    dom.plain_markdown(text)


def test_presets():
    from lectern.sources.presets import PRESETS, preset

    page = dom.parse("<main><h1>T</h1><article><p>one</p><p>two</p></article><time datetime='2020-01-01'>then</time><a rel=tag>x</a><a rel=tag>y</a></main>")
    found = dom.extract(page, dom.normalize_config(preset("article")))
    assert found["title"] == ["T"] and found["published"] == ["2020-01-01"] and found["paragraphs"] == ["one", "two"] and found["tags"] == ["x", "y"] and found["author"] == [None]
    assert len(PRESETS) == 10 and all(dom.extract(page, dom.normalize_config(preset(k))) is not None for k in PRESETS)
    preset("article")["title"]["selector"] = "h2"
    assert preset("article")["title"]["selector"] == "h1"
