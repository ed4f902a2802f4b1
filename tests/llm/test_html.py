"""Main text of pages."""

import re
import time

import pytest

from leafgrain.llm.html_text import extract_text, main_text

CASES = {
    "": "",
    "just text &amp; <b>more</b>": "just text & more",
    "<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><nav><a href=/>Menu</a></nav><div class='ad'>Buy now.</div>"
    "<article><h1>Head</h1><p><b>One.<br><p>Two\n  words &eacute;&#8211;&#x41;</p></article><footer>&copy; us</footer>": "Head\nOne.\nTwo words é–A",
    "<header><h1>Site</h1></header><main><article><header><h1>Real</h1></header><p>Body.</p><aside>Aside</aside><form>Name <input></form><p hidden>no</p>"
    "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><section class='comments'><p>I say.</p></section></article></main>": "Real\nBody.\na\nb\nc\nd",
    "<div class='menu'>Home</div><div id='content'><h2>Title</h2><p>A long paragraph, with commas, and stops. It goes on and on, as text does.</p>"
    "<p>Another paragraph, with more to say; it is as long as the first one was.</p></div><div class='cookie-notice'>We use cookies, ok?</div>"
    "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>":
    "Title\nA long paragraph, with commas, and stops. It goes on and on, as text does.\nAnother paragraph, with more to say; it is as long as the first one was.",
    "<article><p>a < b & c</p><!-- <p>no</p> --><p>x<span>y</span>z</p><div>in<p>ner</p>out</div></article>": "a < b & c\nxyz\nin\nner\nout",
    "<p>open <b>tag": "open tag",
    "<article class='comment'><p>Reader says this.</p></article><article><p>The text.</p></article>": "The text.",
    "<div style='display:none'>no</div><p>yes</p><script>never closed": "yes",
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert main_text(page) == CASES[page]


def test_table(spark):
    rows = [(1, "u", page) for page in CASES] + [(None, None, None), (2, "u", "<article>" + "<p>long text.</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    out = extract_text(pages).toPandas()
    assert sorted(out.text) == sorted([*CASES.values(), "", "\n".join(["long text."] * 20_000)])
    assert out.n_chars.tolist() == [len(t) for t in out.text]
    assert extract_text(pages.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?p>|</?h1>", article)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b)


def test_given_pages_without_marks_give_their_articles(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert main_text(r.html.replace("<article>", "").replace("</article>", "")) == main_text(r.html)


LONG = "This paragraph, number {}, goes on for a while; it says something, and then it stops."


@pytest.mark.parametrize("teasers", [1, 3])
def test_marked_teasers_do_not_replace_the_text(teasers):
    body = [LONG.format(n) for n in range(12)]
    cards = "<article class='card'><p>Read this, too.</p></article>" * teasers
    out = main_text("<div>" + "".join(f"<p>{b}</p>" for b in body) + "</div>" + cards).split("\n")
    assert out[:12] == body


def test_short_blocks_of_a_marked_article_stay():
    body, items = [LONG.format(n) for n in range(12)], ["tea", "salt", "oil", "rice"]
    page = "<article>" + "".join(f"<p>{b}</p>" for b in body) + "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul></article><div>Short.</div>"
    assert main_text(page).split("\n")[:16] == body + items


@pytest.mark.parametrize("paths", [3, 60])
def test_one_long_block_does_not_set_the_bar_on_pages_of_any_size(paths):
    body = [LONG.format(n) for n in range(60)]
    rich = "".join(f"<x{n}>item</x{n}>" for n in range(paths))
    page = "<div>" + "".join(f"<p>{b}</p>" for b in body) + "</div>" + rich + "<blockquote>" + "No one is liable, ever; so it is. " * 20 + "</blockquote>"
    assert main_text(page).split("\n")[:60] == body


def test_given_pages_without_tags_and_classes_that_tell(spark):
    """Only ratios and structure are left: `div` for every semantic tag, no class and no id."""
    article = kept = noise = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:nav|article|footer|aside|header|main|section)\b", r"<\1div", r.html)
        want = main_text(r.html).split("\n")
        article += sum(map(len, want))
        for line in main_text(re.sub(r' (?:class|id)="[^"]*"', "", plain)).split("\n"):
            if line in want:
                want.remove(line)
                kept += len(line)
            else:
                noise += len(line)
    assert kept >= 0.95 * article and noise < 0.01 * article


@pytest.mark.parametrize("inner, text", [
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", ["x=1"]), ("<xmp>a <b> &amp; c</xmp>", ["a <b> &amp; c"]),
    ("<p class='legal'>Legal words.</p>", ["Legal words."]), ("<object data=x>Fallback.</object>", ["Fallback."]),
    ("<div class='comments'><p>I say, so.</p></div>", []), ("<div class='ad'>Buy, now.</div>", []),
])
def test_what_stays_inside_an_article(inner, text):
    body = [LONG.format(n) for n in range(5)]
    page = "<article>" + "".join(f"<p>{b}</p>" for b in body) + inner + "<p>End.</p></article>"
    assert main_text(page).split("\n") == [*body, *text, "End."]


def test_class_words_that_enclose_the_article_do_not_remove_it():
    body = "".join(f"<p>{LONG.format(n)}</p>" for n in range(5))
    for head, tail in (("<div class='has-sidebar no-ads'>", "</div>"), ("<form action='/'>", "</form>")):
        assert main_text(head + body + tail).count("\n") == 4
    assert main_text("<div class='ad'>Buy this, and buy it now.</div><article></article><footer>All rights, and so on.</footer>") == ""


@pytest.mark.parametrize("unit", [
    "x <a ", 'x <b "', '<b a="', '<b a=">" ', "<div>x", "<b>x", "<p><x>y", "</p><div>", "<!-- ", "<script>x</script ", "<li><b>", "<",
])
def test_long_broken_pages_take_time_in_proportion(unit):
    def seconds(size):
        start = time.process_time()
        main_text("<p><button><table>" + unit * (size // len(unit)) + "</p>" * (size // 40))
        return time.process_time() - start

    small, large = seconds(100_000), seconds(800_000)
    assert large < 1 or large < 24 * small
