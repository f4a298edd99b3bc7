import pytest

from matchengine.llm.html_extract import extracted, main_text

BODY = "The first sentence, of some length, stands here. A second one follows it; and a third."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<div></div>", ""), ("<p>" + BODY + "</p>", BODY),
        (f"<html><head><title>t</title><style>p {{}}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{BODY}</p><script>var a;</script></article><footer>c</footer></body></html>", "Title " + BODY),
        (f"<main><p>{BODY} &amp; &eacute;&#8364;  \n x<br>y</p><p>{BODY}</p></main>", f"{BODY} & é€ x y {BODY}"),
        (f"<article><p>{BODY}<p>Un<b>clos</b>ed<ul><li>one<li>two</ul><div class='comments'><p>Nice!</p></div></article>", f"{BODY} Unclosed one two"),
        (f"<body><div class='sidebar'>Links</div><div class='ad-banner'>Buy</div><form>Name</form><div class='cookie-notice'>OK</div><article>{BODY}</article></body>", BODY),
    ],
)
def test_golden(html, text):
    assert main_text(html) == text


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extracted(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert got[r.page_id].text == main_text(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_nulls_repeats_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "<p>" + BODY, "b")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extracted(d).collect()) == [(0, BODY, len(BODY)), (1, "", 0), (1, "", 0)]
