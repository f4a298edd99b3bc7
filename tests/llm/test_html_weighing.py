import pytest

from matchengine.llm.html_extract import main_text

TEXT = [f"Sentence {i} of the body is long enough, as sentences of articles are; it goes on a little, and ends here. A short one follows it." for i in range(5)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WANT = " ".join(TEXT)
LINKS = "<ul>" + "".join(f"<li><a href=x>Entry {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("clutter", [LINKS, "<div><a href=x>Read this</a> <a href=y>And that</a></div>", "<section><div>Buy it</div></section>"])
def test_unmarked_clutter(tag, clutter):
    assert main_text(f"<body><{tag}>{clutter}{BODY}{clutter}</{tag}></body>") == WANT


def test_body_beside_article_cards():
    cards = "".join(f"<article><a href=x>Card {i}</a></article>" for i in range(4))
    assert main_text(f"<body><div>{BODY}</div>{cards}</body>") == WANT


def test_long_comments_below_an_article():
    said = "".join(f"<p>I think that number {i} is right, as they say; or not? Who knows.</p>" for i in range(20))
    assert main_text(f"<body><article>{BODY}</article><div class=comments>{said}</div></body>") == WANT
    assert main_text(f"<body><article>{BODY}<div class=comments>{said}</div></article></body>") == WANT
