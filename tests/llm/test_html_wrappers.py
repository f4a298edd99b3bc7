import pytest

from matchengine.llm.html_extract import main_text

TEXT = [f"Sentence {i} of the body is long enough, as sentences of articles are; it goes on a little, and ends here. A short one follows it." for i in range(5)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WANT = " ".join(TEXT)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("name", ["has-sidebar", "content-sidebar-wrap", "no-sidebar", "nav-open", "page-with-header"])
def test_wrappers_with_clutter_words(tag, name):
    page = f"<body><div class='{name}'><div class='sidebar'>Links of the site</div><{tag}>{BODY}</{tag}></div><div class=footer>c</div></body>"
    assert main_text(page) == WANT
    assert main_text(f"<{tag}><div id='{name}'>{BODY}</div></{tag}>") == WANT


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_form_around_the_page(tag):
    assert main_text(f"<body><form action=x><{tag}>{BODY}</{tag}><input></form><form>Your name</form></body>") == WANT


@pytest.mark.parametrize("start", ["<html><head><title>t</title><meta charset=utf-8><body>", "<head><style>a {}</style>", "<head><title>t</title>", "<head><script>var a;</script><body class=x>"])
def test_head_without_end_tag(start):
    assert main_text(f"{start}<article>{BODY}</article>") == WANT
    assert main_text(f"{start}<div>{BODY}</div>") == WANT
    assert main_text(f"{start}{TEXT[0]}") == TEXT[0]
