"""Deep and unclosed markup takes time in proportion to its length."""

import time

from matchengine.llm.html_extract import main_text


def test_depth():
    for page in ("<div class='nav'>x" * 50_000, "<b>" * 50_000 + "<p>x</section>" * 50_000, "<ul><li>" * 20_000 + "a"):
        start = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - start < 30
