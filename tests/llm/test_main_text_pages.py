"""Pages unlike the given ones: text beside the best element, hostile pages, clashing names."""

import time

import pytest

from maskmix.llm.main_text import main_text, with_main_text

LONG = "A long, real paragraph of an article, with commas, and with some words more than a menu has."
LEAD = "A short lead."


def article(*parts: str) -> str:
    return "<article>" + "".join(parts) + "</article>"


P = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    "body, kept",
    [
        (f"<h1>Title</h1><p>{LEAD}</p>" + article(P * 4), ["Title", LEAD, *[LONG] * 4]),
        ("<div><h1>Title</h1></div>" + article(P * 4), ["Title", *[LONG] * 4]),
        (article(P * 6) + article(f"<p>{LEAD}</p>"), [*[LONG] * 6, LEAD]),
        (f"<div>{article(P * 6)}</div><div>{article(f'<p>{LEAD}</p>')}</div>", [*[LONG] * 6, LEAD]),
        (f"<div><div>{P * 5}</div></div><div><div><p>{LEAD}</p></div></div>", [*[LONG] * 5, LEAD]),
        (f"<div>{P * 5}</div><div><p>{LEAD} <a href=x>Four words in link</a> and much more after it.</p></div>",
         [*[LONG] * 5, f"{LEAD} Four words in link and much more after it."]),
        (article(f"<header><h1>Title</h1><p>By someone</p></header>{P * 3}"), ["Title", *[LONG] * 3]),
        (f"<header><h1>Site</h1></header>{article(P * 3)}<footer><p>{LEAD}</p></footer>", [LONG] * 3),
        (f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{article(P * 3)}", [LONG] * 3),
        (article(P * 5) + f"<section class=comments>{article(P)}{article(P)}</section>", [LONG] * 5),
        (f"{P * 3}<form><p>{LEAD}</p><fieldset>Name</fieldset></form>", [LONG] * 3),
        ("<table><tr><td>" + P * 2 + "<tr><td>" + P + "</table>", [LONG] * 3),
    ],
)
def test_text_beside_the_best_element(body, kept):
    assert main_text(f"<html><body>{body}</body></html>").split("\n\n") == kept


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<p>{LONG}</p><!-- never closed <p>x</p>", LONG),
        (f"<p>{LONG}</p><!-- never closed", LONG),
        (f"<p>{LONG}</p><script>var a = '<p>x</p>'; more", LONG),
        (f"<p>{LONG}</p><p title=\"a > b\">Next, <i>with</i> sign</p>", f"{LONG}\n\nNext, with sign"),
        (f"<div><p>{LONG}<p>Other</div></i></section>Tail", None),
        ("<p>&amp;lt; &nbsp; &#233;\n\t x</p>", "&lt; é x"),
    ],
)
def test_broken_markup(page, text):
    got = main_text(page)
    assert got == text if text is not None else LONG in got and "Other" in got


@pytest.mark.parametrize(
    "piece, end",
    [
        ("<div>", "x"), ("<b>x", ""), ("<ul><li>x", ""), ('<a "', ""), ("<a '>", ""), ('<a ">"', ""), ('<a ">', "x"),
        ("<a", ">"), ("<!-", ">"), ("<script", ""), ("</i>", "x"), ("<p><button><div>", "x"), ("<div class='ad x'>", "x"),
    ],
)
def test_time_grows_with_the_length_alone(piece, end):
    def seconds(n):
        begin = time.process_time()
        main_text(piece * n + end)
        return time.process_time() - begin

    small, large = min(seconds(5000) for _ in range(3)), seconds(40_000)
    assert large < 24 * small + 0.3  # a square would be 64 times


def test_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "own"), (1, "<p>a</p>", "own"), (2, "", None)], "page_id long, html string, Text string")
    out = with_main_text(df, "html", "text", "n_chars")
    assert out.columns == ["page_id", "html", "Text", "_text", "n_chars"]
    rows = [tuple(r) for r in out.select("page_id", "Text", "_text", "n_chars").orderBy("page_id").collect()]
    assert rows == [(1, "own", "a", 1), (1, "own", "a", 1), (2, None, "", 0)]
