from fjordquant.llm import extract as X

LONG = "The first words of the story are here and they go on for a while, as the words of a story do. "


def page(body, article):
    return ("<!DOCTYPE html><html><head><meta charset='utf-8'><title>T</title><style>p{}</style>"
            "<script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav>"
            "<header class='site'><p>" + LONG + "</p></header><!-- ad 1 --><div class=\"ad\">" + LONG + "</div>"
            + body + "<article><h1>The head</h1>" + article + "</article>"
            "<aside><p>" + LONG + "</p></aside><div id='cookie-notice'>" + LONG + "</div>"
            "<form><label>" + LONG + "</label><input><button>Go</button></form>"
            "<section class='comments'><h2>2 comments</h2><p>" + LONG + "</p></section>"
            "<footer>&copy; x &middot; " + LONG + "</footer></body></html>")


def test_article_only():
    got = X.extract(page("", f"<p><b>{LONG}<br><p>Of.</p><p>Tom&nbsp;&amp;  Ann\n\tsaid &#233;&lt;</p><p>End.</p>"))
    assert got == f"The head\n{LONG.strip()}\nOf.\nTom & Ann said é<\nEnd."


def test_short_article_and_edges():
    assert X.extract(page("", "<p>Of.</p>")) == "The head\nOf."
    assert X.extract("") == "" and X.extract("<p>") == ""
    assert X.extract("<div><p>" + LONG * 3 + "</p><p>Short.</p></div>") == (LONG * 3).strip() + "\nShort."
    assert X.extract("<article><p>" + LONG + "<a href='x'>linked</a> tail</p></article>") == LONG + "linked tail"


def test_on_rows(spark):
    rows = [(1, "u", page("", f"<p>{LONG}</p>"), "x"), (2, None, None, "x"), (1, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _html string")
    got = sorted(tuple(r) for r in X.main_text(df, "html").select("page_id", "text").collect())
    assert got == [(1, ""), (1, f"The head\n{LONG.strip()}"), (2, "")]
    assert X.main_text(df.limit(0), "html").count() == 0


def test_unclosed_and_self_closing_dropped_elements():
    after = f"<p>{LONG}</p><p>The end.</p>"
    want = f"The head\n{LONG.strip()}\nThe end."
    for odd in ("<svg viewBox='0'/>", "<math/>", "<iframe src='x'>", "<select name=a>", "<object data='x'>",
                "<button class=x>", "<textarea>", "<svg>", "<canvas>", "<svg><svg/></svg>", "<iframe src='x'/>"):
        for late in ("", "<iframe></iframe><svg></svg><button>No</button><select></select><object></object>"):
            assert X.extract(page("", odd + after + late)) == want, (odd, late)
            assert X.extract(page(odd, after + late)) == want, (odd, late)
    closed = "<object><object>x</object>y</object><svg><g><title>No</title></g></svg><select><option>A<option>B</select>"
    assert X.extract(page(closed, closed + after)) == want


def test_hidden_is_an_attribute_name():
    for words in ("title=\"the hidden cost\"", "title='a hidden'", "data-a=hidden", "title= hidden"):
        assert X.extract(page("", f"<p {words}>{LONG}</p>")) == f"The head\n{LONG.strip()}", words
    for words in ("hidden", "title='x' hidden", "hidden=''", "hidden=\"until-found\" title=x"):
        assert X.extract(page("", f"<p>Of.</p><p {words}>{LONG}</p>")) == "The head\nOf.", words
