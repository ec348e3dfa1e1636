"""Token types and positions, after the published examples of the parser that the analysis follows."""

import pytest

from lexiloom.functions.analysis import analyzed, occurrences, tokens_of


@pytest.mark.parametrize(
    "text, want",
    [
        ("elephant", [("asciiword", "elephant")]),
        ("mañana", [("word", "mañana")]),
        ("beta1", [("numword", "beta1")]),
        ("up-to-date", [("asciihword", "up-to-date"), ("hword_asciipart", "up"), ("hword_asciipart", "to"), ("hword_asciipart", "date")]),
        ("lógico-matemática", [("hword", "lógico-matemática"), ("hword_part", "lógico"), ("hword_part", "matemática")]),
        ("foo-bar-beta1", [("numhword", "foo-bar-beta1"), ("hword_asciipart", "foo"), ("hword_asciipart", "bar"), ("hword_numpart", "beta1")]),
        ("foo@example.com", [("email", "foo@example.com")]),
        ("example.com", [("host", "example.com")]),
        ("http://example.com/stuff/index.html", [("url", "example.com/stuff/index.html"), ("host", "example.com"), ("url_path", "/stuff/index.html")]),
        ("/usr/local/foo.txt", [("file", "/usr/local/foo.txt")]),
        ("-1.234e56", [("sfloat", "-1.234e56")]),
        ("-1.234", [("float", "-1.234")]),
        ("-1234", [("int", "-1234")]),
        ("1234", [("uint", "1234")]),
        ("8.3.0", [("version", "8.3.0")]),
        ('<a href="dictionaries.html">x</a> &amp; y', [("asciiword", "x"), ("asciiword", "y")]),
        ("12-34", [("uint", "12"), ("int", "-34")]),
        ("250-S", [("uint", "250"), ("asciiword", "S")]),
        ("foo-1", [("asciiword", "foo"), ("int", "-1")]),
        ("snake_case", [("asciiword", "snake"), ("asciiword", "case")]),
        ("3,9 N·m", [("uint", "3"), ("uint", "9"), ("asciiword", "N"), ("asciiword", "m")]),
        ("see it. Then go.", [("asciiword", "see"), ("asciiword", "it"), ("asciiword", "Then"), ("asciiword", "go")]),
        ("", []),
    ],
)
def test_tokens(text, want):
    assert list(tokens_of(text)) == want


def test_positions_count_every_token():
    assert analyzed("a fat  cat sat on a mat - it ate a fat rats") == [("fat", 2), ("cat", 3), ("sat", 4), ("mat", 7), ("fat", 11), ("rats", 12)]
    assert analyzed("foo-bar-beta1 Ação") == [("foo-bar-beta1", 1), ("foo", 2), ("bar", 3), ("beta1", 4), ("aca", 5)]
    assert analyzed("http://Example.com/Stuff AÇÃO1 <b>") == [("example.com/stuff", 1), ("example.com", 2), ("/stuff", 3), ("ação1", 4)]


def test_pieces_lose_no_token():
    texts = ["", "a", "foo-bar. x", "http://a.com/b?c=d, <b class='x y'>bold</b> &amp; x@y.com 3.4.5 -7", "word... wórd, ¿qué? a/b/c.txt", "< b > c<d e> f", "foo-bar motores, motores"]
    places = {x: i for i, x in enumerate(sorted({x for t in texts for x, _ in analyzed(t)})) if i % 3}
    got = zip(*(x.tolist() for x in occurrences(texts, places)), strict=True)
    assert list(got) == [(i, places[x], pos) for i, t in enumerate(texts) for x, pos in analyzed(t) if x in places]
