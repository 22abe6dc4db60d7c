import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.query import BadDate, BadRegex, LexError, Pattern, Regex, UnknownProperty, UnsupportedOp, parse, tokenize, tokenize_spanned
from trawl.query.filters import day_start


def kinds(text):
    return [(t.kind, t.text) for t in tokenize(text)]


def test_tokens():
    assert kinds('a "b ""c""" (AND)') == [("word", "a"), ("quoted", 'b "c"'), ("(", "("), ("and", "AND"), (")", ")")]
    assert kinds("x<=1>=2<3>4=5:6") == [
        ("word", "x"), ("op", "<="), ("word", "1"), ("op", ">="), ("word", "2"), ("op", "<"), ("word", "3"),
        ("op", ">"), ("word", "4"), ("op", "="), ("word", "5"), ("op", ":"), ("word", "6"),
    ]
    assert kinds(r"path:C:\x") == [("word", "path"), ("op", ":"), ("word", "C:\\x")]
    assert kinds("ab:/x") == [("word", "ab"), ("op", ":"), ("word", "/x")]


def test_unterminated_quote_keeps_what_came_before():
    tokens, error = tokenize_spanned('é "x')
    assert [(t.text, a, b) for t, a, b in tokens] == [("é", 0, 2)] and error.offset == 3
    with pytest.raises(LexError):
        tokenize('"x')


@pytest.mark.parametrize(
    "text, term",
    [
        ("a AND b", "a AND b"), ("(a b)", "a b"), ("12:30", "12:30"), ("foo:bar:baz", "foo:bar:baz"), ("type:", "type:"),
        ("a > b", "a>b"), ("> b", "> b"), ('"a:b" c', "a:b c"), ('x "y', 'x "y'), ("a\0b", "ab"), ("", ""),
    ],
)
def test_terms(text, term):
    assert parse(text).term == term


def test_filters_do_not_drive_a_search(spark):
    q = parse("type:text modified:>=2024-01-01 mime:text/plain")
    assert q.empty and len(q.filters) == 3 and q.term == ""


def test_errors(spark):
    for text, error in (
        ("type:nonsense", UnknownProperty), ("modified:2024-02-30", BadDate), ("modified:1969-12-31", BadDate),
        ("name=x", UnsupportedOp), ("regex:a regex:b", BadRegex), ('regex:"("', BadRegex), ("regex:a*", BadRegex),
        ("regex=a", UnsupportedOp),
    ):
        with pytest.raises(error):
            parse(text)


def test_dates():
    assert day_start("1970-1-1") == 0 and day_start("2024-03-01") - day_start("2024-2-28") == 2 * 86400


@pytest.mark.parametrize(
    "parts, segments, flags",
    [
        ([("*", True)], (), (False, False, False)), ([("*", True), ("*", True)], (" ",), (True, True, True)),
        ([("a**b", True)], ("a", "b"), (True, False, False)), ([("a*", True), ("b", False)], ("a", " b"), (True, False, False)),
        ([("*x", True), ("y*", True)], ("x y",), (True, True, True)), ([("a*b", False)], ("a*b",), (False, False, False)),
    ],
)
def test_patterns(parts, segments, flags):
    p = Pattern.of(parts)
    assert p.segments == segments
    if segments:
        assert (p.star, p.leading, p.trailing) == flags
    else:
        assert p.empty


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab:=<>"() *é', max_size=20))
def test_lexer_takes_everything(text):
    tokens, error = tokenize_spanned(text)
    ends = [b for _, _, b in tokens]
    assert ends == sorted(ends) and all(0 <= a < b <= len(text.encode()) for _, a, b in tokens)
    assert error is None or text.encode()[error.offset : error.offset + 1] == b'"'


def test_regex_is_linear():
    assert Regex("(a+)+$").pattern


def test_empty_matches_are_found():
    for source in (r"\b", "^", "$", "a*", "(x|)", r"\B"):
        with pytest.raises(BadRegex):
            Regex(source)
    assert Regex("a+b?").pattern and Regex(r"\bword").pattern


def test_like_and_roots(tmp_path):
    from trawl.functions.text import like_escaped, root_path

    assert like_escaped("100%_\\") == "100\\%\\_\\\\"
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert root_path(f"{tmp_path}/link/./") == str(tmp_path / "real")


def test_settings_are_kept(tmp_path):
    from trawl.model import Config

    c = Config(roots=("/a", '/b "é"'), store_text=False, fuzzy_max_edits=1, ignore=())
    c.save(str(tmp_path / "trawl.toml"))
    assert Config.load(str(tmp_path / "trawl.toml")) == c and Config.place(str(tmp_path)) == str(tmp_path / "trawl.toml")


def test_log_ring():
    import logging

    from trawl.log import Ring

    ring, log = Ring(size=30), logging.getLogger("trawl.test")
    log.addHandler(ring)
    log.setLevel(logging.INFO)
    for i in range(50):
        log.warning("can't read %s", i)
    log.info("Done with %s", "it")
    assert len(ring.shown(warnings=True)) == 20 and ring.left_out() == {"can't read %s": 30} and [x.text for x in ring.shown(holding="DONE")] == ["Done with it"]
