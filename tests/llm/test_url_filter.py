import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import url_filter as U

CASES = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.COM/x?y#z", "a.com", "/x", "com/", "allow"), ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("https://WWW.example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"), ("http://sub.example.com/en/a", "sub.example.com", "/en/a", "example.com/en/", "block"), ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://x.net/de/", "x.net", "/de/", None, "allow"), ("http://a.com", "a.com", "", None, "allow"), ("http://?q", "", "", None, "allow"),
    ("http://x.spam-farm.org/", "x.spam-farm.org", "/", None, "block"), ("ftp://a://b/c", "a:", "//b/c", None, "allow"),
    ("https://good.org/wiki/x.casino-royale.html", "good.org", "/wiki/x.casino-royale.html", None, "allow"), ("https://casino-royale.org/", "casino-royale.org", "/", None, "block"), ("https://good.org/a/file.zip", "good.org", "/a/file.zip", None, "block"),
    ("https://good.zip/a", "good.zip", "/a", None, "allow"), ("https://a.org/wp-login.php", "a.org", "/wp-login.php", None, "block"), ("https://a.org/x/wp-login.php", "a.org", "/x/wp-login.php", None, "allow"), ("http://bit.ly/x", "bit.ly", "/x", None, "block"),
    ("https://betty.org/", "betty.org", "/", None, "allow"), ("https://m.bet-now.org/", "m.bet-now.org", "/", None, "block"), ("https://essex.org/", "essex.org", "/", None, "allow"), ("http://É.COM/", "É.com", "/", "com/", "allow"),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.filter_urls(rows).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(none).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/")] * 2 + [(None, "http://a.com/" + "x" * 100_000)], "page_id long, url string")
    assert [r["verdict"] for r in U.filter_urls(twice).collect()] == ["allow"] * 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab*", min_size=1, max_size=8), min_size=1, max_size=30), st.lists(st.text("ab", max_size=12), min_size=1, max_size=8))
def test_automaton_is_glob_matching(patterns, texts):
    patterns = [p for p in patterns if p.strip("*")] or ["a"]
    hit = U.Automaton([p.encode() for p in patterns]).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, p in enumerate(patterns):
            want = re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in p), t) is not None
            assert hit[i, j] == want, (p, t)


@pytest.mark.parametrize("n", [1, 40])
def test_many_patterns_span_words(n):
    patterns = [f"*.host{i}.example/path{i}*".encode() for i in range(n)]
    assert U.Automaton(patterns).run([f"x.host{n - 1}.example/path{n - 1}/y".encode()]).sum() == 1


def test_wildcards_keep_to_their_side():
    patterns = [U.Rule("block", host_glob="*.bad*").pattern, U.Rule("block", path_glob="*.exe").pattern, U.Rule("block", "x.org", "/a").pattern]
    hit = U.Automaton(patterns).run([b".bad.org\xff/", b".a.org\xff/.bad", b".a.exe\xff/", b".a.org\xff/b.exe", b".y.x.org\xff/ab"])
    assert hit.tolist() == [[True, False, False], [False, False, False], [False, False, False], [False, True, False], [False, False, True]]
