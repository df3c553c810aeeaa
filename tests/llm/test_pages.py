import pytest

import brute
from fleetscope.llm import html_extract as H
from fleetscope.llm import licenses

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>{title}</h1></header><p>{one} &amp; caf&eacute;&nbsp;<b>bold</b>
 text</p><div class="ad">Buy now</div><p>{two}</p><ul><li>first</li><li>second</li></ul></article>
<section class="comments"><p>Reader says</p></section></main><aside>Related</aside><form><input><button>Go</button></form><footer>(c)</footer></body></html>"""


def test_main_text():
    text = H.main_text(PAGE.format(title="Head", one="One", two="Two"))
    assert text == "Head\nOne & café bold text\nTwo\nfirst\nsecond"


@pytest.mark.parametrize(("html", "want"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a<br>b</p>", "a b"), ("<p>x", "x"), ("</div></p>y", "y"), ("<p>1 &lt; 2 &#39;q&#x27;</p>", "1 < 2 'q'"), ("<script>unclosed", ""), ("<!-- c --><p>t</p>", "t"), ("<p></p>", "")])
def test_odd_markup(html, want):
    assert H.main_text(html) == want


@pytest.mark.parametrize(("html", "want"), [("<p>a<svg width='1'/>b</p><svg><path/></svg><p>c</p>", "ab\nc"), ("<p>a <math/>b</p>", "a b"), ("<p>a <math><mi>x</mi></math> b</p>", "a x b"), ("<div>a<svg><path/></div><p>b</p>", "a\nb"), ("<div><p>a<canvas>no</p></div><p>b</p>", "a\nb"), ("<div>a<style>no</div><p>b</p>", "a")])
def test_foreign_and_unclosed_elements(html, want):
    assert H.main_text(html) == want


def test_extract(spark, scratch):
    pages = [(i, f"http://h{i % 3}.example/{i}", PAGE.format(title=f"T{i}", one=f"one {i}", two=f"two {i}"), "x") for i in range(30)] + [(90, None, "<p>n</p>", "x"), (91, "http://z/", None, "x"), (91, "http://z/", None, "x")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, element string")
    got = H.extract(rows, scratch).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    for i in range(30):
        assert by[i]["text"] == f"T{i}\none {i} & café bold text\ntwo {i}\nfirst\nsecond" and by[i]["n_chars"] == len(by[i]["text"])
    assert by[90]["text"] == "n" and by[91]["text"] == "" and by[91]["n_chars"] == 0
    assert H.extract(rows.limit(0), scratch).count() == 0


def test_wrapper_finds_slots_repeats_and_optionals():
    a = "<div><h1>same</h1><p>one</p><ul><li>x</li></ul></div>"
    b = "<div><h1>same</h1><p>two</p><ul><li>x</li><li>y</li><li>z</li></ul><em>more</em></div>"
    assert H.infer([a, b]).pattern() == "<>(<div>(<h1>(=) <p>(#) <ul>(<li>(=) <li>(#)+?) <em>(=)?))"


def random_page(rng, depth=0):
    kids = []
    for _ in range(rng.randint(0, 4)):
        if depth < 2 and rng.random() < 0.7:
            kids.append((rng.choice(["div", "ul", "section", "div.x"]), random_page(rng, depth + 1)))
        elif not kids or kids[-1][0] != "#":
            kids.append(("#", rng.choice("abc")))
    return kids


def empty(kids):
    """Without elements that hold no text."""
    kids = [(k, empty(v)) if k != "#" else (k, v) for k, v in kids]
    return [k for k in kids if k[0] == "#" or k[1]]


@pytest.mark.parametrize(("seed", "longest"), [(s, 64) for s in range(6)] + [(s, 2) for s in range(3)])
def test_wrappers_fit_all_their_pages(seed, longest, monkeypatch):
    """The wrapper as a plain regular expression accepts every page that it was made of, whatever the order or grouping."""
    import random
    import re

    monkeypatch.setattr(H, "LONGEST", longest)
    rng = random.Random(seed)
    pages = [random_page(rng) for _ in range(5)]
    wrapper = H.infer(["".join(map(brute.element_html, p)) for p in pages])
    half = [H.infer(["".join(map(brute.element_html, p)) for p in part]) for part in (pages[:2], pages[2:])]
    joined = H._unpack(H._pack(H.joined(*half, 5)))
    for w in (wrapper, joined):
        fits = re.compile(brute.expression(w))
        for p in pages:
            said = re.sub(r"\}\{", "", "".join(map(brute.element_text, empty(p))))
            assert fits.fullmatch(said), (w.pattern(), said)


def test_alignment_is_a_best_match():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([(rng.choice("abc"), rng.randint(0, 2)) for _ in range(rng.randint(0, 7))] for _ in range(2))
        pairs = H.best_match(*([H.Node(label, [], digest) for label, digest in x] for x in (a, b)))
        assert all(a[i][0] == b[j][0] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        if [x[0] for x in a] != [x[0] for x in b]:
            assert sum(2 if a[i] == b[j] else 1 for i, j in pairs) == brute.best_score(a, b)


PLAIN = "<body><div>Site name</div><div><div>Start</div><div>About us</div></div><div>{0}</div><div>Contact us</div></body>"


def test_wrapper_tells_unmarked_elements_apart():
    pages = [PLAIN.format("".join(f"<div>t{i}.{j}</div>" for j in range(1 + i % 3)) if i % 2 else f"t{i}") for i in range(8)]
    decision = H.decide(H.infer(pages))
    for i, page in enumerate(pages):
        assert H.main_text(page, decision).split("\n") == ([f"t{i}.{j}" for j in range(1 + i % 3)] if i % 2 else [f"t{i}"])


BARE = "<html><body><div class='c1'>Site name</div><div class='c2'><a href='/'>Start</a><a href='/a'>About us</a></div><div class='c3'><h1>{0}</h1><div>Text of {0}.</div><div>More of {0}.</div></div><div class='c4'>Contact us</div></body></html>"


def test_wrapper_tells_template_from_text_without_articles(spark, scratch):
    pages = [(i, "http://plain.example/x", BARE.format(f"page {i}")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch).collect()}
    assert got == {i: f"page {i}\nText of page {i}.\nMore of page {i}." for i in range(8)}
    assert H.main_text(pages[0][2]).startswith("Site name") and H.main_text(pages[0][2]).endswith("Contact us")  # the wrapper off


def test_wrapper_names_the_article(spark, scratch):
    page = "<main><article class='teaser'><p>Read {0} next</p></article><article class='story'><h1>{0}</h1><p>A long story of {0}, told well.</p></article></main>"
    pages = [(i, "http://two.example/x", page.format(i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch).collect()}
    assert got == {i: f"{i}\nA long story of {i}, told well." for i in range(4)}


def test_partial_wrappers_are_aligned_in_rounds(spark, scratch, monkeypatch):
    monkeypatch.setattr(H, "FAN_IN", 2)
    pages = [(i, "http://plain.example/x", BARE.format(f"page {i}")) for i in range(12)]
    got = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6), scratch).collect()
    assert {r["text"] for r in got} == {f"page {i}\nText of page {i}.\nMore of page {i}." for i in range(12)}
    monkeypatch.setattr(H, "MOST_HOSTS", 0)
    got = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch).collect()
    assert {r["text"] for r in got} == {f"page {i}\nText of page {i}.\nMore of page {i}." for i in range(12)}


@pytest.mark.parametrize("part", ["<p class='share-price'>x</p>", "<div class='hidden-gems'>x</div>", "<section id='ad-hoc-networks'>x</section>", "<ins>x</ins>", "<p class='has-sidebar'>x</p>"])
def test_words_that_only_look_like_marks(part):
    assert H.main_text(f"<article><p>a</p>{part}<p>b</p></article>").replace("\n", "") == "axb"


@pytest.mark.parametrize("part", ["<ol id='reader-responses'><li>x</li></ol>", "<ins data-ad='1'>x</ins>", "<div class='ad-slot'>x</div>", "<div class='cookie-notice'>x</div>", "<div id='comments'>x</div>", "<div class='related-posts'>x</div>", "<div class='share-buttons'>x</div>", "<div class='site-header'>x</div>"])
def test_marked_parts_go(part):
    assert H.main_text(f"<article><p>a</p>{part}<p>b</p></article>") == "a\nb"


def test_long_pages_are_walked_once():
    assert len(H.main_text("<div>" * 3000 + "x" + "<p>word</p>" * 20_000).split("\n")) == 20_001


# licences


def licence(spark, *texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, known string")
    return [r["licenses"] for r in licenses.scan(rows).orderBy("doc_id").collect()]


def test_licenses(spark):
    mit = licenses.SENTENCES["mit-grant"] + "\n\n" + licenses.SENTENCES["mit-condition"] + "\n\n" + licenses.SENTENCES["mit-warranty"].upper()
    wrapped = mit.replace(" of this software", "\nof  this software").replace("to deal in", "to deal\n   in")
    got = licence(spark, None, "", "no licence here", "text. Released under the MIT License.\nmore", mit, wrapped, "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", licenses.SENTENCES["mit-grant"], "This is not Licensed under CC BY 4.0. at all")
    assert got[:8] == ["", "", "", "MIT", "MIT", "MIT", "CC-BY-4.0", "CC-BY-NC-4.0"]
    assert got[8] == "" and got[9] == ""


def test_longer_rules_win(spark):
    two = "\n".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert licence(spark, two, two + "\n" + licenses.SENTENCES["bsd-name"]) == ["BSD-2-Clause", "BSD-3-Clause"]
    assert licence(spark, "Licensed under CC BY 4.0.\nReleased under CC0 1.0.") == ["CC-BY-4.0,CC0-1.0"]


def test_published_wordings(spark):
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    rows = spark.createDataFrame([(0, gpl), (1, apache), (2, "This program is free software: good"), (3, gpl + "\n\n" + gpl)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in licenses.scan(rows).orderBy("doc_id").collect()]
    free = "gpl3-free,gpl-hope,gpl-implied,gpl-see"
    assert got[0] == (4, free, "GPL-3.0-or-later")
    assert got[1] == (4, "apache-header,apache-header-2,apache-copy,apache-see", "Apache-2.0")
    assert got[2] == (0, "", "") and got[3] == (8, free + "," + free, "GPL-3.0-or-later")


def test_a_shorter_rule_beside_a_longer_one(spark):
    two = "\n".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    three = two + "\n" + licenses.SENTENCES["bsd-name"]
    assert licence(spark, three + "\n" + two, three + "\n" + three) == ["BSD-2-Clause,BSD-3-Clause", "BSD-3-Clause"]


def test_licenses_of_both_readings(spark):
    wrapped = "\n\n".join(licenses.SENTENCES[k].replace(" of ", "\nof ", 1).replace(" or ", "\nor ", 1) for k in ("mit-grant", "mit-condition", "mit-warranty"))
    title = "\n\nDocs\nLicensed under CC BY 4.0.\n\nMore\nReleased under CC0 1.0."
    assert licence(spark, wrapped + title) == ["CC-BY-4.0,CC0-1.0,MIT"]


def test_other_sentences_may_stand_between(spark):
    mit = [licenses.SENTENCES[k] for k in ("mit-grant", "mit-condition", "mit-warranty")]
    assert licence(spark, "\n".join([mit[0], "Licensed under CC BY 4.0.", mit[1], "Words of our own.", mit[2]]), "\n".join(mit[::-1])) == ["CC-BY-4.0,MIT", ""]


def test_shorter_rules_go_by_place(spark):
    lines = lambda *ids: "\n".join(licenses.SENTENCES[k] for k in ids)
    two, mit = ("bsd-grant", "bsd-source", "bsd-binary"), ("mit-grant", "mit-condition", "mit-warranty")
    got = licence(spark, lines(*two, *two, "bsd-name"), lines(*two, "bsd-advert", "bsd-name"), lines(*mit, "x11-name"), lines(*mit, "x11-name", *mit))
    assert got == ["BSD-2-Clause,BSD-3-Clause", "BSD-4-Clause", "X11", "MIT,X11"]


def test_spdx_tags(spark):
    assert licence(spark, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode", "# spdx-license-identifier: GPL-2.0+", "SPDX-License-Identifier: Nonsense-1.0", "x SPDX-License-Identifier: GPL-3.0") == ["Apache-2.0,MIT", "GPL-2.0-or-later", "", "GPL-3.0-only"]


def test_every_licence_is_found_by_its_own_sentences(spark):
    rules = licenses.rules()
    notice = {v: k for k, v in licenses.notices().items()}
    said = [".\n".join(notice.get(x) or licenses.SENTENCES[x] for x in ids) + "." for _, ids in rules]
    assert len({n for n, _ in rules}) >= 40
    assert [n in got.split(",") for (n, _), got in zip(rules, licence(spark, *said), strict=True)] == [True] * len(rules)
    assert all(any(m in s.lower() for m in licenses.MARKERS) for s in [*licenses.SENTENCES.values(), *notice.values()])


def test_license_odd_inputs(spark):
    schema = "doc_id long, text string, a string, t string, tags string, known string, licenses string"
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
    long = "no such words here. " * 200_000 + "\nReleased under the MIT License.\n" + "x" * 1_000_000
    rows = [(None, "MIT License", *"abcde"), (None, None, *"abcde"), (1, long, *"abcde"), (1, long, *"abcde")]
    got = sorted(((r["doc_id"], r["n_sentences"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == [(1, 1, "MIT"), (1, 1, "MIT"), (None, 0, ""), (None, 1, "")]


def test_license_plan_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
