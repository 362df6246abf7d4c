"""Main text of pages: whole expected texts over many page shapes, the wrapper's part in it, and odd pages."""

import random

import pytest

from framewright.llm import html_text
from framewright.llm.html_text import Wrapper, main_text, parsed, runs


def article(inside):
    return main_text(f"<html><body><nav>menu</nav><article>{inside}</article><footer>f</footer></body></html>")


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<p title="hidden gems">Keep me</p><p>b</p>', "Keep me\nb"),
        ('<p data-class="sidebar x">Keep me</p><p>b</p>', "Keep me\nb"),
        ('<p data-hidden="false">Keep</p><p>b</p>', "Keep\nb"),
        ('He <span class="search-term">found</span> it', "He found it"),
        ('He <a class="related">found</a> <a href="?id=comments">it</a>', "He found it"),
        ('<p class="alert">Keep</p><label>me</label>', "Keep\nme"),
        ('<h2 id="related-work">R</h2><section id="search"><p>S</p></section>', "R\nS"),
        ('<p class="ad">buy</p><div class="post-comments"><p>nice</p></div><div class="shareButtons">x</div><p>e</p>', "e"),
        ('<p>vis<span hidden>ible</span> &amp; <b style="display: none">no</b>x</p>', "vis & x"),
        ("<form><label>l</label><button>b</button></form><p>a<br>b\n\t c&nbsp;d</p><script>if(a<b)</script>", "a b c d"),
        ('<div class="ad-hoc networks">a</div><div class="social-history">b</div><div class="notice-period">c</div><div class="lunch-menu">d</div>', "a\nb\nc\nd"),
        ('<p>a</p><section id="responses"><p>nice</p></section><div class="top-banner">x</div><div class="ads-container-2">y</div>', "a"),
        ("<p>so <math><mi>x</mi></math> is</p>", "so x is"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ],
)
def test_articles(inside, text):
    assert article(inside) == text


def test_pages_without_an_article():
    assert main_text('<body class="has-sidebar"><div class="content no-sidebar"><p>x y z</p><div class="site-footer">no</div></div>') == "x y z"
    assert main_text("<article><h1>A<p>b <!-- c") == "A\nb"
    assert main_text("a < b &amp c") == "a < b & c"
    assert main_text("<table><tr><td class='nav'>n<td><p>long text here</table>") == "long text here"
    assert main_text(None) == main_text("") == main_text("<nav>only a menu</nav>") == ""


def test_deep_and_long_pages():
    assert main_text("<div>" * 100_000 + "deep") == "deep"
    assert main_text("<p>" * 3000 + "deep") == "deep"
    long = main_text("<article>" + "".join(f"<p>{i}</p><div>d{i}</div>" for i in range(20_000)) + "</article>")
    assert long.split("\n") == [x for i in range(20_000) for x in (str(i), f"d{i}")]


def soup(i):
    """A page whose menu and notes don't say what they are; only the other pages of its host show it."""
    return f"<body><div class='a'><ul><li>Home<li>About</ul></div><div class='b'><h2>Always</h2><p>own text {i} and more of it, number {i}</p>{'<p>sometimes</p>' * (i % 2)}<ul><li>Fixed list</ul><p>second {i}</p></div><div class='c'><p>All rights</p></div>"


def folded(pages):
    whole = Wrapper.of(runs(parsed(pages[0])))
    for p in pages[1:]:
        whole.align(Wrapper.of(runs(parsed(p))))
    return whole


def test_the_wrapper_tells_constants_slots_repeats_and_options():
    whole = folded([soup(i) for i in range(6)] + [soup(9).replace("<ul><li>Home<li>About</ul>", "")])
    assert [(n[1] == 0, n[3], bool(n[4])) for n in whole.nodes] == [(False, 6, True), (False, 7, False), (True, 7, True), (False, 7, False), (True, 7, False), (False, 7, False)]
    assert main_text(soup(3), whole) == "Always\nown text 3 and more of it, number 3\nsometimes\nsecond 3"
    assert main_text(soup(3)).startswith("Always\nown text 3") and "Fixed list" in main_text(soup(3))


def test_alignment_of_twin_paths():
    w = folded(["<p>a</p><div>x</div><p>c</p>", "<div>x</div><p>c</p>", "<p>b</p><div>x</div><p>c</p><p>c</p><ul><li>n</ul>"])
    assert [(n[1] == 0, n[3]) for n in w.nodes] == [(True, 2), (False, 3), (True, 3), (False, 1)]


def test_longest_rising_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.randrange(8) for _ in range(rng.randrange(9))]
        best = max(sum(m >> i & 1 for i in range(len(x))) for m in range(1 << len(x)) if (lambda s: s == sorted(set(s)))([v for i, v in enumerate(x) if m >> i & 1]))
        got = [v for v, _ in html_text._longest_rising(list(zip(x, range(len(x)), strict=True)))]
        assert got == sorted(set(got)) and len(got) == best


@pytest.mark.parametrize(("merged", "nodes"), [(64, 500_000), (2, 0)])
def test_hosts_by_rounds_and_by_join(spark, monkeypatch, merged, nodes):
    monkeypatch.setattr(html_text, "MERGED", merged)
    monkeypatch.setattr(html_text, "MOST_NODES", nodes)
    rows = [(i, f"http://soup.x/{i}", soup(i)) for i in range(40)] + [(100, "http://soup.x/3", soup(3))] * 3
    rows += [(200 + i, "http://copies.x/", "<article><h1>T</h1><p>the same</p></article><p>foot</p>") for i in range(5)] + [(300, None, None)]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], "page_id long, url string, html string, host string, pages int").repartition(7)
    got = html_text.extracted(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].text == "Always\n" + f"own text {i} and more of it, number {i}\n" + "sometimes\n" * (i % 2) + f"second {i}" for i in range(40))
    assert by[100].text == by[3].text and by[204].text == "T\nthe same" and by[300].text == "" and by[3].n_chars == len(by[3].text)


def page(i, notice="Read our newsletter", lists=True):
    """An article with a notice that doesn't say what it is, and blocks whose names only partly say so: one the same everywhere, one not."""
    named = "class='social-notes'" if lists else "class='k1'"
    other = "class='press-related'" if lists else "class='k2'"
    return f"<nav>menu</nav><article><h1>Same head</h1><p>Own text {i} goes on.</p><div {named}>About topic {i}</div><blockquote>{notice}</blockquote><div {other}>Follow us</div></article><footer>f</footer>"


@pytest.mark.parametrize("lists", [True, False])
def test_the_wrapper_decides_inside_articles(monkeypatch, lists):
    if not lists:
        for name in ("_HINTS", "_TOPICS", "_OUTER_HINTS"):
            monkeypatch.setattr(html_text, name, frozenset())
    whole = folded([page(i, lists=lists) for i in range(6)])
    assert main_text(page(3, lists=lists), whole) == "Same head\nOwn text 3 goes on.\nAbout topic 3"
    alone = main_text(page(3, lists=lists)).split("\n")
    assert alone == ["Same head", "Own text 3 goes on.", "About topic 3", "Read our newsletter", "Follow us"]
    two = folded([page(i, lists=lists) for i in range(2)])
    assert main_text(page(1, lists=lists), two).split("\n")[3:] == ["Read our newsletter", "Follow us"]
    some = folded([page(i, f"Note {i}", lists) for i in range(6)] + [page(9, "Read our newsletter", lists)])
    assert "Note 4" in main_text(page(4, "Note 4", lists), some)
