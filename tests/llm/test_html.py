import random

import pytest

from gridloom.llm import html as H

SCHEMA = "page_id long, url string, html string, id int, host string, path string, lines string, text string"


def text_of(page):
    inside, outside, found = H.blocks(page)
    return inside if found else outside


@pytest.mark.parametrize(("page", "want"), [
    ("", []),
    ("plain &amp; simple", ["plain & simple"]),
    ("<article><p>One  <b>two</b>\n three</p><p>Four<br>five</p></article>", ["One two three", "Four five"]),
    ("<nav>menu</nav><article><header><h1>Title</h1></header><p>Text</p><footer>by me</footer></article><footer>foot</footer>", ["Title", "Text"]),
    ("<body><script>if (a < b) { document.write('<p>x</p>'); }</script><article><p>a &lt; b</p><style>p{}</style></article>", ["a < b"]),
    ("<article><p>Unclosed<p>paragraphs<ul><li>x<li>y</ul></article>", ["Unclosed", "paragraphs", "x", "y"]),
    ("<article><p>a</p><div class='ad'>buy</div><div class=\"comments\"><p>nice</p></div><aside>side</aside><p>b</p></article>", ["a", "b"]),
    ("<main><p>caf&eacute; &#233; &#x1F600; &unknown;</p></main>", ["café é 😀 &unknown;"]),
    ("<article><!-- <p>no</p> --><p title='a > b'>yes</p><table><tr><td>1</td><td>2</td></tr></table></article>", ["yes", "1", "2"]),
    ("<div class=\"ad\">never closed<article><p>text</p></article>", ["text"]),
    ("<article><p>x</p><form><label>Name</label><input></form><div id='cookie-notice'>we use cookies</div></article>", ["x"]),
    ("<article><p>a<", ["a<"]),
    ("<article><p>loads of address headers in an advertising-free text</p></article>", ["loads of address headers in an advertising-free text"]),
])
def test_blocks(page, want):
    assert text_of(page) == want


def test_deep_and_long_pages():
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    assert text_of("<article><p>" + "word " * 100_000 + "</p></article>")[0].count("word") == 100_000
    assert text_of("<article><p>" + "<" * 20_000) == ["<" * 20_000]


def lcs_length(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_longest_common_subsequence():
    r = random.Random(7)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        at = sorted(H.common_lines(a, b))
        assert len(at) == lcs_length(a, b)
        it = iter(b)
        assert all(a[k] in it for k in at)  # a subsequence of b


def test_pages_without_article_lose_shared_lines(spark):
    page = lambda k: f"<div>Site name</div><div>Body of page {k}</div><div>Second line {k}</div><div>All rights reserved</div>"
    rows = [(k, f"http://h.example/news/{k}", page(k)) for k in range(200)]
    rows += [(300, "http://alone.example/x", page(300)), (301, None, page(301)), (302, "http://two.example/a", page(1)), (303, "http://two.example/b", page(1)), (304, "http://h.example/news/5", None)]
    df = spark.createDataFrame([(*r, 1, "h", "p", "l", "t") for r in rows], SCHEMA).repartition(7)
    got = {r.id: r.text for r in H.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == f"Body of page {k}\nSecond line {k}" for k in range(200))
    whole = "Site name\nBody of page {0}\nSecond line {0}\nAll rights reserved"
    assert got[300] == whole.format(300) and got[301] == whole.format(301) and got[302] == got[303] == whole.format(1) and got[304] == ""


def test_differencing_against_brute_force(spark):
    """Per host: the first page of each text in order of path, id and url, against the neighbour of the longer shared path; copies get the same, empty pages nothing."""
    r = random.Random(12)
    rows = []
    for k in range(400):
        host = r.choice(["a.example", "b.example", "b.example"])
        body = [r.choice(["Menu", "Home", "Imprint", "One line", "Another line"]) for _ in range(r.randint(0, 4))] + [f"Own {r.randint(0, 60)}" for _ in range(r.randint(0, 3))]
        rows.append((k, f"http://{host}/{r.choice('xyz')}/{r.choice('pq')}/{r.randint(0, 40)}", "".join(f"<div>{x}</div>" for x in body)))
    rows += [(1000 + k, "http://b.example/x/p/1", "<div>Menu</div><div>The copy</div>") for k in range(200)]
    want, texts = {}, {}
    for i, u, h in rows:
        host, path = H.host_and_path(u)
        lines = tuple(H.blocks(h)[1])
        want[i] = ""
        if lines:
            texts.setdefault(host, {}).setdefault(lines, []).append((path, i, u))
    for by in texts.values():
        firsts = sorted((min(v), lines) for lines, v in by.items())
        for n, ((path, _, _), lines) in enumerate(firsts):
            near = [firsts[m] for m in (n - 1, n + 1) if 0 <= m < len(firsts)]
            same = lambda f, path=path: len(__import__("os").path.commonprefix([path.split("/"), f[0][0].split("/")]))
            other = max(near, key=same)[1] if near else ()
            own = "\n".join(x for k, x in enumerate(lines) if k not in H.common_lines(list(lines), list(other)))
            want.update({i: own for _, i, _ in by[lines]})
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {x.id: x.text for x in H.extract(df).collect()} == want


def test_article_sections_with_common_names_stay():
    page = "<article><div class='article-header'><h1>Title</h1></div><section id='related-work'><p>Work.</p></section><section id='search'><p>How to search.</p></section><p>Sum <math><mi>x</mi></math> of <noscript>plain</noscript> text</p><div class='ad'>Buy</div><div class='comments'>Nice!</div><div class='ad-slot'>Buy more</div></article>"
    assert H.blocks(page)[0] == ["Title", "Work.", "How to search.", "Sum x of plain text"]


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>x</p></article>"), (2, "http://a/b", ""), (3, "http://a/b", "<html></html>")]
    df = spark.createDataFrame([(*r, 1, "h", "p", "l", "t") for r in rows], SCHEMA)
    got = {(r.id, r.url, r.text) for r in H.extract(df).collect()}
    assert got == {(1, "u", ""), (None, None, "x"), (2, "http://a/b", ""), (3, "http://a/b", "")} and H.extract(df).count() == 5
    assert H.extract(df.limit(0)).count() == 0
