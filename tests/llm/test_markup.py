import html
import re

from llm.markup import Page, main_text

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{x:">"}</style></head><body><header class="site-header">H</header>
<nav><ul><li>menu</ul></nav><div class="cookie-notice">C</div><main><article class="post"><header><h1>Head  line</h1></header>
<p>One &amp; two<br>three <b>bold</b>x</p><div class="ad">ad</div><ul><li>a<li>b</ul>tail<form><input><p>f</p></form>
<script>var t="</p>";</script><!-- <p>no</p> --><section id="comments"><article><p>said a reader</p></article></section></article></main>
<aside>S</aside><footer>F</footer>"""


def test_article_only():
    assert Page(FULL).text() == "Head line\nOne & two three boldx\na\nb\ntail"


def test_dropped_inside_a_block():
    assert Page("<article><section>one <span class='ad'>x<b>y</b><div>z</div></span> two <button>b</button><i>three</i></section></article>").text().split() == ["one", "two", "three"]


def test_malformed():
    assert Page("<body><div><p>just</p> text <p>here<table><tr><td>c1<td>c2</table></div>").text() == "just\ntext\nhere\nc1\nc2"
    assert Page("<p>a < b &lt; c <b").text().startswith("a < b < c")
    for text in (None, "", "<", "<!--", "<script>x", "</p></div>", "<div" * 500):
        Page(text).text()
    assert Page("<article><p>x" + "<b>y" * 3000).text() == "x" + "y" * 3000


def test_synthetic_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    out = main_text(pages).collect()
    assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out) and len(out) == len(want)


def test_templates_of_a_host(spark):
    body = "<div>Shop of the year</div><div><p>{}</p></div><div><ul><li>Home<li>Help</ul></div>"
    rows = [(i, "http://a.example/x", body.format(f"text {i}")) for i in range(8)]
    rows += [(20, "http://b.example/", body.format("alone")), (21, None, None), (22, "http://a.example/", ""), (23, "http://a.example/", "<article><p>Shop of the year</p></article>")]
    rows += [(30 + i, "http://c.example/", f"<article><p>copy</p><div>Write to us</div><p>{i}</p></article>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("rid", "host", "hash", "open", "text"):
        df = df.selectExpr("*", f"'x' as {name}")
    out = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(out[i] == f"text {i}" for i in range(8))
    assert out[20] == "Shop of the year\nalone\nHome\nHelp"
    assert out[21] == out[22] == "" and out[23] == "Shop of the year"
    assert all(out[30 + i] == f"copy\n{i}" for i in range(4))
    assert main_text(df.filter("page_id < 0")).count() == 0


def test_copied_articles_and_bodies_stay(spark):
    article = "<p>" + "A copied sentence of the article. " * 10 + "</p>"
    shell = "<html><body><div class='menu-bar x'><p>Menu of the shop</p></div><div id='wrap'>{}</div><div><p>Legal lines</p></div></body></html>"
    in_article = shell.format(f"<article><h1>Head</h1><div class='entry'>{article}</div></article>")
    in_main = shell.format(f"<main><div class='entry'>{article}</div></main>")
    text = " ".join(("A copied sentence of the article. " * 10).split())
    rows = [(i, "http://all.example/x", in_article) for i in range(5)]
    rows += [(10 + i, "http://third.example/x", in_article) for i in range(4)]
    rows += [(20 + i, "http://third.example/x", shell.format(f"<article><p>own {i}</p></article>")) for i in range(8)]
    rows += [(30 + i, "http://main.example/x", in_main) for i in range(4)]
    rows += [(40 + i, "http://bare.example/x", f"<html><body><div><div class='b'>{article}</div><p>{'visit ' * (i % 2)}{i}</p></div></body></html>") for i in range(6)]
    rows += [(50 + i, "http://same.example/x", "<html><body><div><p>short</p></div><div><p>body</p></div></body></html>") for i in range(6)]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Head\n{text}" for i in (*range(5), *range(10, 14)))
    assert all(out[20 + i] == f"own {i}" for i in range(8))
    assert all(out[30 + i] == text for i in range(4))
    assert all(out[40 + i].startswith(text) for i in range(6))
    assert all(out[50 + i] == "short\nbody" for i in range(6))


def test_class_names_are_judged_whole():
    text = "<p>The article's own text.</p>"
    for shell in ('<div class="site-content no-sidebar">{}</div>', '<article class="post comments-open">{}</article>', '<div class="social-science">{}</div>', '<div class="widget">{}</div>', '<main class="menu">{}</main>'):
        assert Page(f"<body>{shell.format(text)}<div class='cookie-notice'>We use them</div></body>").text() == "The article's own text.", shell
    page = "<body><div class='main-menu'>Home</div><div id='page'><p>" + "long text " * 20 + "</p><div class='related-posts'><p>more</p></div></div></body>"
    assert Page(page).text() == ("long text " * 20).strip()


def test_main_text_beside_a_teaser():
    both = "<main><p>" + "long text " * 20 + "</p><article class='card'><p>teaser</p></article></main>"
    assert Page(both).text() == ("long text " * 20).strip() + "\nteaser"
    assert Page("<main><p>by someone</p><article><p>" + "long text " * 20 + "</p></article></main>").text() == ("long text " * 20).strip()


def test_time_grows_with_the_length_of_a_page():
    import time

    n = 60_000
    pages = ["<div>a" * n, "<b>" + "<article>" + "<div>x" * n + "</b>" * n, "<ul>" + "<div>" * n + "<li>y" * n, "<title>" * n + "z", "<td>" * n + "</p>" * n, "<p>q" * n, "<nav>" + "<i>m" * n, "<div class='ad'>" * n + "w"]
    for page in pages:
        start = time.perf_counter()
        Page(page).text({1})
        assert time.perf_counter() - start < 20, page[:30]  # quadratic: many minutes


def test_host_counts_against_brute_force(spark):
    """Every host's pages, articles too, against counts made with plain sets."""
    import math
    import random

    rnd = random.Random(6)
    rows = []
    for host in range(6):
        boxes = [f"<div class='b{k}'>Box {k} of {host}</div>" for k in range(5)]
        for i in range(rnd.choice([2, 5, 25])):
            used = "".join(b for b in boxes if rnd.random() < 0.4)
            body = f"<p>own words {host} {i} " + "and more of them " * rnd.randint(1, 20) + "</p>"
            shape = rnd.choice(["<div id='w'>{b}</div>{u}", "<article>{b}{u}</article>", "<main>{b}{u}</main>"])
            rows += [(len(rows), f"http://h{host}.example/{i}", f"<html><body>{shape.format(b=body, u=used)}</body></html>")] * rnd.choice([1, 1, 2])
    rows = [(n, u, h) for n, (_, u, h) in enumerate(rows)]
    pages = [(n, u.split("/")[2], Page(h)) for n, u, h in rows]
    contents, holders, inside = {}, {}, {}
    for _, host, page in pages:
        contents.setdefault(host, set()).add(page.text())
        for h, i, _ in page.tree()[0]:
            holders.setdefault((host, h), set()).add(page.text())
            inside[host, h] = inside.get((host, h), False) or i
    want = {}
    for n, host, page in pages:
        recurring = {h for (x, h), seen in holders.items() if x == host and len(seen) >= max(3, math.ceil(len(contents[host]) * (0.5 if inside[x, h] else 0.1)))}
        want[n] = page.text(recurring)
    out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in out} == want and len(out) == len(rows)
    changed = [n for n, _, page in pages if want[n] != page.text()]
    assert any("<article>" in rows[n][2] for n in changed) and any("id='w'" in rows[n][2] for n in changed)
