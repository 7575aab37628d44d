import html as entities
import os
import random
import re
from urllib.parse import urlsplit

import duckdb
import pytest

from streetflow.llm import html


def article(page):
    m = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", m)]
    return "\n".join(b for b in blocks if b)


def test_articles_of_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.connect().execute(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    got = {r.page_id: (r.text, r.n_chars) for r in html.query(spark, sf).collect()}
    assert got == {i: (article(h), len(article(h))) for i, h in rows}


def test_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = [x for x, k in zip(a, html.common(a, b)) if k]
        it = iter(b)
        assert len(kept) == table[-1][-1] and all(x in it for x in kept)


def test_differencing_without_article(spark):
    page = "<body><div>Site name</div><div>{}</div><div>Read more here</div></body>"
    rows = [(i, f"http://h/a/{i}", page.format(f"Own text {i}")) for i in range(4)]
    rows += [(9, "http://other/", page.format("Alone")), (10, None, None), (11, "", ""), (None, "http://[bad", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in html.extract(df.repartition(1)).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(4))
    assert got[9] == "Site name\nAlone\nRead more here" and got[10] == got[11] == "" and got[None] == "x"
    assert html.extract(df.limit(0)).count() == 0


def test_markup():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Top</header>
    <nav><ul><li><a href=x>One</a></li></ul></nav><div class="cookie-notice"><div>We use</div> cookies</div>
    <article><header><h1>Ti&amp;tle</h1></header><p>a  b<br>c <b>d</b><p>e &lt;f&gt;<script>var x="</p>";</script>
    <div class="ad">buy</div><aside>side</aside><form><input>go</form><section id="comments"><p>nice</p></section>
    <p>last</article><footer>&copy; x</footer></body>"""
    assert html.main_text(html.lines_of(page), None) == "Ti&tle\na b\nc d\ne <f>\nlast"
    assert html.main_text(html.lines_of("<div class=ad>never closed <p>text"), None) == "never closed\ntext"
    assert html.main_text(html.lines_of("x" * 2_000_000 + "<"), None).startswith("xxx")
    assert html.lines_of("<!-- open") == [] and html.lines_of("<p") == []


def test_marks():
    text = lambda page: html.main_text(html.lines_of(page), None)
    assert text('<div class="layout has-sidebar"><div class="main-menu">m</div><p>keep</p><div id="user_comments">c</div></div>') == "keep"
    assert text('<article><div class="post-header"><h1>T</h1></div><p>x</p><article class="comment"><p>c</p></article></article>') == "T\nx"
    assert text('<div class="page-header">site</div><div role="contentinfo">f</div><p>x<p class="ad">buy<p>y') == "x\ny"


def by_hand(rows):
    """Texts from the whole order: each page against its nearer neighbour by path on its host."""
    split = lambda u: (urlsplit(u or "").netloc.lower(), urlsplit(u or "").path or "/")
    order = sorted(((*split(u), i, u, h) for i, u, h in rows), key=lambda x: x[:4])
    out = {}
    for k, (host, path, i, _, page) in enumerate(order):
        best = None
        for j in (k - 1, k + 1):
            if 0 <= j < len(order) and order[j][0] == host:
                same = len(os.path.commonprefix([order[j][1], path]))
                if best is None or same > best[0]:
                    best = (same, html.lines_of(order[j][4]))
        out[i] = html.main_text(html.lines_of(page), best and best[1])
    return out


def site(r, hosts, pages):
    """Pages without article elements: shared lines, lines shared by a section, own lines."""
    rows = []
    for h in range(hosts):
        for k in range(pages):
            section = r.choice(["news", "sport", "about"])
            own = "".join(f"<p>own {h} {k} {r.random()}</p>" for _ in range(r.randint(0, 3)))
            extra = f"<div>{section} of host {h}</div>" * r.randint(0, 2)
            rows.append((len(rows), f"http://Host{h}/{section}/{r.randint(0, 9)}/{k}?q={r.random()}",
                         f"<div>site {h}</div>{extra}<div class=menu><i>{r.random()}</i></div>{own}<div>bottom {h}</div>"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 16, 211])
def test_partners_do_not_depend_on_partitions(spark, parts):
    rows = site(random.Random(3), 8, 23) + site(random.Random(4), 1, 2)[:1]
    rows = [(i, u, h) for i, (_, u, h) in enumerate(rows)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.page_id: r.text for r in html.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = by_hand(rows)
    assert got == want
    lone = {i: html.main_text(html.lines_of(h), None) for i, _, h in rows}
    assert sum(lone[i] != want[i] for i in want) > 0.9 * len(rows)


def test_clashing_and_repeated_rows(spark):
    rows = [(1, "http://h/a", "<p>one", "x", 1, True)] * 3 + [(None, "http://h/b", "<p>one<p>two", "y", 2, False)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, range_no int, edge boolean")
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 4
    assert [r.text for r in got.where("page_id is null").collect()] == ["two"]
