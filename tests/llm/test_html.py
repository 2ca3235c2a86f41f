"""Main text of pages: split articles, hidden elements, depth, votes."""

import time
from collections import Counter, defaultdict

from panelforge.llm.html_text import Page, extract, host_paths, main_text

SCHEMA = "page_id long, url string, html string"


def words(word, n):
    return " ".join([word] * n)


def test_split_article_stays_whole():
    one, two = words("first", 60), words("second", 50)
    page = (f"<body><div class='w'><div class='intro'><p>{one}</p></div><div class='rest'><p>{two}</p></div>"
            f"<div class='x'><a href='/'>{words('link', 40)}</a></div></div></body>")
    assert extract(page, None) == f"{one}\n\n{two}"
    # blocks directly under the common parent, in page order
    page = f"<body><section><div><p>{one}</p></div><p>{two}</p></section><div><p>short</p></div></body>"
    assert extract(page, None) == f"{one}\n\n{two}"


def test_hidden_elements_are_left_out():
    page = ("<body style='display: none'><main><p>seen</p><p hidden>a</p><p aria-hidden='true'>b</p>"
            "<div style='color:red; DISPLAY :none'>c</div><p data-hidden='1' title='hidden'>also seen</p></main></body>")
    assert extract(page, None) == "seen\n\nalso seen"


def test_depth_is_linear():
    took = []
    for n in (20_000, 80_000):
        for opened in ("<div>", "<div class='menu'>", "<section class='a b'>"):
            begin = time.time()
            assert extract(opened * n + "text" + "</div>" * n, None) == "text"
            took.append(time.time() - begin)
    assert sum(took[3:]) < 12 * max(sum(took[:3]), 0.5)


def test_equal_scores_and_names():
    html = "<div class='b9 a1'><p>same</p></div><div class='c'><p>same</p></div>"
    page = Page(html)
    assert page.best()[0] == "" and extract(html, None) == "same\n\nsame"     # the page opens before both
    assert Page(html + "<div class='d'><div class='e'><p>same</p></div></div>").best()[0] == ""
    assert page.find("div.a.b") == 1 and page.name(1) == "div.a.b" and page.find("div.none") is None


def test_votes_against_a_plain_count(spark):
    rows = []
    for k in range(60):
        host = f"h{k % 4}"
        inner = "intro" if k % 3 else "other"
        rest = f"<div class='rest'><p>{words('tail', 40)}</p></div>" if k % 5 else ""
        rows.append((k, f"http://{host}/{k}", f"<body><div class='w{k}'><div class='{inner}'><p>{words('body', 60 + k)}</p>"
                     f"</div>{rest}</div></body>"))
    rows += [(90, None, None), (91, "http://h0/x", ""), (92, "http://h9/x", "<nav>menu</nav>"), (7, rows[7][1], rows[7][2])]
    votes, score, beside = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, url, html in rows:
        best = Page(html or "").best()
        if best:
            host = url.split("/")[2]
            votes[host][best[0]] += 1
            score[host][best[0]] += best[1]
            for b in best[2]:
                beside[host, best[0]][b] += 1
    want = {}
    for host, n in votes.items():
        won = max(n, key=lambda p: (n[p], round(score[host][p]), p))
        want[host] = [won] + sorted(b for b, c in beside[host, won].items() if 2 * c >= n[won])
    table = spark.createDataFrame(rows, SCHEMA)
    hosts = table.selectExpr("lower(try_parse_url(url, 'HOST')) host", "html").na.fill("", ["host"])
    assert {r["host"]: r["paths"] for r in host_paths(hosts.repartition(5)).collect()} == want
    assert any(len(p) > 1 for p in want.values())
    got = sorted((r["page_id"], r["text"]) for r in main_text(table.withColumnRenamed("page_id", "host"), id_col="host")
                 .withColumnRenamed("host", "page_id").collect())
    assert got == sorted((i, extract(h, want.get((u or "//").split("/")[2]))) for i, u, h in rows)


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
