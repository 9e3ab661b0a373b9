from ledgerlake.llm import site_lines

SCHEMA = "page_id long, url string, html string, host string, lines string, drop int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "l", 1) for r in rows], SCHEMA)


def test_lines_above_the_ratio_go(spark):
    menu, rare = "<li>Home</li>", "<p>rare</p>"
    rows = [(i, f"https://U:p@Big.example:80/{i}?q", f"<title>T{i}</title>{menu}{menu}{rare if i < 3 else ''}<p>own <b>text</b> {i}</p><!-- x --><script>var a='<p>';</script>") for i in range(30)]
    rows += [(100 + i, f"http://small.example/{i}", f"{menu}\n{menu}\n p{i} ") for i in range(2)]
    rows += [(200, None, menu * 3), (201, "no url", menu), (202, "http://big.example/", None), (202, "http://big.example/", ""), (203, "http://a.example", "a" * 100_000)]
    got = {(r.page_id, r.text): r for r in site_lines.drop_site_lines(pages(spark, rows)).collect()}
    assert got[0, "T0\nrare\nown text 0"][:4] == (0, "big.example", 5, 2)  # 3 of 32 pages: not boilerplate
    assert got[29, "T29\nown text 29"].n_dropped == 2
    assert got[100, "Home\nHome\np0"].n_dropped == 0  # two pages are too few
    assert got[200, "Home\nHome\nHome"].host is None and got[201, "Home"].host is None
    assert got[202, ""].n_lines == 0 and got[203, "a" * 100_000].n_lines == 1
    assert site_lines.drop_site_lines(pages(spark, rows)).count() == len(rows)


def test_beginnings_without_an_end_hide_nothing_and_cost_no_search(spark):
    k = 40_000
    rows = [(i, "http://h.example", b * k) for i, b in enumerate(("<!--", "<script ", "<STYLE", "<!--<script<style"))]
    rows += [(10, "http://h.example", "a<!-- b --> c <!-- d"), (11, "http://h.example", "a<script>b</SCRIPT>c<script>d"), (12, "http://h.example", "<style>a</style><!-- </style>b"), (13, "http://h.example", "x</script>y<!--z-->w<!--"), (14, "http://h.example", "a <\ue000b")]
    got = {r.page_id: r for r in site_lines.drop_site_lines(pages(spark, rows)).collect()}
    assert [got[i].text for i in (10, 11, 12, 13, 14)] == ["a  c <!-- d", "a cd", "b", "xy w<!--", "a <b"]


def test_a_line_at_exactly_the_ratio_stays(spark):
    rows = [(i, "http://h.example", f"<p>own {i}</p>" + "<p>a</p>" * (i < 4) + "<p>b</p>" * (i < 5)) for i in range(20)]
    got = {r.page_id: r.text for r in site_lines.drop_site_lines(pages(spark, rows)).collect()}
    assert got[0] == "own 0\na" and got[4] == "own 4"


def test_same_rows_without_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>menu {i % 3}</p><p>own {i}</p>") for i in range(60)]
    want = sorted(map(tuple, site_lines.drop_site_lines(pages(spark, rows)).collect()))
    monkeypatch.setattr(site_lines, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, site_lines.drop_site_lines(pages(spark, rows)).collect())) == want


def test_empty_table(spark):
    assert site_lines.drop_site_lines(pages(spark, [])).count() == 0
