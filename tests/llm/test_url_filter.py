import re

import pyarrow.parquet as pq

from cohortloom.llm import url_filter


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def own(url, rules=url_filter.RULES):
    host, path = parts(url)
    fits = []
    for rule, action in rules:
        name, rest = rule.split("/", 1)
        if host and (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), action == "allow", rule, action))
    return max(fits)[2:] if fits else (None, None)


def test_query_equals_brute_force(spark, sf):
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    want = {r["page_id"]: (*parts(r["url"]), own(r["url"])[0], own(r["url"])[1] or "allow") for r in rows}
    got = url_filter.digest(spark, sf).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    assert {v for *_, v in want.values()} == {"allow", "block"}


def canonical(to):
    return f"<head><LINK href='{to}' rel=\"Canonical\"></head>"


def test_aliases_and_odd_urls(spark, frame):
    refresh = '<meta content="0; URL=//b.example.com/en/2" http-equiv="Refresh">'
    pages = [
        (1, "https://b.example.com/en/1", ""),  # blocked by rule
        (2, "http://alias.org/x", canonical("https://b.example.com/en/1#top")),
        (3, "http://alias.org/y/z", canonical("../../x") + canonical("/x")),
        (4, "http://other.org/", refresh),  # target is no page, but a rule blocks it
        (5, "http://free.org/", "<!-- " + canonical("https://b.example.com/en/1") + " --><script>" + canonical("http://alias.org/x") + "</script>"),
        (6, "http://both.org/", canonical("https://b.example.com/en/9")),
        (7, "http://www.example.com/en/ok", canonical("http://both.org/")),  # explicit allow in the same group
        (8, None, canonical("https://b.example.com/en/1")), (9, "no scheme", None), (10, "HTTP://A.NET/fr/x?q=/en/", None), (10, "HTTP://A.NET/fr/x?q=/en/", None),
        (11, "http://net/fr", ""), (12, "x://example.com?/en/", ""), (13, "http://EXAMPLE.com/en/#a://b", ""), (14, "http://x.com", ""), (15, "http://" + "a." * 3000 + "net/es/" + "b/" * 3000, ""),
    ]
    table = frame([(*p, "rule") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(table, frame(url_filter.RULES, "rule string, action string")).collect()}
    block = {1, 2, 3, 4, 10, 13, 15}
    assert {k: r.verdict for k, r in got.items()} == {k: "block" if k in block else "allow" for k, *_ in pages}
    for k, url, _ in pages:
        assert (got[k].host, got[k].path, got[k].rule) == (*parts(url), own(url)[0])


def test_redirect_table_empty_tables_and_ties(spark, frame):
    rules = frame([("b.c/p", "block"), ("c/pppp", "allow"), ("c/", "block"), ("d/", "block")], "rule string, action string")
    pages = frame([(k, f"http://h{k}.x/", None) for k in range(40)] + [(50, "http://b.c/pppp", None), (51, "http://b.c/p/q", None)], "page_id long, url string, html string")
    chain = frame([(f"http://h{k}.x/", f"http://h{k + 1}.x/") for k in range(30)] + [("http://h30.x", "http://d/"), (None, "http://h39.x/")], "source string, target string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, chain).collect()}
    assert {k for k, (_, v) in got.items() if v == "block"} == {*range(31), 51}
    assert got[50] == ("c/pppp", "allow") and got[51] == ("b.c/p", "block")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
