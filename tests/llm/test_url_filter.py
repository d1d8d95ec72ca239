import duckdb
import pytest

from lodestrata.llm import url_filter

PAGES = "page_id long, url string, host string, template string, n int"


def pages(spark, urls: list):
    return spark.createDataFrame([(i, u, "clash", "clash", 1) for i, u in enumerate(urls)], PAGES).repartition(3)


@pytest.fixture(scope="module")
def site() -> list:
    """A host with ids below sections, blocked in two of four sections of .net."""
    out = [f"http://a.net/{s}/{i}{'.html' if i % 3 == 0 else ''}" for s in ("en", "es", "fr", "de") for i in range(12)]
    out += [f"http://b.org/shop/{i}/view" for i in range(30)] + [f"http://b.org/u{i}" for i in range(9)]
    return out + [f"https://x.example.com/en/{i}" for i in range(8)] + [f"https://www.example.com/en/{i}?q=/es/" for i in range(8)]


def rows(df) -> dict:
    return {r.page_id: r for r in df.collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        (None, "", "", None), ("", "", "", None), ("no scheme/net/es/", "", "", None), ("HTTP://WWW.Example.COM/en/a?b#c", "www.example.com", "/en/a", "www.example.com/en/"),
        ("x://sub.www.example.com/en/", "sub.www.example.com", "/en/", "www.example.com/en/"), ("x://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
        ("x://a.example.com/en", "a.example.com", "/en", "com/"), ("x://com", "com", "", None), ("x://notcom/", "notcom", "/", None), ("x://b.NET/es/://net/fr/", "b.net", "/es/://net/fr/", "net/es/"),
        ("x://b.net?/fr/", "b.net", "", None), ("x://b.net#/fr/", "b.net", "", None), ("://net/fr/#x", "net", "/fr/", "net/fr/"), ("x://ÄB.com/", "Äb.com", "/", "com/"), ("x://net:80/es/", "net:80", "/es/", None),
    ]
    got = rows(url_filter.verdicts(pages(spark, [c[0] for c in cases])))
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        verdict = {None: None, "com/": "allow", "www.example.com/en/": "allow"}.get(rule, "block")
        assert verdict is None or got[i].verdict == verdict


def test_templates_generalise_and_merge(spark, site):
    got = rows(url_filter.verdicts(pages(spark, site)))
    of = {u: got[i] for i, u in enumerate(site)}
    assert of["http://a.net/es/1"].template == "/es|fr/*" and of["http://a.net/en/1"].template == "/en/*"
    assert of["http://a.net/es/1"].labelled == 24 and of["http://a.net/en/1"].labelled == 0
    assert of["http://a.net/de/1"].verdict == "allow" and of["http://b.org/shop/3/view"].template == "/shop/*/view" and of["http://b.org/u3"].template == "/*"


def test_labelled_urls_reject_what_no_rule_names(spark, site):
    labelled = spark.createDataFrame([(f"http://b.org/shop/{i}/view", i < 19) for i in range(20)] + [("http://b.org/u1", True), (None, None)], "url string, blocked boolean")
    got = rows(url_filter.verdicts(pages(spark, site), labelled=labelled))
    assert len(got) == len(site)
    shop = {r.verdict for r in got.values() if r.host == "b.org" and r.path.startswith("/shop/")}
    users = {r.verdict for r in got.values() if r.path.startswith("/u")}
    assert shop == {"block"} and users == {"allow"}  # one label of a template does not reject it


def test_held_out_labels_are_found_again(spark, site):
    said = {(r.blocked, r.rejected): r.urls for r in url_filter.held_out(pages(spark, site)).collect()}
    assert said[(True, True)] > 10 and not said.get((False, True)) and not said.get((True, False))


def test_sql_says_the_same_of_odd_urls(spark, site):
    odd = ["http://h.org/" + "/".join(["a"] * k) + end for k in (0, 1, 5, 6, 7, 400) for end in ("", "/", "//x", "/*", "/a|b") for _ in range(5)]
    odd += ["http://net/es/" + "y" * 100_000, None, None, "ftp://h.org/\n1\t", "http://h.net/fr/ç|*/" * 3] + ["http://a.net/es/7"] * 40 + site
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(odd)))
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "labelled"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({url_filter.SQL})").fetchall())
    assert sorted(tuple(r) for r in url_filter.verdicts(pages(spark, odd)).select(columns).collect()) == want


def test_nothing_and_no_rules(spark, site):
    assert url_filter.verdicts(pages(spark, [])).count() == 0
    free = url_filter.verdicts(pages(spark, site[:20]), rules=[]).collect()
    assert len(free) == 20 and {(r.rule, r.verdict) for r in free} == {(None, "allow")}
