"""URL rules and alias classes, against the SQL on planted links and against plain Python."""

import duckdb
import pytest

from weekpanel.llm import url_filter
from weekpanel.llm.queries import ORACLE, URL_RULES, QUERIES
from weekpanel.llm.url_filter import Rule

SCHEMA = "page_id long, url string, html string, node string, host string, verdict string, root string"


def link(to, rel="canonical"):
    return f'<head><link rel="{rel}" href="{to}"></head>'


def refresh(to):
    return f"<META content='0; URL={to}' http-equiv=Refresh>"


#: page_id, url, html, verdict expected
PLANTED = [
    (1, "http://a.net/start", link("https://b.com/de/7"), "block"),  # the target is no page
    (2, "http://c.net/x?q=1", refresh("http://a.net/start#part"), "block"),  # by way of page 1
    (3, "https://c.net/x?q=2", link("http://example.org/other"), "allow"),
    (4, "http://d.net/1", link("http://b.com/de/8") + link("https://e.org/any"), "allow"),  # an allow in the class
    (5, "http://www.b.com/fr/5", link("http://b.com/de/8"), "allow"),  # its own rule
    (6, "http://b.com/de/9", link("http://e.org/any"), "block"),  # its own rule
    (7, "http://f.net/a/b/c.html", link("../../a/./b/d"), "block"),
    (8, "http://f.net/a/b/d", refresh("//b.com/de/1"), "block"),
    (9, "http://g.net/1", "<!-- " + link("http://b.com/de/1") + " -->", "allow"),
    (10, "http://g.net/2", "<script>var t='" + link("http://b.com/de/1") + "';</script>", "allow"),
    (11, "http://g.net/3", link("http://b.com/de/1", rel="alternate"), "allow"),
    (12, "http://g.net/4", "<link href=http://b.com/de/3?a=1&amp;b=2 rel='nofollow CANONICAL'>", "block"),
    (13, "http://h.net", link("http://h.net/"), "block"),  # the address of page 14
    (14, "https://h.net#x", refresh("/sub?y"), "block"),
    (15, "ftp://h.net/sub?y", link("http://b.com/de/"), "block"),
    (16, None, link("http://b.com/de/1"), "allow"),
    (17, "no address", link("http://b.com/de/1"), "allow"),
    (18, "http://", link("http://b.com/de/1"), "allow"),
    (19, "http://i.net/1", link("mailto:a@b.com"), "allow"),
    (20, "http://i.net/2", link(""), "allow"),
    (21, "http://EXAMPLE.org/en/17", None, "block"),
    (22, "http://blog.example.org/en/2", "", "allow"),
    (23, "http://myexample.org/es/1", None, "allow"),
    (24, "http://x.org?/es/", None, "allow"),
    (25, "http://a.net/start", None, "block"),  # the address again, without a link of its own
    (25, "http://a.net/start", None, "block"),
    (26, "http://j.net/k", link("?other=1"), "allow"),
    (27, "http://example.org:80/es/3", None, "allow"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r[:3], "x", "y", "z", "w") for r in rows], SCHEMA)


def in_duckdb(frame):
    table = duckdb.connect()
    table.register("pages", frame.select("page_id", "url", "html").toArrow())
    return table.sql(ORACLE["op12_url_filter"])


def rows_of(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


COLUMNS = ["page_id", "host", "path", "rule", "verdict", "alias_of"]


def test_planted_links_decide_as_expected(spark):
    got = url_filter.judged_pages(pages(spark, PLANTED).repartition(3), URL_RULES)
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == sorted((r[0], r[3]) for r in PLANTED)


def test_planted_links_as_in_sql(spark):
    frame = pages(spark, PLANTED)
    relation = in_duckdb(frame)
    expected = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert rows_of(url_filter.judged_pages(frame, URL_RULES).collect(), COLUMNS) == rows_of(expected, COLUMNS)
    assert sum(r["alias_of"] is not None for r in expected) >= 15


def test_a_long_chain_and_a_hot_target(spark):
    """A block goes along forty redirects, and to a thousand pages with one canonical address."""
    chain = [(k, f"http://n.net/{k}", link(f"http://n.net/{k + 1}")) for k in range(40)]
    chain += [(40, "http://n.net/40", link("http://b.com/de/end"))]
    star = [(100 + k, f"http://s.net/{k}", link("http://s.net/home")) for k in range(1000)]
    got = url_filter.judged_pages(pages(spark, chain + star), URL_RULES).collect()
    assert {r["verdict"] for r in got if r["page_id"] <= 40} == {"block"}
    assert {r["alias_of"] for r in got if r["page_id"] <= 40} == {"b.com/de/end"}
    assert {(r["verdict"], r["alias_of"]) for r in got if r["page_id"] >= 100} == {("allow", "s.net/0")}


def test_redirects_of_a_log(spark):
    log = spark.createDataFrame(
        [("http://p.net/", "http://b.com/de/1"), ("http://q.net/", None), (None, "http://q.net/"), ("junk", "http://q.net/")],
        "from_url string, to_url string",
    )
    frame = pages(spark, [(1, "http://p.net", None), (2, "http://q.net", None)])
    got = url_filter.judged_pages(frame, URL_RULES, log).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "allow"}


def test_the_longest_rule_wins_and_allow_breaks_ties(spark):
    rules = [Rule("block", "a.b", "/"), Rule("allow", "a.b", "/c"), Rule("block", "x.a.b", "/"), Rule("allow", "x.a.b", "/")]
    urls = ["http://a.b/", "http://a.b/cd", "http://x.a.b/c", "http://z.a.b", "http://ba.b/"]
    got = url_filter.judged_pages(pages(spark, [(k, u, None) for k, u in enumerate(urls)]), rules).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {
        0: ("a.b/", "block"), 1: ("a.b/c", "allow"), 2: ("x.a.b/", "allow"), 3: (None, "allow"), 4: (None, "allow"),
    }
    with pytest.raises(ValueError, match="allows or blocks"):
        url_filter.judged_pages(pages(spark, []), [Rule("deny", "a", "/")])


def test_empty_tables_and_very_long_pages(spark):
    assert url_filter.judged_pages(pages(spark, []), URL_RULES).collect() == []
    long = "<p>canonical " + "x<" * 400_000 + link("http://b.com/de/1") + "<meta " + "y" * 400_000
    got = url_filter.judged_pages(pages(spark, [(1, "http://r.net/", long)]), URL_RULES).collect()
    assert [r["verdict"] for r in got] == ["block"]


def test_no_python_on_the_way(spark, physical_plan):
    plan = physical_plan(QUERIES["op12_url_filter"](spark, "/root/testdata/sf0.001"))
    assert "Python" not in plan and "MapInArrow" not in plan
