import duckdb
import pytest

from alertflow.llm import url_filter as U


def test_trie_precedence():
    t = U.RuleTrie([*U.QUERY_RULES, ("a.example.net", "", U.BLOCK), ("com", "/x", U.BLOCK), ("com", "/x/y/", U.ALLOW)])
    assert t.find("example.net", "/en/1") == ("example.net/en/", U.ALLOW)
    assert t.find("www.example.net", "/de/1") == ("net/", U.BLOCK)
    assert t.find("a.example.net", "") == ("a.example.net", U.BLOCK)
    assert t.find("b.a.example.net", "/en/") == ("a.example.net", U.BLOCK)  # more host labels win
    assert t.find("notexample.net", "/en/") == ("net/", U.BLOCK)
    assert t.find("example.com", "/xyz") == ("com/x", U.BLOCK)  # a rule's path may end inside a segment
    assert t.find("example.com", "/x/y/z") == ("com/x/y/", U.ALLOW)
    assert t.find("", "/") is None and t.find("net", "") is None and t.find("org", "/fr") is None


def test_refuses_bad_rule_sets():
    with pytest.raises(ValueError):
        U.RuleTrie([("a", "/", U.ALLOW), ("a", "/", U.BLOCK)])
    with pytest.raises(ValueError):
        U.RuleTrie([("a", "/", "maybe")])
    with pytest.raises(ValueError):
        U.RuleTrie([("a", "/", U.ALLOW), ("b", "/", U.ALLOW)], max_rules=1)


def test_edge_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/?q", "http://x.net?/a", "http://x.net#/a",
            "a://b://c.net/", "http://É.ORG/fr/x#y", "http://u.net/" + "p/" * 50_000]
    rows = [(i, u, "v") for i, u in enumerate(urls)] + [(None, "http://x.net/", "v"), (3, "http://x.net/", "v"), (3, "http://x.net/", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = U.filter_urls(df, U.QUERY_RULES).collect()
    by = {r.page_id: r for r in got if r.page_id not in (3, None)}
    assert len(got) == len(rows)
    for i in (0, 1, 2):
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == ("", "", None, "allow")
    assert (by[4].host, by[4].path, by[4].rule) == ("www.example.net", "/EN/", "net/")
    assert (by[5].host, by[5].path, by[5].rule) == ("x.net", "", None)
    assert (by[7].host, by[7].path) == ("b:", "//c.net/")
    assert (by[8].host, by[8].rule, by[8].verdict) == ("É.org", "org/fr/", "allow")
    assert len(by[9].path) == 100_001 and by[9].verdict == "block"
    assert [r.verdict for r in got if r.page_id is None] == ["block"]
    assert U.filter_urls(df.limit(0), U.QUERY_RULES).collect() == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.01/pages.parquet')")
    got = U.op8_url_filters(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(U.ORACLE).fetchall()))
