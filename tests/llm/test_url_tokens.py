"""URL rules next to raw text that is not ASCII."""

import re

import duckdb

from barflow.llm import queries, url_rules

URLS = [
    "http://a.org/日本casino", "http://a.org/casino日本", "http://écasino.org/", "http://a.org/x/winé", "http://a.org/日本casinos", "http://a.org/日本/CASINO", "http://日本.example.com/en/é7",
    "http://example.comé/en/7", "http://a.org/ca日sino", "http://a.org/\u212acasino", "http://a.org/win\u0130", "http://a.org/w\u0130n", "http://a.org/\U0001f600win\U0001f600",
]


def test_words_next_to_other_letters_against_brute_force(spark):
    words, (host, start) = ["casino", "win"], ("example.com", "/en/é7")
    rules = url_rules.rule_table(spark, [*map(url_rules.word_rule, words), url_rules.path_rule(host, start, "allow")])
    got = {r["url"]: r["hit"] and r["hit"]["rule"] for r in url_rules.apply_rules(spark.createDataFrame([(u,) for u in URLS], "url string"), rules, ["url"], "url").collect()}
    for u in URLS:
        own, path = re.match("http://([^/]*)(.*)", u).groups()
        want = next((w for w in words if re.search(f"(^|[^a-z0-9]){w}($|[^a-z0-9])", f"{own}\n{path}", re.I | re.A)), None)
        assert got[u] == (host + start if f".{own}".endswith(f".{host}") and path.startswith(start) else want), u
    assert sum(x == "casino" for x in got.values()) == 5


# The contract's list, written out a second time, with the word of each rule.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_contract_rules_in_query_and_sql(spark, tmp_path):
    assert {h + p: v for h, p, v in queries.PATH_RULES} == CONTRACT
    # a page for each rule, one of a subdomain whose path goes on, and one that only an unwanted word could block
    urls = [f"http://{w}{rule}{end}" for rule in CONTRACT for w, end in (("", ""), ("www.", "1/casino?x"))] + ["http://a.net/dx/casino", "http://a.net/dx/"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.QUERIES["op5_url_token_rules"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = {i: (rule, verdict) for i, _, _, rule, verdict in con.execute(queries.SQL["op5_url_token_rules"]).fetchall()}
    want = {i: (rule, CONTRACT[rule]) for i, rule in enumerate(rule for rule in CONTRACT for _ in range(2))} | {10: (None, "block"), 11: (None, "allow")}
    assert got == want and sql == want
