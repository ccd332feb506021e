import re

from labelfold.llm import url_filter as u

ROWS = [(1, None), (1, "nohost"), (2, "HTTP://A.Net/x"), (3, "http://net"), (4, "http://example.net/en/a?x=.exe"),
        (5, "http://casino/"), (6, "https://a.b/f.exe?x"), (None, "http://q.org/fr/éa#f"), (7, ""), (7, "x://"),
        (8, "http://notexample.com/de/"), (9, "http://www.example.com/de/q"), (10, "http://sub.example.net/enx/"),
        (11, "http://h/" + "a" * 200_000 + "/casino"), (12, "http://h/mycasino"), (12, "http://h/mycasino")]


def brute(url):
    behind = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", behind)[0]
    path = re.match(r"[^?#]*", behind[len(host):])[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in u.SITE_RULES:
        h, _, p = rule.partition("/")
        if (low == h or low.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return low, path, *best
    address = "".join(c.lower() if "A" <= c <= "Z" else c for c in behind)
    return low, path, None, "block" if any(re.search(u.pattern_regex(p), address) for p, _ in u.PATTERN_RULES) else "allow"


def test_matches_trying_every_rule(spark):
    got = u.judge(spark.createDataFrame(ROWS, "page_id int, url string")).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == \
        sorted(map(str, ((i, *brute(x)) for i, x in ROWS)))


def test_only_fetched_rules_run_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "mine", 5)], "page_id int, url string, rule string, index int")
    row = u.judge(df).first()
    assert (row.rule, row["index"], row.n_candidates) == ("net/", 5, 1)


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert u.judge(df).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id int, url string")
    assert u.judge(one, (), ()).first().verdict == "allow"


def test_rule_without_whole_token_is_always_tried(spark):
    assert u.literal_tokens("*asin*", False) == []
    one = spark.createDataFrame([(1, "http://h/mycasino")], "page_id int, url string")
    assert u.judge(one, (), (("*asin*", "block"),)).first().verdict == "block"


def test_tokens_are_in_every_match():
    assert u.literal_tokens("^casino^", False) == ["casino"]
    assert u.literal_tokens("*.exe^", False) == ["exe"]
    assert u.literal_tokens("example.net/en/", True) == ["en", "example", "net"]
    assert u.literal_tokens("example.net/en", True) == ["example", "net"]


def test_plan_is_native(spark):
    plan = u.judge(spark.createDataFrame(ROWS, "page_id int, url string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rules_with_capitals_fire(spark):
    df = spark.createDataFrame([(1, "http://example.com/Docs/x/1"), (2, "http://example.com/docs/x/1"), (3, "http://h.org/free-CASINO/")], "page_id int, url string")
    rows = u.judge(df, [("example.com/Docs/x/", "block")], [("/Free-casino^", "block")]).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "allow", 3: "block"}
