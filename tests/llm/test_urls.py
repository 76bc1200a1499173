import random
import re

import duckdb
import pytest

from pyspark.sql import functions as F

from tallyframe.llm import urlrules as U


def test_query_equals_sql(spark):
    from .conftest import SF

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, U.op7_url_rules(spark, SF).collect())) == sorted(con.execute(U.OP7_SQL).fetchall())
    made = ["http://a.org/docs/how/login", "http://a.org/login", "http://a.org/login\n", "http://a.b/ad/x/banner1/y", "http://casino.b.c/x_bonus", "http://A.com/ads/", "http://a.net/ads/", "http://a.org/aff_id=7", "http://a.org/wp-content/a\nb/cache/", "x", None, "http://a.org/é/porn"]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    con.register("made", df.toPandas())
    out = U.judge_urls(df, U.query_rules()).select("page_id", "host", "path", F.when(F.col("rule").isin(*[p for _, p in U.PATTERN_RULES]), None).otherwise(F.col("rule")), "verdict")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(U.OP7_SQL.replace("FROM pages", "FROM made")).fetchall())


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://A.Com/X?q#f", "a.com", "/X", "com/", "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://com/", "com", "/", "com/", "allow"),
        ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://x.example.com/en/", "x.example.com", "/en/", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://b.net/es/3", "b.net", "/es/3", "net/es/", "block"),
        ("http://b.net/de/3", "b.net", "/de/3", None, "allow"),
        ("http://spam-farm.b.net/de/3", "spam-farm.b.net", "/de/3", None, "block"),
        ("x://y://b.org/ads/1", "y:", "//b.org/ads/1", None, "block"),
        ("http://user@b.net:80/fr/", "user@b.net:80", "/fr/", None, "allow"),
        ("http://é.net/fr/\n", "é.net", "/fr/\n", "net/fr/", "block"),
        ("://", "", "", None, "allow"),
    ],
)
def test_cases(url, host, path, rule, verdict):
    rules = U.query_rules()
    index = U.RuleIndex(rules, {})
    assert U.split_url(url) == (host, path)
    best, _ = index.best(host, path)
    name = best.name if best and best.rank[0] else None
    assert (name, best.verdict if best else "allow") == (rule, verdict)
    every = [r for r in rules if __import__("re").match(r.regex, f".{host}{path}"[0 if r.rank[0] == 0 else 1 :], 16)]
    assert best == max(every, key=lambda r: r.rank, default=None)  # the index loses no rule


def test_patterns():
    cases = {
        "^login^": (["http://a.org/login", "http://a.org/x/login?y", "http://a.org/login/", "http://a.org/a_login"], ["http://a.org/login.html", "http://a.org/login-now", "http://login.org/", "http://a.org/mylogin"]),
        "/ad*^banner^": (["http://a.org/ad/x/banner/", "http://a.org/ads_banner"], ["http://a.org/ad/banners", "http://ad.banner.org/"]),
        ".shop*.eu^": (["http://shop.a.eu/", "http://x.shops.eu"], ["http://shop.europe.org/", "http://a.org/shop.eu"]),
        "a*b": (["http://a.org/b"], ["http://b.org/"]),
        "/x^": (["http://a.org/x\n", "http://a.org/x"], ["http://a.org/xy", "http://a.org/x."]),
    }
    for pattern, (fit, unfit) in cases.items():
        index = U.RuleIndex((U.pattern_rule("block", pattern),), {})
        for url in fit + unfit:
            assert (index.best(*U.split_url(url))[0] is not None) == (url in fit), (pattern, url)


def test_random_rules_equal_trying_every_rule(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)] + ["ads", "shop", "x", "en"]
    literal = lambda: rng.choice(words) + rng.choice(["", "-", ".", "/"]) + rng.choice(["", rng.choice(words)])
    patterns = {rng.choice(["", "/", ".", "^", "*"]) + rng.choice(["*", "^", "/", "-"]).join(literal() for _ in range(rng.randint(1, 3))) + rng.choice(["", "/", "^", "*"]) for _ in range(600)}
    rules = tuple(U.pattern_rule(rng.choice(["block", "allow"]), p) for p in sorted(patterns))
    sites = {(rng.choice([".".join(rng.choices(words, k=2)), rng.choice(words)]), rng.choice(["/", "/en/", "/" + rng.choice(words), "/" + rng.choice(words) + "/"])) for _ in range(200)}
    rules += tuple(U.site_rule(rng.choice(["block", "allow"]), h, p) for h, p in sorted(sites))
    urls = ["http://" + ".".join(rng.choices(words, k=rng.randint(1, 3))) + "".join(rng.choice(["/", "-", "_", ".", "/"]) + rng.choice(words) for _ in range(rng.randint(0, 5))) + rng.choice(["", "/", "?q=ads", "/en/", "\n"]) for _ in range(1500)]
    compiled = [(r, re.compile(r.regex, re.S)) for r in rules]
    want = []
    for u in urls:
        host, path = U.split_url(u)
        fit = [r for r, c in compiled if (c.match(f".{host}{path}") if r.rank[0] == 0 else c.match(host + path))]
        best = max(fit, key=lambda r: r.rank, default=None)
        want.append((best.name if best else None, best.verdict if best else "allow"))
    assert len({w[0] for w in want}) > 100
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for block in (200_000, 97):
        got = U.judge_urls(df, rules, block=block).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) for r in got] == want
    assert sum(r.n_regex for r in U.judge_urls(df, rules).collect()) < 0.25 * len(rules) * len(urls)  # most rules never run


def test_every_own_rule_can_fit():
    fits = {"block": ["http://a.org/login", "http://a.org/ads/1", "http://casino.x.org/y/bonus/", "http://a.org/tag/cats/feed", "http://a.org/search/x/sort/"], "allow": ["http://a.org/docs/how/login", "http://a.org/help/redirect/", "http://a.org/reference/x/ads/", "http://a.org/"]}
    index = U.RuleIndex(U.query_rules(), {})
    for verdict, urls in fits.items():
        for u in urls:
            best, _ = index.best(*U.split_url(u))
            assert (best.verdict if best else "allow") == verdict, u


def test_index_runs_few(spark, edge):
    rules = tuple(U.pattern_rule("block", f"/thing{i}/") for i in range(500)) + (U.pattern_rule("block", "a*b"), U.pattern_rule("allow", "^track^"))
    index = U.RuleIndex(rules, {})
    assert index.best("a.org", "/thing7/x")[0].name == "/thing7/" and index.best("a.org", "/thing7/x")[1] <= 2
    assert index.best("a.org", "/x")[0] is None or index.best("a.org", "/x")[0].name == "a*b"
    df = spark.createDataFrame([(1, "http://q.org/thing3/", "h"), (1, "http://q.org/thing3/", "h"), (2, None, None)], "page_id int, url string, host string")
    whole = sorted(map(tuple, U.judge_urls(df, rules).drop("n_regex").collect()))
    assert whole == sorted(map(tuple, U.judge_urls(df, rules, block=100).drop("n_regex").collect()))
    assert [r[-1] for r in whole] == ["block", "block", "allow"]
    assert U.judge_urls(df.limit(0), rules).count() == 0


def test_rarest_token():
    rule = U.site_rule("block", "example.com", "/en/")
    assert set(rule.tokens) == {"example", "com", "en"}
    assert list(U.RuleIndex((rule,), {"example": 9, "com": 50, "en": 3}).by_token) == ["en"]
