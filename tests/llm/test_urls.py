import numpy as np
from pyspark.sql import functions as F

from cellgauge.llm.urls import host_reputations, judge_urls, registered, share_above

PAGES = "page_id long, url string, host string, verdict string, n int, mean string, domain string"
URLS = [
    (1, "http://A.Example.net/en/x"), (2, "https://example.net/fr"), (3, "http://example.com/de/1?q"), (4, "http://x.org/fr/"), (5, "http://x.org/frx"), (6, None), (7, "no scheme"), (8, "://"),
    (9, "http://h.net"), (10, "a://b://net/x"), (11, "http://notexample.com/de/"), (11, "http://notexample.com/de/"), (None, "http://x.com/\nb#c"), (12, "http://É.NET/?/x"),
]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "h", "v", 1, "m", "d") for i, u in URLS], PAGES)
    none = spark.createDataFrame([], "page_id long, bad int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame, none).collect()), key=str)
    assert got == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/fr", "net/", "block"), (3, "example.com", "/de/1", "example.com/de/", "block"), (4, "x.org", "/fr/", "org/fr/", "allow"),
        (5, "x.org", "/frx", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "h.net", "", None, "allow"), (10, "b:", "//net/x", None, "allow"),
        (11, "notexample.com", "/de/", None, "allow"), (11, "notexample.com", "/de/", None, "allow"), (None, "x.com", "/\nb", None, "allow"), (12, "É.net", "/", "net/", "block"),
    ], key=str)
    assert judge_urls(frame.limit(0), none).count() == 0


def test_reputations_shrink(spark):
    pages, bad = [], []
    for i in range(3000):
        host = ("good", "bad", "rare")[0 if i < 2000 else 1 if i < 2990 else 2] + f"{i % 5 if i < 2000 else 0}.{'spam' if 2000 <= i else 'fine'}.com"
        pages.append((i, f"http://{host}/p"))
        if i % 2 and host[:4] != "rare":
            bad.append((i, int(host.startswith("bad") and i % 20 > 1)))
    pages.append((5000, "http://new.fine.com/"))
    frame, told = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*bad, (None, 1), (3, None)], "page_id long, bad int")
    got = {r.host: r for r in host_reputations(frame, told).collect()}
    assert got["bad0.spam.com"].bad_rate > 0.85 and got["good0.fine.com"].bad_rate < 0.02
    assert got["rare0.spam.com"].n == 0 and got["rare0.spam.com"].bad_rate > 0.5 > got["new.fine.com"].bad_rate  # by their domains
    assert got["rare0.spam.com"].bad_a + got["rare0.spam.com"].bad_b < got["bad0.spam.com"].bad_a + got["bad0.spam.com"].bad_b
    verdicts = {r.host: r.verdict for r in judge_urls(frame, told, rules=()).collect()}
    assert verdicts["bad0.spam.com"] == "block" and verdicts["good3.fine.com"] == verdicts["new.fine.com"] == "allow"


def test_registered_domains(spark):
    cases = {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "www.x.co.uk": ("x.co.uk", "co.uk"), "x.co.uk": ("x.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"), "a.co.info": ("co.info", "info"), "a.x.de": ("x.de", "de"), "u:p@w.x.com.au:80": ("x.com.au", "com.au"), "x.org.": ("x.org", "org"), "10.1.2.3:8080": ("10.1.2.3", ""),
    }
    got = spark.createDataFrame([(h,) for h in cases], "host string").select("host", *registered(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases


def test_share_above_equals_a_fine_sum(spark):
    cases = [(a, b) for a in (0.01, 0.4, 1.0, 7.5, 300.0, 2e5) for b in (0.01, 0.4, 1.0, 7.5, 310.0, 2e5)]

    def plain(a, b, limit):
        odds = np.linspace(-3000, 3000, 6_000_001) if min(a, b) < 1 else np.linspace(-30, 30, 6_000_001)
        height = a * odds - (a + b) * np.logaddexp(0, odds)
        mass = np.exp(height - height.max())
        return mass[odds > np.log(limit / (1 - limit))].sum() / mass.sum()

    frame = spark.createDataFrame(cases, "a double, b double")
    for limit in (0.5, 0.2):
        got = frame.select("a", "b", share_above(F.col("a"), F.col("b"), limit).alias("p")).collect()
        assert max(abs(r.p - plain(r.a, r.b, limit)) for r in got) < 0.002
