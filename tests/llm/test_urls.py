import re

from pyspark.sql import functions as F

from panelyard.llm import urls as U
from panelyard.llm.queries import RULES

CASES = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/Page?x=/es/#y", "http://example.com", "http://example.com?q=://z", "http://Sub.Example.com/en/1",
    "http://a.www.example.com/en/2", "https://x.net/es/1", "https://x.net/fr", "https://x.net/fr/", "ftp://net/es/", "http://notnet/es/", "http://xexample.com/en/", "http://ÄÖ.com/é#f",
    "http://h.org/a://b/c", "http://h.org\n/x", "http://" + "a" * 5000 + ".com/" + "b/" * 20000, "http://spam-farm.example.org/en/5", "http://www.example.com/en/", "http://www.example.com/de",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, name, start in RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and len(name + start) > len(best[0] or ""):
            best = (name + start, verdict)
    return host, path, *best


def pages(spark, urls):
    return spark.createDataFrame([(k, u, None, "h", 0.5) for k, u in enumerate(urls)], "page_id long, url string, html string, host string, score double")


def test_hosts_paths_and_rules_equal_brute_force(spark):
    got = U.judge(pages(spark, CASES), RULES, U.fit(U.labelled_urls(spark))).collect()
    for r in got:
        host, path, rule, verdict = brute(CASES[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert len(got) == len(CASES)


def test_classifier_generalises_from_the_small_table(spark):
    unseen = ["https://spam-farm.example.org/en/77", "http://my-spam-farm.example.net/de/1", "http://casino-bonus.example.org/win", "https://wiki.example.com/wiki/Rivers", "https://m.ththor.example.org/de/61", "https://docs.example.net/guide/install.html"]
    got = U.judge(pages(spark, unseen), (), U.fit(U.labelled_urls(spark))).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block"] * 3 + ["allow"] * 3


def test_ngrams_are_all_windows_of_host_and_path(spark):
    row = spark.range(1).select(U.char_ngrams(F.lit("ab.c"), F.lit("/é")).alias("g")).first().g
    host = ".ab.c."
    want = ["h" + host[i : i + n] for n in U.SIZES for i in range(len(host) - n + 1)] + ["p/é"] * 3
    assert row == want


def test_no_pages(spark):
    assert U.judge(pages(spark, []), RULES, U.fit(U.labelled_urls(spark))).count() == 0
