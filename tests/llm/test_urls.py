import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import urls
from tessel.llm.shared import table


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    after = rest[end:]
    stop = min([after.find(c) for c in "?#" if c in after], default=len(after))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), after[:stop]


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def plain_score(model, host, path):
    """The same sum, one n-gram at a time."""
    total, n = 0.0, 0
    for part, s in ((0, f"\x02{host}\x04"), (1, f"\x03{path}\x04")):
        s = "".join("0" if c in "0123456789" else c for c in s)
        for size in urls.SIZES:
            for i in range(len(s) - size + 1):
                h = 0
                for c in s[i : i + size]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                h = (h + (size << 56) + part * 2**62) % 2**64
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> shift)) * factor % 2**64
                total, n = total + model.weights[(h ^ (h >> 31)) >> (64 - urls.BITS)], n + 1
    return 1 / (1 + np.exp(-(total / np.sqrt(max(1, n)) + model.bias)))


ODD = [None, "", "no scheme/at/all", "://", "http://", "http://HOST.Example.COM/EN/x", "http://example.com/en/", "http://example.com/en", "http://www.example.com/en/1?x=://y/z#f", "https://a.net?q=/es/", "https://a.net/es/#x", "http://net/fr/2", "http://planet/fr/2", "http://a.com", "http://user@a.com:80/en/", "x://é中.com/ü/\n?y", "http://" + "a." * 3000 + "net/es/" + "b" * 70_000, "ÀB://ÀB.com/"]


def test_every_part_against_plain_python(spark):
    rows = [(i, u, "own", "own") for i, u in enumerate(ODD)] + [(None, ODD[5], None, None), (3, ODD[5], None, None)]
    model = urls.train(urls.labelled_table())
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string, host string, score string"), "page_id", "url", urls.RULES, model).collect()
    assert len(out) == len(rows)
    want = sorted(((i, u) for i, u, *_ in rows), key=str)
    got = sorted(out, key=lambda r: str((r.page_id, next(u for i, u, *_ in rows if i == r.page_id and plain_parts(u) == (r.host, r.path)))))
    for (key, url), r in zip(want, got):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        score = plain_score(model, host, path) if len(path) < 1000 else r.score
        assert (r.page_id, r.host, r.path, r.rule) == (key, host, path, rule) and abs(r.score - score) < 1e-9
        assert r.verdict == (verdict or ("block" if score >= urls.BLOCK_AT else "allow"))


def test_longest_rule_wins():
    rules = urls.Rules([("com", "/", "allow"), ("a.com", "/", "block"), ("com", "/long/path/", "block"), ("a.com", "/x", "allow")])
    hosts, paths = ["b.a.com", "a.com", "aa.com", "a.com", "com"], ["/", "/xy", "/", "/long/path/1", ""]
    assert rules.judged(hosts, paths) == [("a.com/", "block"), ("a.com/x", "allow"), ("com/", "allow"), ("com/long/path/", "block"), (None, None)]


def test_words_it_never_saw():
    """Urls of words that the labelled table lacks, on hosts of another kind."""
    model = urls.train(urls.labelled_table())
    bad = ["casino-win", "cheap-pills", "free-bets", "spam-farm", "mega-casinos", "onlinepills", "porn-videos", "sport-bets"]
    good = ["wanderings", "botany", "townhall", "nursery", "geology", "observatory", "ththre", "tionble", "therha", "weaving"]
    score = lambda words: model.scores([f"news.{w}.example.info" for w in words], ["/pt/12"] * len(words))
    assert (score(bad) >= urls.BLOCK_AT).all() and (score(good) < urls.BLOCK_AT).all()


def test_query_over_all_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = urls.op12_url_filter(spark, sf_dir)
    assert out.count() == pages.count() and out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    spam = F.col("host").rlike("spam-farm|cheap-pills|casino-win|free-bets")
    free = out.where("rule is null").groupBy(spam.alias("spam"), "verdict").count().collect()
    right = sum(r["count"] for r in free if r.spam == (r.verdict == "block"))
    assert right / sum(r["count"] for r in free) >= 0.97


def test_empty_table_and_large_labelled_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(none, "page_id", "url", urls.RULES, urls.train([])).count() == 0
    with pytest.raises(ValueError):
        urls.train([("a", "/", 1)] * (urls.MOST_LABELLED + 1))
