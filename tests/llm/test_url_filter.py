"""Rules by hand, and the character models on URLs whose class is plain."""

import math
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from stratakv.llm import urlfilter
from stratakv.llm.urlfilter import RULES

URLS = {
    "http://a.example.com/en/1": ("a.example.com", "/en/1", "com/en/", "block"),
    "HTTP://A.EXAMPLE.COM/en/71?x=1": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
    "https://example.com/en/7#f": ("example.com", "/en/7", "example.com/en/7", "allow"),
    "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "ftp://x.net/de/": ("x.net", "/de/", "net/de/", "block"),
    "ftp://www.example.net/de/8/z": ("www.example.net", "/de/8/z", "example.net/de/8", "allow"),
    "http://x.org/EN/": ("x.org", "/EN/", None, "allow"),
    "http://x.org": ("x.org", "", None, "allow"),
    "http://x.org?q=/en/": ("x.org", "", None, "allow"),
    "http://com/en/": ("com", "/en/", "com/en/", "block"),
    "x.com/en/1": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    None: ("", "", None, "allow"),
}


def judged(df, rules=RULES, **kw):
    return {r["page_id"]: r for r in urlfilter.filter_urls(df, rules, **kw).collect()}


def test_rules(spark):
    rows = list(enumerate(URLS))
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("cls", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = judged(df)
    for i, url in rows:
        host, path, rule, verdict = URLS[url]
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        if rule is not None or not host:
            assert r["verdict"] == verdict, url


def test_many_rules_and_long_urls(spark):
    """Thousands of random rules against a loop over all of them; hosts and paths of a million characters."""
    rng = random.Random(4)
    labels = ["a", "b", "cc", "d.e", "x"]
    rules = [(rng.choice(["block", "allow"]), ".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(["", "/"]) + "/".join(rng.choices("pqrs", k=rng.randint(0, 5)))) for _ in range(3000)]
    urls = [f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 6)))}/{'/'.join(rng.choices('pqrs', k=rng.randint(0, 7)))}" for _ in range(400)]
    urls += ["http://" + "a." * 500_000 + "cc/p/q", "http://cc/p" + "/q" * 500_000, "http://" + "x" * 1_000_000, "http://a..cc/p", "http://.a/", "http:///p"]
    df = spark.createDataFrame(list(enumerate(urls)), "at long, url string")
    host, path = urlfilter.split_url(F.col("url"))
    split = df.select("at", host.alias("host"), path.alias("path"))
    got = {r["at"]: (r["rule"], r["said"]) for r in urlfilter.match_rules(split, rules).collect()}
    for r in split.collect():
        fits = [(-len(h + p), v != "block", h, p, v) for v, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p) and r["host"]]
        want = min(fits, default=None)
        assert got.get(r["at"]) == (want and (want[2] + want[3], want[4])), (r["host"][:50], r["path"][:50])


def test_equally_long_rules_block(spark):
    df = spark.createDataFrame([(1, "http://ab.c/d")], "page_id long, url string")
    assert judged(df, [("allow", "ab.c", "/d"), ("block", "ab.c", "/d")])[1]["verdict"] == "block"


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert judged(df.limit(0)) == {}
    assert {r["verdict"] for r in urlfilter.filter_urls(df, []).collect()} == {"allow"}


def test_models_tell_urls_like_blocked_ones(spark):
    """casino URLs of blocked hosts teach the model; casino URLs elsewhere are blocked, others are not."""
    rng = random.Random(1)
    good = ["news", "garden", "music", "history", "recipes", "science", "travel"]
    bad = ["casino", "bets", "poker", "jackpot", "slots"]
    rows = []
    for i in range(1500):
        rows.append((i, f"http://{rng.choice(good)}{rng.randrange(50)}.org/{rng.choice(good)}/{rng.randrange(999)}"))
        rows.append((10_000 + i, f"http://{rng.choice(bad)}{rng.randrange(50)}.bad/{rng.choice(bad)}-{rng.choice(bad)}/{rng.randrange(999)}"))
    new = [(20_000 + i, f"http://{rng.choice(bad)}{rng.randrange(50)}.bad.io/{rng.choice(bad)}-{rng.choice(bad)}/{rng.randrange(999)}") for i in range(5)]
    got = judged(spark.createDataFrame(rows + new, "page_id long, url string"), [("block", "bad", "/")])
    assert all(got[i]["verdict"] == "block" and got[i]["rule"] is None for i, _ in new)
    plain = [got[i]["verdict"] for i in range(1500)]
    assert plain.count("block") <= 0.03 * len(plain)


def test_the_query_covers_all_pages(spark, sf):
    from stratakv.llm.queries import QUERIES

    got = QUERIES["op6_url_character_models"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    assert all((r["by"] == "rule") == (r["rule"] is not None) for r in got)


@pytest.mark.parametrize("hot", [0, 1000, urlfilter.HOT])
def test_scores_count_the_ngrams_themselves(spark, hot):
    """Random URLs, some 300 000 distinct n-grams: the scores of plain dictionaries of counts."""
    rng = random.Random(2)
    urls = [f"http://{rng.choice(['a.bad', 'b.org'])}/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789é", k=60)) for _ in range(2000)]
    rows = list(enumerate([*urls, urls[0], "no scheme", "", None]))
    got = judged(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad", "/")], hot=hot)

    def windows(url):
        padded = [-1] * 4 + list(url.encode())
        return [tuple(padded[i - 4 : i + 1]) for i in range(4, len(padded))]

    full, context = (Counter(), Counter()), (Counter(), Counter())
    for url in [*urls, urls[0]]:
        if crc32(url.encode()) % 5:
            cls = int(url.startswith("http://a.bad/"))
            for w in windows(url):
                full[cls].update(w[4 - n :] for n in range(5))
                context[cls].update((n, w[4 - n : 4]) for n in range(5))
    for i, url in rows:
        want = 0.0
        for w in windows(url or ""):
            for cls in (0, 1):
                p = 1 / 256
                for n in range(5):
                    p = (full[cls][w[4 - n :]] + 2 * p) / (context[cls][n, w[4 - n : 4]] + 2)
                want += math.log(p) if cls else -math.log(p)
        assert got[i]["score"] == pytest.approx(want / max(1, len((url or "").encode())), abs=1e-6), (i, url)


def test_the_query_follows_the_contracts_list(spark, tmp_path):
    """Each rule's own word, and that of the longest rule where two fit; written out, not read from the code."""
    from stratakv.llm.queries import QUERIES

    want = {
        "http://com/en/": ("com/en/", "block"),
        "http://a.example.com/en/6": ("com/en/", "block"),
        "http://a.example.com/en/7": ("example.com/en/7", "allow"),
        "http://x.net/de/": ("net/de/", "allow"),
        "http://notexample.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"),
        "HTTP://WWW.EXAMPLE.NET/de/81?x=1": ("example.net/de/8", "block"),
        "http://x.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in QUERIES["op6_url_character_models"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))
