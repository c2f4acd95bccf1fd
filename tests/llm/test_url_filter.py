import math
from collections import defaultdict

import pytest
from macropanel.llm import url_filter as U
from pyspark.sql import functions as F

KIND = "page_id long, url string, host string, n long, batch long, html string"


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, "h", 1, 2, "<p>") for i, u in rows], KIND).repartition(parts)


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    fits = [(r, v) for v, r in U.RULES if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict


def model(urls, order=5):
    """Probability of a byte after a context, with all shorter contexts blended in."""
    count = defaultdict(lambda: defaultdict(int))
    for u in urls:
        b = bytes(order) + u.encode() + b"\0"
        for i in range(order, len(b)):
            for k in range(order + 1):
                count[b[i - k : i]][b[i]] += 1

    def p(context, c):
        shorter = p(context[1:], c) if context else 1 / 256
        seen = count.get(context)
        if not seen:
            return shorter
        return (seen.get(c, 0) + len(seen) * shorter) / (sum(seen.values()) + len(seen))

    return p


def score(url, accepted, rejected, order=5):
    b = bytes(order) + url.encode() + b"\0"
    parts = [math.log(accepted(b[i - order : i], b[i])) - math.log(rejected(b[i - order : i], b[i])) for i in range(order, len(b))]
    return sum(parts) / len(parts)


URLS = [
    "http://a.org/x", "https://EXAMPLE.org/es/1", "http://example.org/en/12", "http://www.example.org/en/2", "http://b.com/fr/7?q=/de/", "http://b.com/de/9#x", "http://borg/x",
    "ftp://x.net:80/de/ünï", "http://x.net", "http://org/", "http://org", "http://a.org?x/y", "no scheme", "", None, "://", "a://b://c/d", "http://y.net/a\nb", "http://b.com/de/9#x", "http://Ä.ORG/",
    *(f"http://shop{i}.com/de/pills-{i}" for i in range(8)), *(f"http://lib{i}.org/docs/{i}" for i in range(8)), "http://z.net/docs/3", "http://z.net/de/pills-77",
]


def test_hosts_paths_rules_and_scores(spark):
    rows = [*enumerate(URLS), (3, "http://w.net/docs/1"), (None, "http://w.net/docs/2"), (99, "http://long.net/" + "ab/" * 400_000)]
    got = U.judge_urls(pages(spark, rows))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    got = got.collect()
    accepted = model(u for _, u in rows if by_hand(u)[3] == "allow")
    rejected = model(u for _, u in rows if by_hand(u)[3] == "block")
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((i, *by_hand(u)[:3]) for i, u in rows), key=str)
    by_id = {r.page_id: r for r in got if r.page_id not in (3, None)}
    for i, u in rows:
        if i in by_id and i != 99:
            assert abs(by_id[i].score - score(u or "", accepted, rejected)) < 1e-5
            assert by_hand(u)[3] in (None, by_id[i].verdict)
    assert by_id[URLS.index("http://z.net/docs/3")].verdict == "allow" and by_id[URLS.index("http://z.net/de/pills-77")].verdict == "block"


def test_threshold_has_the_least_balanced_error(spark):
    rows = [(b, True) for b in (-3, 1, 2, 5, 5, 9)] + [(b, False) for b in (-8, -5, -1, 0, 2)]
    t = U.threshold(spark.createDataFrame(rows, "bin int, accepted boolean"))

    def wrong(t):
        return sum(a and b < t for b, a in rows) / 6 + sum(not a and b >= t for b, a in rows) / 5

    assert t == 1 and wrong(t) == min(map(wrong, range(-10, 11)))
    assert U.threshold(spark.createDataFrame(rows[:3], "bin int, accepted boolean")) is None


@pytest.mark.parametrize("urls", [[], [(1, None)], [(1, "http://a.net/x"), (2, "http://b.org/")]])
def test_nothing_to_learn_from(spark, urls):
    got = U.judge_urls(pages(spark, urls)).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(i, "allow") for i, _ in urls]


def test_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(U, "BATCH", 50)
    rows = pages(spark, [(i, f"http://a.net/{i}") for i in range(1000)], 4).select("page_id", "url")
    sizes = [r["count"] for r in U._batched(rows).groupBy("batch").agg(F.count("*").alias("count")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= U.BATCH
