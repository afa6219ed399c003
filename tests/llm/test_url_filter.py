import random

import helpers as h
import numpy as np
import pytest
from vecreduce.llm import url_filter as op

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.b", "", "block"), ("b", "/xx", "allow"), ("dup.io", "/", "allow"), ("dup.io", "/", "block"), (None, "/", "block"),
         ("x.io", None, "block"), ("", "", "block"), ("odd.io", "/", "other")]


def brute(url, rules, default="allow"):
    host, path = op.split_url(url)
    fit = [(len(r) + len(p), len(r), r + p, v) for r, p, v in
           ((h.ascii_lower(r), p or "", v) for r, p, v in rules if r is not None and v in ("allow", "block"))
           if (host == r or host.endswith("." + r)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, *(best[2:] if best else (None, default)))


URLS = [None, "", "no scheme.net/", "http://x.NET/a", "http://net", "http://net/", "https://m.example.net/en/1?q=net/#f",
        "http://notexample.net/en/", "ftp://example.com/de/x", "http://example.com/DE/x", "http://a.org/fr/", "http://q.a.b",
        "http://a.b/xx", "http://dup.io/", "http://x.io?y", "://", "http:///p", "http://net.:80/", "http://u@é.net/é\n/x",
        "a://b://c.net/", "http://odd.io/"]


@pytest.mark.parametrize("most_bytes", [op.MOST_BYTES, 0])
def test_verdicts_equal_brute_force_by_file_and_by_join(spark, most_bytes):
    rng = random.Random(2)
    urls = URLS + [f"http://{'.'.join(rng.choice(['a', 'b', 'net', 'example', 'org', 'io', 'x']) for _ in range(3))}"
                   f"/{rng.choice(['en/', 'fr/', 'xx', 'de/1', ''])}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.id: tuple(r)[1:] for r in op.verdicts(h.with_clashing_columns(df), rules, most_bytes=most_bytes).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_colliding_keys_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(op, "_key", lambda host, path: 5 if host.endswith(("b", "net")) else 9)
    (tmp_path / "rules").write_bytes(op.packed([("a.b", "/", "block"), ("net", "/", "allow"), ("b", "/", "allow")]))
    rules = op.Rules(str(tmp_path / "rules"))
    assert isinstance(rules.strings, np.memmap)
    assert rules([("a.b", "/"), ("c.b", "/x"), ("net", "/"), ("zb", "/"), ("q", "/")]) == [
        ("a.b/", "block"), ("b/", "allow"), ("net/", "allow"), None, None]


def test_no_rules_no_rows(spark):
    df = spark.createDataFrame([(1, "http://net/"), (None, None), (1, "http://net/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    for most in (op.MOST_BYTES, -1):
        assert sorted(h.rows(op.verdicts(df, none, default="block", most_bytes=most)), key=str) == sorted(
            [(None, "", "", None, "block")] + 2 * [(1, "net", "/", None, "block")], key=str)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert op.verdicts(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("most_bytes", [op.MOST_BYTES, 0])
def test_hosts_of_very_many_labels(spark, most_bytes):
    import time
    urls = ["http://" + "a." * 100_000 + "example.com/de/x", "http://" + "." * 100_000, "http://net/" + "/" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    start = time.perf_counter()
    got = {r.id: tuple(r)[1:] for r in op.verdicts(df, rules, most_bytes=most_bytes).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)} and time.perf_counter() - start < 30
