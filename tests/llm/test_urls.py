import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from critiq.llm import url_rules as U
from critiq.llm.url_rules import LONGEST, host, judge_urls, mined_rules, path, url_tokens

NO_LABELS = "url string, label string"


def pages(spark, urls):
    rows = [(i, u, "r", "v", "t") for i, u in enumerate(urls)]
    return spark.createDataFrame(
        rows, "page_id long, url string, rule string, verdict string, tokens string"
    )


@pytest.mark.parametrize(
    "url, want_host, want_path, rule, verdict",
    [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("no scheme/net/", "", "", None, "allow"),
        ("http://Example.NET/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.b.example.net/en", "a.b.example.net", "/en", "net/", "block"),
        ("http://other.net", "other.net", "", None, "allow"),
        ("http://other.net/?q", "other.net", "/", "net/", "block"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("http://example.com/de/1#f", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://example.com/DE/1", "example.com", "/DE/1", None, "allow"),
        ("x://org/fr/", "org", "/fr/", "org/fr/", "allow"),
        ("http://x.org#/fr/", "x.org", "", None, "allow"),
        ("http://a://b.net/", "a:", "//b.net/", None, "allow"),
        ("://net/\n?x", "net", "/\n", "net/", "block"),
        ("http://ÄB.net/é", "Äb.net", "/é", "net/", "block"),
    ],
)
def test_parts_and_fixed_rules(spark, url, want_host, want_path, rule, verdict):
    row = judge_urls(pages(spark, [url]), spark.createDataFrame([], NO_LABELS)).collect()[0]
    assert (row.host, row.path, row.rule, row.verdict) == (want_host, want_path, rule, verdict)


def test_mined_rules_block_token_combinations(spark):
    urls, labels = [], []
    for i in range(60):
        urls += [f"http://www.bets-{i}.example.com/en/{i}", f"http://www.news.example.com/en/{i}",
                 f"http://bets.example.org/help/{i}.html"]
        labels += ["block", "allow", "allow"]
    marked = spark.createDataFrame(list(zip(urls, labels)), NO_LABELS)
    asked = [*urls, "http://www.bets-777.example.com/en/9", "http://www.news.example.com/en/77",
             "http://www.bets-1.example.net/en/9", None]
    rows = judge_urls(pages(spark, asked + asked), marked).collect()
    got = {r.page_id: r.verdict for r in rows}
    assert len(rows) == 2 * len(asked)
    assert [got[i] for i in range(180)] == labels
    assert [got[i] for i in range(180, 184)] == ["block", "allow", "allow", "allow"]
    text = judge_urls(pages(spark, asked), marked)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_rules_are_pruned_by_support(spark):
    rows = [(["a", "b"], "block")] * 4 + [(["c"], "allow")] * 20
    marked = spark.createDataFrame(rows, "tokens array<string>, label string")
    assert {tuple(r.antecedent) for r in mined_rules(marked).collect()} == {("c",)}
    assert mined_rules(marked.filter("false")).count() == 0


def test_many_query_keys_are_mined_soon(spark):
    """Every second URL with many keys is bad, so that no key is decided."""
    keys = "&".join(f"k{i:02}=1" for i in range(30))
    urls = [f"http://news.example.com/en/{i}" for i in range(500)]
    urls += [f"http://shop{'s' * (i % 2)}.example.com/a?{keys}" for i in range(20)]
    labels = ["allow"] * 500 + ["block", "allow"] * 10
    marked = spark.createDataFrame(list(zip(urls, labels)), NO_LABELS)
    tokens = marked.select(url_tokens(F.col("url")).alias("tokens"), "label")
    rules = mined_rules(tokens).collect()
    assert len(rules) < 1000 and max(len(r.antecedent) for r in rules) <= LONGEST
    asked = [f"http://shop.example.com/b?{keys}", f"http://shops.example.com/b?{keys}",
             f"http://other.example.com/b?{keys}"]
    got = {r.page_id: r.verdict for r in judge_urls(pages(spark, asked), marked).collect()}
    assert [got[i] for i in range(3)] == ["block", "allow", "allow"]


def test_combinations_block_where_their_parts_do_not(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        part = [t for t in "abcd" if rng.random() < 0.5] + ["z"]
        rows.append((part, "block" if {"a", "b"} <= set(part) else "allow"))
    marked = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = {(tuple(r.antecedent), r.consequent): (r.confidence, r.support)
             for r in mined_rules(marked).collect()}
    assert rules[("a", "b"), "block"][0] == 1.0
    whole = [r for r in rows if {"a", "b", "c"} <= set(r[0])]
    assert rules[("a", "b", "c"), "block"] == (1.0, len(whole) / 400)
    one = [r for r in rows if "a" in r[0]]
    share = sum(r[1] == "block" for r in one) / len(one)
    kept = rules.get((("a",), "block"))
    assert kept is None if share < 0.5 else kept[0] == pytest.approx(share)
    assert all("z" not in a for a, _ in rules if len(a) > 1)


def brute_force(rows, sets):
    """Verdicts by every combination of each URL's rarest undecided tokens."""
    from itertools import combinations
    from math import sqrt

    count = len(rows)
    whole, freq = Counter(), Counter()
    for tokens, label in rows:
        for t in tokens:
            whole[t] += 1
            freq[t, label] += 1
    told = {t for t in whole if max(freq[t, "block"], freq[t, "allow"]) == whole[t]}
    several, marked = Counter(), Counter()
    for tokens, label in rows:
        left = sorted((whole[t], t) for t in tokens
                      if whole[t] >= 5 and t not in told and whole[t] < count)[:LONGEST]
        for size in range(2, len(left) + 1):
            for part in combinations(sorted(t for _, t in left), size):
                several[part] += 1
                marked[part, label] += 1
    every = {((t,), v): (freq[t, v], whole[t]) for t, v in freq}
    every |= {(p, v): (marked[p, v], several[p]) for p, v in marked}
    rules, z = {}, 1.645
    for (part, label), (f, w) in every.items():
        share = f / w
        low = (share + z * z / (2 * w) - z * sqrt(share * (1 - share) / w + z * z / (4 * w * w)))
        if f >= 5 and share >= 0.5 and (f >= 0.01 * count or low / (1 + z * z / w) >= 0.5):
            rules[part, label] = share
    found = {}
    for tokens in sets:
        best = {"block": 0.0, "allow": 0.0}
        for (part, label), share in rules.items():
            if set(part) <= set(tokens):
                best[label] = max(best[label], share)
        if max(best.values()):
            found[tokens] = "block" if best["block"] > best["allow"] else "allow"
    return found


@pytest.mark.parametrize("share", [1e-9, 1.0])
def test_verdicts_equal_every_combination(spark, monkeypatch, share):
    """Once all tokens are looked up in salted parts, and once none."""
    monkeypatch.setattr(U, "HOT_SHARE", share)
    rng = random.Random(6)
    names = [f"t{i}" for i in range(14)]
    rows = []
    for _ in range(300):
        tokens = sorted(t for t in names if rng.random() < 0.35) or ["t0"]
        bad = {"t1", "t2"} <= set(tokens) or "t9" in tokens and rng.random() < 0.7
        rows.append((tokens, "block" if bad else "allow"))
    marked = spark.createDataFrame(rows, "tokens array<string>, label string")
    sets = {tuple(r[0]) for r in rows} | {("t1", "t2"), ("t1",), ("new",)}
    asked = spark.createDataFrame([(list(t),) for t in sets], "tokens array<string>")
    got = U.rule_verdicts(asked, mined_rules(marked)).collect()
    assert {tuple(r.tokens): r.mined for r in got} == brute_force(rows, sets)


def test_small_certain_hosts_keep_their_rules_at_any_size(spark):
    """Seven of 3,000 labelled URLs, all marked; five of six aren't sure enough."""
    urls = [f"http://news.example.com/en/{i}" for i in range(3000)]
    urls += [f"http://spam-farm.example.com/en/{i}" for i in range(7)]
    urls += [f"http://doubt.example.com/en/{i}" for i in range(6)]
    labels = ["allow"] * 3000 + ["block"] * 12 + ["allow"]
    marked = spark.createDataFrame(list(zip(urls, labels)), NO_LABELS)
    asked = [f"http://{h}.example.com/en/9999" for h in ("spam-farm", "news", "doubt", "other")]
    got = {r.page_id: r.verdict for r in judge_urls(pages(spark, asked), marked).collect()}
    assert [got[i] for i in range(4)] == ["block", "allow", "allow", "allow"]


def test_empty_tables_and_tokens(spark):
    none = spark.createDataFrame([], NO_LABELS)
    assert judge_urls(pages(spark, []), none).count() == 0
    df = spark.createDataFrame([("HTTP://A-1.b.com/x/22.html?k=1&k=2&z#f",), (None,), ("x",)],
                               "url string")
    got = [r[0] for r in df.select(url_tokens(F.col("url"))).collect()]
    assert got == [sorted(["scheme:http", "label:a-0", "label:b", "label:com", "part:a", "part:0",
                           "part:b", "part:com", "path:x", "path:0", "ending:html", "key:k",
                           "key:z"]), [], []]
    assert df.select(host(F.col("url")), path(F.col("url"))).count() == 3


def test_combinations_beyond_the_rarest_tokens_count(spark):
    """Nine undecided tokens of every URL are rarer than the pair that decides."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        part = [t for t in ("often0", "often1") if rng.random() < 0.7]
        label = "block" if len(part) == 2 else "allow"
        part += [f"rare{i % 4}k{j}" for j in range(9)]
        rows.append((sorted(part), label))
    marked = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = {(tuple(r.antecedent), r.consequent): r.confidence
             for r in mined_rules(marked).collect()}
    assert rules[("often0", "often1"), "block"] == 1.0
    asked = [("often0", "often1"), ("often0", "often1", "rare1k3"), ("new",)]
    sets = spark.createDataFrame([(list(t),) for t in asked], "tokens array<string>")
    got = {tuple(r.tokens): r.mined for r in U.rule_verdicts(sets, mined_rules(marked)).collect()}
    assert [got.get(t, "allow") for t in asked] == ["block", "block", "allow"]


def test_rare_combinations_count_among_many_urls(spark):
    """Five URLs of 600,015, less than a share of 1e-5."""
    few = [(["x", "y"], "block"), (["v", "x"], "allow"), (["v", "y"], "allow")] * 5
    many = spark.range(600_000).select(F.array(F.lit("z")).alias("tokens"),
                                       F.lit("allow").alias("label"))
    marked = many.unionByName(spark.createDataFrame(few, many.schema))
    rules = {(tuple(r.antecedent), r.consequent) for r in mined_rules(marked).collect()}
    assert (("x", "y"), "block") in rules
