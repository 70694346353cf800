import re

import pytest
from pyspark.sql import functions as F

from normlattice.llm import quality_rules, url_filter

TEXTS = [
    None,
    "",
    " \t\n",
    "one two three",
    "w " * 8,
    "w " * 9,
    "a b c d e f g h x a b c d e f g h y a b c d e f g h",
    "line one here\nline one here\n\n \nother\nline one here",
    "é%% ##$ <b>|</b> & * ünïcode\x0bwords\x0chere\r\nand there " * 7,
    "\u00a0 no-break\u2003space words stay whole " * 12,
    " ".join(f"word{i % 977}" for i in range(60000)),
    " ".join(f"good{i}" for i in range(25)),
]


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    cover = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    bad = len(ws) < 20 or 100 * len(cover) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), bad


def test_counts_match_brute_force(spark):
    rows = [(i, t, "h" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[11], "h"), (11, TEXTS[11], "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as host", "3 as features")
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[11 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept != r.base_failed
    assert quality_rules.judge(docs.limit(0)).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("broadcast", [quality_rules.MAX_BROADCAST_HOSTS, 0])
def test_hosts_with_failing_documents_go(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "MAX_BROADCAST_HOSTS", broadcast)
    good = TEXTS[11]
    rows = [(i, "bad", "spam") for i in range(200)] + [(1000 + i, good, f"h{i % 5}") for i in range(200)] + [(500, good, "spam"), (501, good, None), (502, "bad", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not kept[500] and kept[501] and all(kept[1000 + i] for i in range(200))
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, v in kept.items() if v}
    judged = docs.withColumn("bad", F.col("text") == "bad")
    shrunk = {r.host: r.shrunk for r in quality_rules.host_rates(judged, "source", "bad").collect()}
    assert shrunk["tiny"] < 0.8 < shrunk["spam"]
    rated = {r.doc_id: r.host_rate for r in quality_rules.judge(docs).collect()}
    assert rated[500] == round(shrunk["spam"], 6) and rated[501] is None and rated[502] == round(shrunk["tiny"], 6)


RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow")]
URLS = [
    None,
    "",
    "no scheme",
    "http://A.Example.NET/en/x?y#z",
    "http://example.net/EN/",
    "http://example.net",
    "http://myexample.com/de/x",
    "https://www.Example.com/de/x/",
    "https://b.example.com/p?utm_source=a&b=2&a=1",
    "https://B.example.com:443/p/?a=1&b=2#frag",
    "http://x.org/fr/",
    "http://x.org/fr",
    "x://?q",
    "http://h/a://b/c",
]


def brute_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_and_list(spark, monkeypatch):
    rows = [*enumerate(URLS), (None, URLS[8]), (8, URLS[8])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as key", "3 as block")
    listed = spark.createDataFrame([("http://b.example.com/p?b=2&a=1",), (None,), ("http://b.example.com/p?b=2&a=1",), ("junk",)], "url string")
    for blocks, keys in ((url_filter.MAX_BROADCAST_BLOCKS, url_filter.MAX_BROADCAST), (0, 0)):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_BLOCKS", blocks)
        monkeypatch.setattr(url_filter, "MAX_BROADCAST", keys)
        got = url_filter.judge(pages, listed, RULES).collect()
        assert len(got) == len(rows)
        for r in got:
            k = 8 if r.page_id is None else r.page_id
            host, path, rule, verdict = brute_rule(URLS[k])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if k in (8, 9) else "allow"))
    assert url_filter.judge(pages, listed.limit(0), RULES).filter("rule is null and verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0), listed, []).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    bits = url_filter.bloom(keys, "key", 1024)
    mask = url_filter.mask_of(F.col("key"))
    hit = lambda k: k.withColumn("block", url_filter.block_of(F.col("key"), 1024)).join(bits, "block").filter(F.col("bits").bitwiseAND(mask) == mask).count()
    assert hit(keys) == 3000
    assert hit(spark.range(3000, 6000).selectExpr("concat('k', id) as key")) < 600


def test_native_queries_run_no_python(spark):
    import os

    from normlattice.llm import queries

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    for f in (queries.op4_url_filters, queries.op9_quality_rules, queries.op8_warc_fixity):
        text = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", text)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", queries.op4_url_filters(spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert read and all("html" not in r for r in read)
