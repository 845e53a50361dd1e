import re

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from sonora.llm.url_filter import MAX_RULES, POLICY, Automaton, filter_urls, parts, policy_of


def as_regex(glob: bytes) -> re.Pattern:
    return re.compile(b"".join(b".*" if c == 42 else b"." if c == 63 else re.escape(bytes([c])) for c in glob), re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab*?", max_size=30).map(str.encode), min_size=1, max_size=12), st.lists(st.text("abc", max_size=70).map(str.encode), max_size=8))
def test_automaton_against_regex(globs, subjects):
    hits = Automaton(globs).matches(subjects)
    for s, row in zip(subjects, hits, strict=True):
        assert [bool(x) for x in row] == [bool(as_regex(g).fullmatch(s)) for g in globs]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in POLICY.rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


CASES = [None, "", "nothing", "http://org", "http://org/", "http://a.ORG/x", "http://borg/", "http://example.org/es/1", "http://x.example.org/en/12?q#f", "http://example.org/en/2",
         "https://EXAMPLE.com/fr/", "https://a.com/de/5", "https://a.com?x=/fr/", "https://casino-x.net/a", "ftp://é.net/ü?casino", "a://b://c/d", "http://a.com/de" + "/x" * 5000]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)] + [(None, "http://a.org/")], "page_id long, url string").selectExpr("*", "url as host", "1 as verdict")
    rows = filter_urls(df).collect()
    assert len(rows) == len(CASES) + 1
    for r in rows:
        url = CASES[r.page_id] if r.page_id is not None else "http://a.org/"
        host, path, rule, verdict = brute(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.matched else "allow"))
    assert {r.page_id: r.verdict for r in rows}[13] == "block"
    assert parts("x") == ("", "", "")
    assert filter_urls(df.limit(0)).count() == 0


def test_policy_from_a_table(spark):
    kind = "verdict string, host string, path string, glob string"
    hosts = [("block" if k % 3 else "allow", f"H{k}.example" if k % 2 else f"sub.h{k}.example", f"/p{k % 7}/" if k % 5 else None, None) for k in range(600)]
    globs = [("block", None, None, f"*word{k}x*\0*") for k in range(200)]
    policy = policy_of(spark.createDataFrame([*hosts, *globs, hosts[0]], kind))
    assert len(policy.rules) == 600 and len(policy.block) == 200
    urls = [f"https://a.h{k}.example/p{k % 7}/x" for k in range(0, 600, 7)] + [f"http://sub.h{k}.example/q" for k in range(0, 600, 10)] + [f"http://my-word{k}x.net/" for k in range(0, 260, 13)] + [None, "", "x"]
    found = {r.page_id: r for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), policy).collect()}
    assert len(found) == len(urls)
    for i, url in enumerate(urls):
        host, path, _ = parts(url)
        fits = [r for r in policy.rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        named = [f"*word{k}x*\0*" for k in range(200) if f"word{k}x" in host]
        assert (found[i].rule, sorted(found[i].matched)) == (best and best.name, sorted(named))
        assert found[i].verdict == (best.verdict if best else "block" if named else "allow")
    for bad in (("maybe", "a", None, None), ("allow", None, None, "*"), ("block", None, "/", None), ("block", "a", None, "*")):
        with pytest.raises(ValueError):
            policy_of(spark.createDataFrame([bad], kind))
    with pytest.raises(ValueError):
        policy_of(spark.range(MAX_RULES + 1).selectExpr("'block' as verdict", "string(id) as host", "'/' as path", "string(null) as glob"))
    empty = policy_of(spark.createDataFrame([], kind))
    assert [r.verdict for r in filter_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), empty).collect()] == ["allow"]
