"""URL filters against trying every rule on every address (the query itself has DuckDB SQL)."""

import random
import re

import pytest

from tessera.llm import urlfilter as U

SCHEMA = "page_id long, url string, host int, tried string, own string, u string"


def low(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = low(re.match("[^/?#]*", rest).group())
    return host, re.match("[^/?#]*([^?#]*)", rest).group(1), low(rest)


def plain(url, sites, patterns):
    """(host, path, rule, pattern, verdict) by the rules' plain meaning, without an index."""
    host, path, address = split(url)
    fit = []
    for text, verdict in sites:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and (path.startswith("/" + p) if slash else path[:1] in ("", "/") and address[len(host):len(host) + 1] in ("", "/", "?", "#")):
            fit.append((1, len(text), verdict, text))
    for text, verdict in patterns:
        t = low(text)
        start = "^(?:[^/?#]*[.])?" if t.startswith("||") else "^" if t.startswith("|") else ""
        end = r"\Z" if t.endswith("|") else ""
        body = t.lstrip("|").removesuffix("|") if end else t.lstrip("|")
        regex = start + "".join({"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body) + end
        if re.search(regex, address):
            fit.append((0, verdict == "allow", verdict, text))
    if not fit:
        return host, path, None, None, "allow"
    site, _, verdict, text = max(fit)
    return host, path, text if site else None, None if site else text, verdict


def urls(seed, n=400):
    rnd = random.Random(seed)
    parts = ["ads", "www", "m", "example", "login", "help", "en", "EN", "cart", "x", "xxx", "a_b", "ü", "casino-1", "wp-admin", "0", "net", "org", "com", ""]
    out = [None, "", "no scheme/net/", "://", "http://", "http://net", "http://net/", "http://NET/", "http://a.b.net/en/", "http://example.net/en", "http://example.net/en/",
           "https://x.Example.NET/en/x", "http://example.net/EN/", "http://xnet/", "http://org/fr/#net/", "http://foo.org/fr/a?b", "http://a?b://c.net/", "http://u@ads.x/",
           "http://a/help/login/", "http://a/login", "http://a/Login?x", "http://a/xlogin/", "http://a.b/x.exe", "http://a.b/x.exe?y", "http://cdn.q/z.js", "http://x/\n/login", "s://t.org:80/fr/"]
    for _ in range(n):
        host = ".".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4)))
        rest = "".join(rnd.choice("/?#.=-&_%") + rnd.choice(parts) for _ in range(rnd.randrange(5)))
        out.append(f"http://{host}{rest}")
    return out


MORE = [("e", "block"), ("*x*", "allow"), ("||example", "block"), ("|ads.www", "allow"), ("^en^*^x", "block"), ("%", "block"), ("ü/", "block"), ("LOGIN?", "allow"), ("^0|", "allow")]


@pytest.mark.parametrize("literal", [U.LITERAL_RULES, 0])
@pytest.mark.parametrize("sites,patterns", [(U.SITES, U.PATTERNS), (U.SITES + [("net", "allow"), ("example.net/e", "block"), ("ads.www/EN", "block")], MORE), ([], []), (U.SITES, []), ([], MORE[:1])])
def test_matches_plain(spark, literal, sites, patterns):
    given = urls(3) * 2
    pages = spark.createDataFrame([(i, u, 7, "t", "o", "u") for i, u in enumerate(given)] + [(None, given[9], 7, "t", "o", "u")], SCHEMA)
    rows = U.judge(pages, U.compile_rules(sites, patterns), literal_rules=literal).collect()
    assert len(rows) == len(given) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.pattern, r.verdict) == plain(r.url, sites, patterns), r.url
        assert (r.tried, r.own, r.u) == ("t", "o", "u")


def test_only_candidates_run(spark):
    """An address without a rule's rarest token never runs its expression."""
    rules = U.compile_rules(U.SITES, U.PATTERNS)
    pages = spark.createDataFrame([(i, f"http://www.site{i}.com/text/{i}") for i in range(50)] + [(50, "http://a.example.net/en/login/")], "page_id long, url string")
    rows = {r.page_id: r for r in U.judge(pages, rules).collect()}
    assert all(rows[i].n_tried == 0 for i in range(50))
    assert 2 <= rows[50].n_tried <= 5 and rows[50].rule == "example.net/en/"
    index = U.rarest_tokens(U._with_parts(pages, "url"), rules)
    assert "com" not in index and [r.text for r in index["de"]] == ["example.com/de/"]     # com is in every address, de in none


def test_closed_tokens():
    def of(text):
        return set(U._pattern(text)[1])
    assert of("foo") == set() and of("/foo/") == {"foo"} and of("|foo|") == {"foo"} and of("||foo.*bar^") == {"foo"}
    assert of("^foo*^bar^") == {"bar"} and of("a.b.c") == {"b"} and of("*") == set()
    assert U._site("net/e")[1] == {"net"} and U._site("net")[1] == {"net"} and U._site("a.net/e/")[1] == {"a", "net", "e"}


def test_native_plan_and_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    out = U.judge(pages, U.compile_rules(U.SITES, U.PATTERNS))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_table_against_plain(spark):
    from fixtures_llm import SF_SMALL
    rows = U.op12_url_filters(spark, SF_SMALL).collect()
    want = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url").collect()}
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == sorted(
        (i, *plain(u, U.SITES, U.PATTERNS)[:3], plain(u, U.SITES, U.PATTERNS)[4]) for i, u in want.items())
