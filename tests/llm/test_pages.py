"""Main text, URL filter and language of pages."""

from __future__ import annotations

import html
import re

import pytest

from tablescope.llm import html as main
from tablescope.llm import langid, urls

from ..conftest import SF
from .cases import frame, got

PAGE = "page_id long, url string, html string"


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", re.sub(r"<script>.*?</script>", "", page, flags=re.S), re.S)
    blocks = re.split(r"</?(?:p|h1)>", inner[1] if inner else "")
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_main_text_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages.collect()]
    assert got(main.extract(pages), "page_id", "url", "text", "n_chars") == sorted(rows, key=repr)


LONG = "Long words of the main text follow here and go on for quite a while, " * 2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<p>Hello</p>", "Hello"),
        ("<script>x", ""),
        ("<!-- never closed", ""),
        ("a<b>c</b>d<p", "acd"),
        (f"<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>{LONG}</p><footer>f</footer>", LONG.strip()),
        (f"<body><header>Head</header><main><h1>T</h1><p>a&nbsp; b &amp c</p><div class='comments'><p>{LONG}</p></div><p>z</p></main>", "T\na b & c\nz"),
        (f"<article><h1>T</h1><p>{LONG}</p></article><section id=comments><article><p>mine {LONG}</p></article></section>", f"T\n{LONG.strip()}"),
        ("<article><p>One.</p><aside>No</aside><p>Two.</p><form><p>No</p></form><p>Three.</p></article><div class='cookie-notice'>No</div>", "One.\nTwo.\nThree."),
        (f"<div class=sidebar>{LONG}</div><div><p>{LONG}</p></div>", LONG.strip()),
    ],
)
def test_main_text(page, text):
    assert main.main_text(page) == text


def test_extract_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "", "")]
    assert got(main.extract(frame(spark, rows, PAGE)), "page_id", "url", "text", "n_chars") == sorted(
        [(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1), (2, "", "", 0)], key=repr
    )
    assert main.extract(frame(spark, [], PAGE)).count() == 0


RULES = [("com", "/", "allow"), ("a.com", "/x/", "block"), ("www.a.com", "/x/", "allow"), ("net", "/page.html", "block"), ("A.com", "/x/", "allow"), (None, "/", "block"), ("org", None, "block")]


def fits(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, v in RULES:
        if h is None:
            continue
        h, p = h.lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h + p), v, h + p)) if best else (len(h + p), v, h + p)
    return host, path, best[2] if best else None, best[1] if best else "allow"


URLS = [
    None, "", "no scheme", "http://a.com/x/1?q=/y", "http://WWW.a.com/x/", "https://sub.www.a.com/x/z#f", "http://ba.com/x/", "http://net/page.html",
    "ftp://q.net/page.html.bak", "http://net/other", "http://a.org", "http://?x", "http://a.com/X/", "://com/", "http://x.org/://com/",
]


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_url_filter(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[4])]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = got(urls.filter_urls(frame(spark, rows, "page_id long, url string"), rules), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted([(i, *fits(u)) for i, u in rows], key=repr)
    none = urls.filter_urls(frame(spark, rows, "page_id long, url string"), rules.limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(rows)
    assert urls.filter_urls(frame(spark, [], "page_id long, url string"), rules).count() == 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as key")
    blocks = urls.bloom_blocks(keys, 313).collect()
    assert 0 < len(blocks) <= 313
    asked = spark.range(20_000).selectExpr("cast(id as string) as key")
    from pyspark.sql import functions as F

    asked = asked.select("key", urls._place(F.col("key"), 313).alias("block"), urls._mask(F.col("key")).alias("m"))
    known = urls.bloom_blocks(keys, 313)
    ok = asked.join(known, "block").where(" and ".join(f"words[{w}] & m[{w}] = m[{w}]" for w in range(4)))
    passed = {int(r.key) for r in ok.select("key").collect()}
    assert passed >= set(range(5000)) and len(passed) < 5000 + 15_000 * 0.02


def evidence(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog went there with them", "en"), (2, "der hund und die katze gehen dort hin", "de"), (3, "x", None)] * 3,
        "doc_id long, text string, lang string",
    )
    pages = [
        (1, "http://a.de/1", "<html lang=de><p>der hund und die katze</p>"), (2, "http://a.de/2", "<html lang='de'><p>die katze und der hund</p>"),
        (3, "http://a.de/3", "<p></p>"), (4, "http://b.uk/1", '<html lang="en-GB"><p>the dog and the cat went there</p>'),
        (5, "http://b.uk/2", "<html lang=xx><p>with them the dog</p>"), (6, None, None), (None, "", ""),
    ]
    return docs, pages


def test_language(spark):
    docs, pages = evidence(spark)
    found = {r.page_id: r for r in langid.identify(frame(spark, pages, PAGE), docs).collect()}
    assert len(found) == len(pages)
    assert [found[i].lang for i in (1, 2, 3, 4, 5)] == ["de", "de", "de", "en", "en"]  # page 3 has no text: its host decides
    assert [found[i].declared for i in (1, 3, 4, 5)] == ["de", "none", "en", "other"]
    assert all(0 < r.posterior <= 1 for r in found.values())
    empty = langid.identify(frame(spark, pages, PAGE), docs.limit(0)).collect()
    assert len(empty) == len(pages) and all(r.lang is None for r in empty)
    assert langid.identify(frame(spark, [], PAGE), docs).count() == 0


def test_host_prior_is_what_brute_force_gives(spark):
    """One page's posterior from plain sums."""
    import math

    docs, pages = evidence(spark)
    langs, table = langid.text_model(docs)
    texts = {i: main.main_text(p or "") for i, _, p in pages}
    ll, q = {}, {}
    for i, t in texts.items():
        g = langid.trigrams(t)
        each = [float(table[k, g].sum()) * min(1, langid.MOST_EVIDENCE / max(len(g), 1)) for k in range(len(langs))]
        ll[i] = each
        w = [math.exp(x - max(each)) for x in each]
        q[i] = [x / sum(w) for x in w]
    site = {1: ("a.de", "a.de", "de", "de"), 2: ("a.de", "a.de", "de", "de"), 3: ("a.de", "a.de", "de", "none"), 4: ("b.uk", "b.uk", "uk", "en"), 5: ("b.uk", "b.uk", "uk", "other"), 6: ("", "", "", "none"), None: ("", "", "", "none")}
    me = 3
    others = [i for i in texts if i != me]
    sums = lambda at: [sum(q[i][k] for i in others if at is None or site[i][at] == site[me][at]) for k in range(len(langs))]
    whole, host, domain, suffix, said = sums(None), sums(0), sums(1), sums(2), sums(3)
    d, scores = langid.DRAW, []
    for k in range(len(langs)):
        base = (whole[k] + 1 / len(langs)) / (sum(whole) + 1)
        of_domain = (domain[k] + d * base) / (sum(domain) + d)
        of_host = (host[k] + d * of_domain) / (sum(host) + d)
        scores.append(ll[me][k] + math.log(of_host) + sum(math.log((s[k] + d * 0.1) / (whole[k] + d)) for s in (said, suffix)))
    top = max(scores)
    found = {r.page_id: r for r in langid.identify(frame(spark, pages, PAGE), docs).collect()}[me]
    assert found.lang == langs[scores.index(top)]
    assert found.posterior == pytest.approx(1 / sum(math.exp(s - top) for s in scores), abs=2e-6)


def test_language_of_the_given_pages(spark):
    found = langid.identify(spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")).collect()
    agree = sum(r.lang == r.declared for r in found)
    assert agree >= 0.9 * len(found)


def test_letters_that_grow_when_lower_cased_do_not_shift_the_end_of_a_script():
    from tablescope.llm import html as h

    page = "<html><body><article>" + "İ" * 60 + "<script>var a = 1;</SCRIPT><p>" + "first paragraph words " * 8 + "</p><p>" + "second paragraph words " * 8 + "</p></article></body></html>"
    texts = " ".join(t for t, _, _ in h.lines_of(page))
    assert "first paragraph" in texts and "second paragraph" in texts and "var a" not in texts
