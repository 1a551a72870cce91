"""The learned URL list against a plain version, keys of whole paths, and the query against its SQL with a list that is not empty."""

import random
import re
from collections import defaultdict

import pytest

from geoloom.llm import queries, urls
from tests.compare import SF, compare

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return set(WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def plain_list(docs, labels, pages, least, share, host_pages, host_share):
    toxic = dict(labels)
    a, n = defaultdict(int), defaultdict(int)
    for k, t in docs:
        if k in toxic:
            for w in fold(t):
                n[w] += 1
                a[w] += toxic[k] == 1
    markers = {w for w in n if a[w] >= least and a[w] >= share * n[w]}
    split = [(*urls.split_url(u), bool(fold(h) & markers)) for _, u, h in pages]
    hit = {(h, p) for h, p, x in split if x and h}
    by = defaultdict(list)
    for h, p, _ in split:
        if h:
            by[h].append((h, p) in hit)
    return markers, {h + p + urls.WHOLE for h, p in hit} | {h for h, x in by.items() if len(x) >= host_pages and sum(x) >= host_share * len(x)}


def test_learned_list(spark):
    r = random.Random(4)
    words = "the of And é night day river Stone".split()
    docs = [(k, r.choice([None, "", " ".join(r.choice(words) for _ in range(12)) + (" MORON, trash" if k % 4 == 0 else " day")])) for k in range(200)]
    labels = [(k, int(k % 4 == 0)) for k in range(150)]
    pages = [(k, f"http://h{r.randrange(6)}.Org/{r.choice(['', 'a', 'a/b', 'c?d', 'é'])}", f"<p>{r.choice(words)}{' moron' if r.random() < 0.3 else ''}</p>") for k in range(120)]
    pages += [(500 + k, f"http://bad.org/{k}", "<b>trash</b>") for k in range(9)] + [(600, None, "moron"), (601, "no url", "moron"), (602, "http://h1.org", None), (603, "http://x.org?y", "moron"), (603, "http://x.org?y", "moron")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    markers = urls.marker_words(d, spark.createDataFrame(labels, "doc_id long, toxic int"), least=5)
    p = spark.createDataFrame([(*x, "clash") for x in pages], "page_id long, url string, html string, host string")
    found = urls.listed_pages(p, markers, host_pages=8)
    want, keys = plain_list(docs, labels, pages, 5, urls.LEAST_SHARE, 8, urls.HOST_SHARE)
    assert {x.word for x in markers.collect()} == want >= {"moron", "trash"}
    assert sorted(x.key for x in found.collect()) == sorted(keys) and "bad.org" in keys
    judged = {(x.page_id, x.verdict) for x in urls.judge(p, found.selectExpr("0 as layer", "key", "verdict")).collect()}
    for k, u, _ in pages:
        h, q = urls.split_url(u)
        blocked = bool(h) and (h + q + urls.WHOLE in keys or any(h == x or h.endswith("." + x) for x in keys if not x.endswith(urls.WHOLE)))
        assert (k, "block" if blocked else "allow") in judged
    assert urls.listed_pages(p.limit(0), markers).count() == 0 and urls.marker_words(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_learning_is_bounded(spark):
    """Of many labelled rows about the bound is drawn, the same ones each time."""
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "1 as toxic")
    a, b = ({x.word for x in urls.marker_words(docs.repartition(n), labels, learned_from=400, least=1).collect()} for n in (1, 5))
    assert a == b and 300 < len(a) < 500


def test_keys_of_whole_paths(spark):
    rules = spark.createDataFrame([(0, "a.org/x" + urls.WHOLE, "block"), (0, "a.org/x/y/", "allow"), (0, "b.org" + urls.WHOLE, "block"), (1, "org", "block")], "layer int, key string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://a.org/x/"), (3, "http://w.a.org/x"), (4, "http://a.org/x?q"), (5, "http://b.org"), (6, "http://b.org/"), (7, "http://a.org/x/y/z"), (8, "x")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.layer) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("block", 0), 2: ("block", 1), 3: ("block", 1), 4: ("block", 0), 5: ("block", 0), 6: ("block", 1), 7: ("allow", 0), 8: ("allow", None)}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_with_a_list(spark, folder):
    assert compare(spark, folder, queries.op5_url_filter, queries.oracle_sql()["op5_url_filter"]) == ""
    rules = queries.url_rules(spark, folder)
    assert rules.where("layer = 1").count() > 5
    assert queries.url_rules(spark, SF).where("layer = 0").count() == len(queries.URL_RULES)
