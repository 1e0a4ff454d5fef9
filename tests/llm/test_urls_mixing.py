"""URL filters and source mixing."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import mixing, urls


def judged(spark, rows, labels=(), **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    known = spark.createDataFrame(list(labels), "key long, good double")
    return {r.page_id: r for r in urls.judge(pages, known, urls.page_document(F.col("path")), **kw).collect()}


def test_rules_and_parts(spark):
    r = judged(spark, [(i, u, "x", "y") for i, u in enumerate(["http://Sub.Example.ORG/es/1?q#f", "http://example.org/en/17", "http://a.com/fr/x", "https://com/de/", "http://example.org", "no url", None, "x://", "http://anexample.org/es/2", "http://b.net/de/1"])])
    assert (r[0].host, r[0].path, r[0].rule, r[0].verdict) == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert (r[1].rule, r[1].verdict, r[2].verdict, r[3].verdict) == ("example.org/en/1", "block", "allow", "block")
    assert (r[4].path, r[4].rule) == ("", None)  # the rule's path is /
    assert [(r[i].host, r[i].path, r[i].rule) for i in (5, 6, 7)] == [("", "", None)] * 3
    assert r[8].rule == "org/" and r[9].rule is None


def test_impure_template_is_blocked_and_sparse_ones_shrink(spark):
    rows = [(i, f"http://h.net/spam/{i}", "", "") for i in range(100)] + [(100 + i, f"http://h.net/news/{100 + i}", "", "") for i in range(100)] + [(500, "http://h.net/rare/500", "", "")]
    labels = [(i, 0.0) for i in range(100)] + [(100 + i, 1.0) for i in range(100)] + [(500, 0.0)]
    r = judged(spark, rows, labels)
    assert r[0].verdict == "block" and r[150].verdict == "allow" and r[0].template != r[150].template
    assert r[500].purity > 0.3  # one label says little


def test_variable_segments_become_wildcards(spark):
    rows = [(i, f"http://h.net/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/post", "", "") for i in range(200)]
    assert {x.template for x in judged(spark, rows).values()} == {"/{*}/post"}


def test_branches_without_labels_join_only_those_that_agree(spark):
    rows = [(k * 20 + i, f"http://h.net/{'abc'[k]}/{k * 20 + i}", "", "") for k in range(3) for i in range(20)]
    told = judged(spark, rows, [(i, float(i >= 20)) for i in range(40)])
    assert {x.template for x in told.values()} == {"/a/{n}", "/b/{n}", "/c/{n}"}
    like = judged(spark, rows, [(i, float(i % 2)) for i in range(40)])
    assert {x.template for x in like.values()} == {"/{*}/{n}"}


def test_segments_with_a_number_become_wildcards_too(spark):
    slug = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}-shoes"
    for many in (100, 25):  # by the branch rule, and by merging
        rows = [(i, f"http://h.net/spam/{slug(i % many)}-{i}", "", "") for i in range(100)] + [(100 + i, f"http://h.net/news/{slug(i % many)}-{100 + i}", "", "") for i in range(100)]
        pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
        known = spark.createDataFrame([(i, float(i >= 100)) for i in range(200)], "key long, good double")
        r = {x.page_id: x for x in urls.judge(pages, known, F.regexp_extract("path", "([0-9]+)$", 1).cast("long")).collect()}
        assert {x.page_id // 100: (x.template, x.verdict) for x in r.values()} == {0: ("/spam/{*}", "block"), 1: ("/news/{*}", "allow")} and len({x.template for x in r.values()}) == 2


def test_branches_merge_at_every_level(spark):
    rows = [(k * 20 + i, f"http://h.net/part{'abcd'[k % 4]}/{'spam' if k < 4 else 'news'}/{k * 20 + i}", "", "") for k in range(8) for i in range(20)]
    r = judged(spark, rows, [(i, float(i >= 80)) for i in range(160)])
    assert {x.template for x in r.values()} == {"/{*}/spam/{n}", "/{*}/news/{n}"}


def test_branches_below_the_sixth_segment_are_apart(spark):
    rows = [(i, f"http://h.net/y/2020/01/02/shop/x/{'spam' if i < 50 else 'news'}/{i}", "", "") for i in range(100)]
    r = judged(spark, rows, [(i, float(i >= 50)) for i in range(100)])
    assert r[0].template != r[99].template and (r[0].verdict, r[99].verdict) == ("block", "allow") and r[0].template.endswith("/spam/{n}")


def test_no_pages(spark):
    assert judged(spark, []) == {}


def budgets(sizes, weights=(3, 1, 2)):
    """Targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: unit * w[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("bucket_rows", [3, 10_000])
def test_mix_matches_brute_force(spark, bucket_rows):
    docs = [(i, "w " * (1 + i * 7 % 23), ["b", "a", None, "c"][i % 4] if i % 5 else "a", 1) for i in range(300)] + [(1000, None, "a", 1), (1001, "", "empty", 1), (5, "w " * 13, "b", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    got = mixing.mix(df, bucket_rows=bucket_rows).collect()
    assert len(got) == len(docs)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want = budgets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.size == 0 or r.taken % r.size == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 12 for s in want)
    again = mixing.mix(df, bucket_rows=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_heavier_documents_are_taken_first(spark):
    df = spark.createDataFrame([(i, "a a a a" if i % 2 else "# # # #", "s") for i in range(400)] + [(1000 + i, "a " * 40, "t") for i in range(100)], "doc_id long, text string, source string")
    rows = mixing.mix(df, weights=(1.0, 4.0)).filter("source = 's'")
    by = {r.odd: r.n for r in rows.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()}
    assert by[1] > by[0]


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
