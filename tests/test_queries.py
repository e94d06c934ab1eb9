"""Every query against its SQL on the smallest tables."""

import pytest

from pagequarry.plans import catalogue
from tests.compare import assert_same, connect

WITH_SQL = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, sf, con, name):
    assert_same(catalogue.queries()[name](spark, sf), con, catalogue.oracle_sql()[name])


def test_flagship(spark, sf):
    rows = catalogue.flagship(spark, sf).collect()
    assert len(rows) == 10
    scores = [r.relevance_score for r in rows]
    assert scores == sorted(scores, reverse=True) and scores[0] == 1.0


def test_deep_crawl_keeps_seeds_in_order(spark, sf):
    rows = catalogue.queries()["deep_crawl"](spark, sf).orderBy("ord").collect()
    assert len(rows) > 0 and [r.ord for r in rows] == list(range(1, len(rows) + 1))


def test_expand_links_has_no_domain_cap(spark, sf, monkeypatch):
    caps, real = [], catalogue.crawl.expand
    monkeypatch.setattr(catalogue.crawl, "expand", lambda kept, seen, prior, limits: caps.append(limits.max_pages_per_domain) or real(kept, seen, prior, limits))
    catalogue.queries()["expand_links"](spark, sf)
    assert caps == [2147483647]


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_topk_is_a_bounded_sort_and_scan_is_pruned(spark, sf, capsys):
    catalogue.queries()["rank_keyword_topk"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_keyword_score_reads_its_table_three_times(spark, sf):
    plan = catalogue.queries()["keyword_score"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("regexp_extract_all") <= 2  # two passes before it: the vocabulary, the scale's ends


def test_semantic_score_equals_brute_force(spark, sf):
    pages = catalogue.H.parse_many(catalogue.providers.snapshot(spark, f"{sf}/pages.parquet")).select("ord", "text").collect()
    goal = catalogue.hashed_words([catalogue.QUERY])[0]
    cos = {}
    for r in pages:
        w = (r.text or "").split()
        parts = [" ".join(w[i : i + 256]) for i in range(0, max(len(w) - 256, 0) + 1, 128)]
        v = catalogue.hashed_words(parts).max(0)
        size = (v @ v) ** 0.5 * (goal @ goal) ** 0.5
        cos[r.ord] = v @ goal / size if size else 0.0
    low, high = min(cos.values()), max(cos.values())
    got = {r.ord: r.semantic_score for r in catalogue.queries()["semantic_score"](spark, sf).collect()}
    assert set(got) == set(cos) and all(abs(got[o] - (c - low) / (high - low)) < 2e-6 for o, c in cos.items())
