import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import dedup as D
from pagequarry.operators.crawl import CrawlLimits, deep_crawl
from pagequarry.plans import catalogue
from pagequarry.sources import providers


def shingle_set(text, n=8):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, t):
    kept = []
    for o, url, text in rows:
        s = shingle_set(text)
        if any((url and url == u) or (s and z and len(s & z) / len(s | z) >= t) for _, u, z in kept):
            continue
        kept.append((o, url, s))
    return [o for o, _, _ in kept]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord long, url string, text string")


@pytest.mark.parametrize("threshold", [0.3, 0.85, 1.0])
def test_filter_equals_the_sequential_rule(spark, threshold):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("abcdef")
        else:
            w = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 40))]
        rows.append((i, rng.choice([None, f"u{rng.randrange(60)}", f"v{i}"]), " ".join(w)))
    rows += [(80, "blank1", ""), (81, "blank2", " "), (82, "blank3", None)]
    got = sorted(r.ord for r in D.filter_duplicates(frame(spark, rows), threshold=threshold).collect())
    assert got == brute(rows, threshold)


def test_ten_thousand_equal_texts_are_one_set(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "x")
    rows = [(i, None if i % 2 else f"u{i % 7}", text) for i in range(10_000)] + [(10_000, "u0", near), (10_001, "z", "one other text")]
    assert sorted(r.ord for r in D.filter_duplicates(frame(spark, rows)).collect()) == brute(rows[:20] + rows[-2:], D.THRESHOLD) == [0, 10_001]


def test_chain_keeps_both_ends(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = base[:50], base[4:54], base[8:58]
    rows = [(i, f"u{i}", " ".join(x)) for i, x in enumerate((a, b, c))]
    assert sorted(r.ord for r in D.filter_duplicates(frame(spark, rows), threshold=0.8).collect()) == [0, 2] == brute(rows, 0.8)


def test_state_remembers_kept_pages_only(spark):
    t = " ".join(f"w{i}" for i in range(30))
    s = D.SeenState()
    assert [r.ord for r in s.filter(frame(spark, [(0, "a", t), (1, "b", t)])).collect()] == [0]
    again = s.filter(frame(spark, [(2, "c", t), (3, "b", "other words that nobody has written so far here"), (4, "a", "zz")]))
    assert sorted(r.ord for r in again.collect()) == [3]
    s.reset()
    assert s.filter(frame(spark, [(5, "a", t)])).count() == 1
    with pytest.raises(ValueError):
        D.SeenState(0)


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(D.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1 / 3)]


def site(pages):
    """A page source over {url: (title, links)}; counts what is asked for."""
    asked = []

    def source(urls):
        rows = []
        for r in urls.orderBy("ord").collect():
            asked.append(r.url)
            if r.url in pages:
                name, links = pages[r.url]
                body = " ".join(f"{name}{i}" for i in range(20))
                html = f"<html><body><p>{body}</p>" + "".join(f'<a href="{x}">l</a>' for x in links) + "</body></html>"
                rows.append((r.ord, r.url, html, None))
            else:
                rows.append((r.ord, r.url, None, "missing"))
        return urls.sparkSession.createDataFrame(rows, "ord long, url string, html string, error string")

    source.asked = asked
    return source


def urls(df):
    return [r.url for r in df.orderBy("ord").collect()]


def test_waves_depth_domain_and_order(spark):
    s = site({"http://a/": ("a", ["/1", "/2#x", "http://b/", "/1"]), "http://a/1": ("one", ["/3", "/2"]), "http://a/2": ("two", ["/4"]), "http://a/3": ("three", []), "http://a/4": ("four", ["/5"]), "http://b/": ("b", [])})
    assert urls(deep_crawl(spark, ["http://A/#f"], s, CrawlLimits(depth=2))) == ["http://a/", "http://a/1", "http://a/2", "http://a/3", "http://a/4"]
    rows = deep_crawl(spark, ["http://a/"], s, CrawlLimits(depth=1, follow_external=True)).orderBy("ord").collect()
    assert [(r.url, r.depth) for r in rows] == [("http://a/", 0), ("http://a/1", 1), ("http://a/2", 1), ("http://b/", 1)]


def test_max_pages_cuts_kept_pages_not_fetches(spark):
    s = site({f"http://a/{i}": (f"n{i}", []) for i in range(4)})
    assert urls(deep_crawl(spark, [f"http://a/{i}" for i in range(4)], s, CrawlLimits(max_pages=2))) == ["http://a/0", "http://a/1"]
    assert len(s.asked) == 4


def test_repeated_seed_is_fetched_twice_and_dropped_by_content(spark):
    s = site({"http://a/": ("a", [])})
    assert urls(deep_crawl(spark, ["http://a/", "http://a/"], s)) == ["http://a/"] and len(s.asked) == 2


def test_domain_cap_grows_within_a_wave(spark):
    pages = {"http://a/1": ("p", ["/x"]), "http://a/2": ("q", ["/y"]), "http://a/3": ("r", ["/z"])} | {f"http://a/{c}": (c * 3, []) for c in "xyz"}
    got = urls(deep_crawl(spark, ["http://a/1", "http://a/2", "http://a/3"], site(pages), CrawlLimits(depth=1, max_pages_per_domain=2)))
    assert got == ["http://a/1", "http://a/2", "http://a/3", "http://a/x"]  # seeds pass; the second page's links find the cap reached


def test_pagination_stays_at_its_depth(spark):
    s = site({"http://a/?page=1": ("p1", []), "http://a/?page=2": ("p2", []), "http://a/?page=3": ("p3", [])})
    rows = deep_crawl(spark, ["http://a/?page=1"], s, CrawlLimits(depth=0, max_pagination_pages=2)).orderBy("ord").collect()
    assert [(r.url, r.depth, r.page_num) for r in rows] == [("http://a/?page=1", 0, 1), ("http://a/?page=2", 0, 2)]
    assert urls(deep_crawl(spark, ["http://a/?page=1"], s, CrawlLimits(paginate=False))) == ["http://a/?page=1"]


def test_bad_seed_raises(spark):
    with pytest.raises(ValueError):
        deep_crawl(spark, ["ftp://a/"], site({}))
    assert deep_crawl(spark, ["http://none/"], site({})).count() == 0


def brute_crawl(pages, seeds, depth=1, most_pagination=5):
    """(url, depth, page_num) kept by a wave crawl of {url: (text, links)} without caps, within the seeds' hosts."""
    kept, seen, wave = [], set(seeds), [(u, 0, 1) for u in seeds]
    texts = []
    while wave:
        took = []
        for u, d, n in wave:
            s = shingle_set(pages[u][0]) if u in pages else set()
            if s and not any(len(s & z) / len(s | z) >= 0.85 for z in texts):
                texts.append(s)
                took.append((u, d, n))
        kept += took
        wave = []
        for u, d, n in took:
            host = u.split("/")[2]
            found = [(x, d + 1, 1) for x in pages[u][1] if d < depth and x.split("/")[2] == host]
            if f"page={n}" in u and n < most_pagination:
                found.append((u.replace(f"page={n}", f"page={n + 1}"), d, n + 1))
            for x in found:
                if x[0] not in seen:
                    seen.add(x[0])
                    wave.append(x)
    return kept


def linked_pages():
    rng = random.Random(8)
    pages = {}
    for i in range(130):
        host = f"http://h{i % 3}"
        text = " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(20))
        if i % 11 == 10:
            text = pages[f"http://h{(i - 1) % 3}/p{i - 1}"][0]
        pages[f"{host}/p{i}"] = (text, [f"{host}/p{(i + 3 * k) % 130}" for k in (1, 2)] + [f"http://h{(i + 1) % 3}/p{i + 1}"])
    pages |= {f"http://h0/list?page={n}": (" ".join(f"list{n}x{k}" for k in range(20)), []) for n in range(1, 8)}
    return pages


def html_of(text, links):
    return f"<html><body><p>{text}</p>" + "".join(f'<a href="{x}"></a>' for x in links) + "</body></html>"


def test_deep_crawl_query_crawls_the_whole_table(spark, tmp_path):
    pages = linked_pages()
    rows = [(i, u, html_of(*pages[u])) for i, u in enumerate(pages)]
    spark.createDataFrame([*rows, (998, None, "<p>x</p>"), (999, "ftp://h0/", "<p>y</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.url, r.depth, r.page_num) for r in catalogue.queries()["deep_crawl"](spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == brute_crawl(pages, list(pages)) and len(got) > 100


def test_uncapped_crawl_from_few_seeds(spark):
    pages = linked_pages()
    raw = spark.createDataFrame([(u, html_of(*p), None) for u, p in pages.items()], "url string, html string, error string")
    few = [u for i, u in enumerate(pages) if i % 5 == 0 and "list" not in u] + ["http://h0/list?page=1"]
    seeds = spark.createDataFrame(list(enumerate(few)), "ord long, url string")
    limits = CrawlLimits(depth=1, max_pages=None, max_pages_per_domain=2147483647)
    got = [(r.url, r.depth, r.page_num) for r in deep_crawl(spark, seeds, providers.snapshot_source(raw), limits).orderBy("ord").collect()]
    assert got == brute_crawl(pages, few) and {(d, n) for _, d, n in got} == {(0, 1), (1, 1), *((0, n) for n in range(2, 6))}


def test_a_line_that_all_texts_share_makes_no_candidates(spark):
    rng = random.Random(4)
    shared = " ".join(f"line{k}" for k in range(60))  # most shingles of a text: by hash order alone these would lead every prefix
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(30)) + " " + shared) for i in range(400)]
    rows += [(400 + i, rows[i][1].replace("line59", "other")) for i in range(20)] + [(500, rows[7][1])]
    pages = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    marks = D._marks(pages).cache()
    prefixes = D._prefixes(pages.where("id < 500"), D.THRESHOLD, D._frequent(marks))
    assert D._candidates(prefixes, D.THRESHOLD).count() < 200  # of 88,410 pairs
    sets = {i: shingle_set(t) for i, t in rows}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b}
    want = {k: j for k, j in want.items() if j >= D.THRESHOLD}
    got = {(r.a, r.b): r.jaccard for r in D.similar_pairs(pages).collect()}
    assert got == want and len(want) == 22


def test_groups_of_near_sets_in_blocks_lose_no_pair(spark, monkeypatch):
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 150, 3)]
    sets = {i: shingle_set(t) for i, t in rows}
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    monkeypatch.setattr(D, "_BLOCK", 1000)  # the group has some 7,000 hashes
    monkeypatch.setattr(D, "_PAIRS_AT_ONCE", 7)
    got = {(r.a, r.b) for r in D.similar_pairs(spark.createDataFrame(rows, "id long, text string"), 0.8).collect()}
    assert got == want and len(want) > 300


def test_a_wave_writes_its_texts_once(spark, tmp_path, monkeypatch):
    pages = {f"http://a/{i}": (" ".join(f"{i}w{k}" for k in range(20)), []) for i in range(6)}
    rows = [(i, u, html_of(*p)) for i, (u, p) in enumerate(pages.items())]
    spark.createDataFrame([*rows, (9, "http://a/0", html_of("a later page of the same url", [])), (9, "http://a/0#x", "<p>z</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    wrote = []
    for module in (catalogue, catalogue.crawl, D):
        monkeypatch.setattr(module, "staged", lambda df, name, real=module.staged: wrote.append((name, df.columns)) or real(df, name))
    got = catalogue.queries()["deep_crawl"](spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.url for r in got] == list(pages)
    assert [name for name, columns in wrote if {"text", "html", "fp"} & {*columns}] == ["wave"]
