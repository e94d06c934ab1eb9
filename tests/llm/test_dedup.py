"""Exact, n-gram, suffix and substring deduplication against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import exact_dedup, ngram_join, substring_dedup, suffix_dedup, superkmers, textkernel

SCHEMA = "doc_id long, text string, digest string, id int, keys int, source string"


def docs(spark, rows):
    """Rows (id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "d", 1, 2, "s") for i, t in rows], SCHEMA)


def some_words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, ""), (None, "x y"), (None, None), (5, "x y"), (5, "x y"), (6, "!!"), (7, "é"), (8, "É"), (9, "ab\x00c")]


def brute_exact(rows):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        if t in first:
            out.append((i, first[t]))
        else:
            first[t] = i
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 2, 1024])
def test_exact(spark, k):
    rng = random.Random(1)
    rows = EDGE + [(100 + i, f"t{int(rng.expovariate(0.3))}") for i in range(200)]
    got = exact_dedup.exact_duplicates(docs(spark, rows).repartition(5), k).collect()
    assert sorted(((r.doc_id, r.kept_id) for r in got), key=str) == brute_exact(rows)
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows), k)
    assert kept.columns == docs(spark, rows).columns
    texts = [r.text for r in kept.collect()]
    assert sorted(t for t in texts if t is not None) == sorted({t for _, t in rows if t is not None}) and texts.count(None) == 2
    assert {r.doc_id for r in kept.collect() if r.text == "x y"} == {5}


def test_exact_on_nothing(spark):
    assert exact_dedup.exact_duplicates(docs(spark, EDGE).limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs(spark, EDGE).limit(0)).count() == 0


def test_heavy_hitters_are_found(spark):
    df = spark.createDataFrame([(bytes([i % 7 if i % 2 else 99]),) for i in range(1000)], "x binary").repartition(70)
    got = {bytes(r.item) for r in exact_dedup.misra_gries(df, "x", 3).collect()}
    assert b"c" in got and len(got) <= 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_partition_is_summarised_by_its_own_task(spark):
    df = spark.range(20_000).select(F.sha2((F.col("id") % 5000).cast("string"), 256).cast("binary").alias("x")).repartition(100)
    seen = exact_dedup.misra_gries(df, "x", 50)
    assert "Exchange hashpartitioning(item" in plan_of(seen) and "Exchange SinglePartition" in plan_of(seen)  # 100 -> 2 -> 1
    group = "own-tasks"
    spark.sparkContext.setJobGroup(group, group)
    seen.collect()
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) >= 100


def test_texts_are_not_shuffled_to_drop_copies(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 40} " + "long text " * 20) for i in range(600)] + [(1, "hot"), (1, "hot")]
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows))
    assert "Exchange hashpartitioning" not in plan_of(exact_dedup.drop_exact_duplicates(docs(spark, rows[:600])))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({t: i for i, t in reversed(rows)}.values())


def test_exact_very_long_text(spark):
    long = "word " * 400_000
    got = exact_dedup.exact_duplicates(docs(spark, [(3, long), (1, long), (2, long + "x")])).collect()
    assert [(r.doc_id, r.kept_id) for r in got] == [(3, 1)]


WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def gram_set(t, n=3):
    w = WORD.findall((t or "").lower())
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_rows(seed=2, groups=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = some_words(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_ngram_join_recall_and_precision(spark):
    rows = near_rows() + [(9000, "a b"), (9001, "B, a."), (9002, "A b"), (9003, None), (9004, "..."), (None, "a b")]
    sets = {i: gram_set(t) for i, t in rows if i is not None and gram_set(t)}
    want = {}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s = len(sets[a] & sets[b])
            j = s / (len(sets[a]) + len(sets[b]) - s)
            if j >= 0.5:
                want[a, b] = j
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.jaccard_pairs(docs(spark, rows)).collect()}
    assert all(abs(want[p] - j) < 1e-12 for p, j in got.items())
    rep = {}
    for i in ids:
        rep.setdefault(frozenset(sets[i]), i)
    full = {(min(rep[frozenset(sets[a])], rep[frozenset(sets[b])]), max(rep[frozenset(sets[a])], rep[frozenset(sets[b])])) for a, b in want}
    stars = {(rep[frozenset(sets[i])], i) for i in ids if rep[frozenset(sets[i])] != i}
    expected = {p for p in full if p[0] != p[1]} | stars
    assert set(got) <= expected and len(got) >= 0.95 * len(expected)


def brute_links(rows):
    """{doc_id: (class_id, links)} of the documents that reach the threshold with another."""
    sets = {i: gram_set(t) for i, t in rows if i is not None and gram_set(t)}
    linked = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            s = len(sets[a] & sets[b])
            if a < b and s / (len(sets[a]) + len(sets[b]) - s) >= 0.5:
                linked[a].add(b)
                linked[b].add(a)
    out = {}
    for i in sorted(x for x in linked if linked[x]):
        if i not in out:
            group, todo = {i}, [i]
            while todo:
                for y in linked[todo.pop()] - group:
                    group.add(y)
                    todo.append(y)
            out.update({x: (i, len(linked[x])) for x in group})
    return out


@pytest.mark.parametrize("block", [32 << 20, 4000, 700])
def test_linked_documents_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)  # small ones split families by buckets and into blocks
    base = [f"w{i}" for i in range(60)]
    text, near = " ".join(base), " ".join([*base[:-1], "other"])
    rng = random.Random(8)
    rows = near_rows(5, 25) + [(i, text) for i in (8000, 8001, 8005)] + [(i, near) for i in (8002, 8003)] + [(8004, "a b"), (8006, "A, b"), (8007, None), (8008, ""), (None, text)]
    for i in range(60):  # a family of unlike texts
        rows.append((9000 + i, " ".join(w if rng.random() > 0.04 else f"n{rng.randrange(999)}" for w in base)))
    want = brute_links(rows)
    found = ngram_join.linked_documents(docs(spark, rows))
    got = [tuple(r) for r in found.collect()]
    assert found.columns == ["doc_id", "class_id", "links"] and len({x[0] for x in got}) == len(got)
    assert {i: (c, n) for i, c, n in got} == want
    assert ngram_join.linked_documents(docs(spark, rows).limit(0)).count() == 0


def test_links_are_counted_in_blocks_as_in_one(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.1 else f"n{rng.randrange(999)}" for w in base)) for i in range(150)]
    one = {tuple(r) for r in ngram_join.linked_documents(docs(spark, rows)).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 20_000)
    assert {tuple(r) for r in ngram_join.linked_documents(docs(spark, rows)).collect()} == one and len(one) > 80
    pairs = [(r.doc_a, r.doc_b) for r in ngram_join.jaccard_pairs(docs(spark, rows)).collect()]
    assert len(set(pairs)) == len(pairs) and 2 * len(pairs) == sum(n for *_, n in one)


def test_ngram_join_repeated_ids_and_nothing(spark):
    rows = [(1, "one two three four"), (1, "one two three four five six"), (2, "one two three four five six")]
    assert [(r.doc_a, r.doc_b, r.jaccard) for r in ngram_join.jaccard_pairs(docs(spark, rows)).collect()] == [(1, 2, 1.0)]
    assert ngram_join.jaccard_pairs(docs(spark, rows).limit(0)).count() == 0
    assert ngram_join.one_of_each_group(docs(spark, rows).limit(0)).count() == 0


def test_short_texts_that_just_reach_the_threshold_are_all_linked(spark):
    rows = [(2 * k + more, f"a{k} b{k} c{k}" + f" d{k}" * more) for k in range(3000) for more in (0, 1)]
    got = {(r.doc_id, r.class_id, r.links) for r in ngram_join.linked_documents(docs(spark, rows)).collect()}
    assert got == {(i, i - i % 2, 1) for i, _ in rows}


def test_rows_that_share_an_id_link_by_the_ngrams_of_them_all(spark):
    rows = [(1, "p q r s"), (1, "t u v w x"), (3, "p q r s"), (4, "t u v w"), (5, "p q r s"), (5, "t u v w"), (5, None), (6, "t u v"), (6, "t u v")]
    got = {(r.doc_id, r.class_id, r.links) for r in ngram_join.linked_documents(docs(spark, rows)).collect()}
    assert got == {(1, 1, 1), (3, 1, 1), (4, 1, 2), (5, 1, 3), (6, 1, 1)}


def test_one_of_each_group_removes_rows_not_ids(spark):
    y, x = " ".join(f"y{i}" for i in range(30)), " ".join(f"x{i}" for i in range(9))
    rows = [(1, y), (2, y), (2, x), (3, x + " more"), (4, None), (None, y), (5, "single words here"), (5, "single words here")]
    kept = ngram_join.one_of_each_group(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    want = [(1, y), (2, x), (4, None), (None, y), (5, "single words here"), (5, "single words here")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_rtree_prunes_nothing_that_counts():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (300, ngram_join.GROUPS)).astype(np.int32)
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, (150, ngram_join.GROUPS)), 0)
    sizes = points.sum(1)
    for t in (0.5, 0.8, 0.9):
        found = [p for i, j in ngram_join.RTree(points, sizes).pairs(t) for p in zip(i.tolist(), j.tolist())]
        got = {(min(p), max(p)) for p in found}
        assert len(got) == len(found)
        over = np.minimum(points[:, None], points[None]).sum(2)
        may = over >= t / (1 + t) * (sizes[:, None] + sizes[None]) - 1e-9
        assert got == {(a, b) for a, b in zip(*np.nonzero(may)) if a < b}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in parent if find(x) != x}
    got = {(r.id, r.root) for r in ngram_join.components(spark.createDataFrame(pairs, "doc_a long, doc_b long")).collect()}
    assert got == want


def test_one_of_each_group(spark):
    rows = [(3, "p q r s t u v w"), (2, "p q r s t u v x"), (1, "other words in this text here"), (None, "p q r s t u v w"), (4, None)]
    kept = ngram_join.one_of_each_group(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 4]


def brute_spans(rows, words):
    from collections import Counter

    lists = [(i, WORD.findall(t.lower())) for i, t in rows if t is not None]
    count = Counter(" ".join(w[k : k + words]) for _, w in lists for k in range(len(w) - words + 1))
    hits = {}
    for i, w in lists:
        for k in range(len(w) - words + 1):
            n = count[" ".join(w[k : k + words])]
            if n > 1:
                hits.setdefault(i, {})[k] = max(n, hits.get(i, {}).get(k, 0))
    out = []
    for i, h in hits.items():
        span = None
        for k in sorted(h):
            if span and k <= span[1]:
                span = [span[0], k + words, max(span[2], h[k])]
                out[-1] = (i, *span)
            else:
                span = [k, k + words, h[k]]
                out.append((i, *span))
    return sorted(out, key=str)


def passage_rows(seed=5):
    rng = random.Random(seed)
    shared = [some_words(rng, rng.randrange(8, 60)) for _ in range(6)]
    rows = list(EDGE)
    for i in range(60):
        parts = [some_words(rng, rng.randrange(0, 30)) for _ in range(3)]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(3), rng.choice(shared).upper())
        rows.append((10 + i, "; ".join(parts)))
    rows += [rows[-1], (10, "z " * 80), (None, shared[0]), (None, shared[0])]
    return rows


@pytest.mark.parametrize("words", [3, 10, 50])
def test_spans_equal_brute_force(spark, words):
    rows = passage_rows()
    want = brute_spans(rows, words)
    df = docs(spark, rows).repartition(3)
    got = sorted(((r.doc_id, r.start_word, r.end_word, r.copies) for r in substring_dedup.repeated_passages(df, words).collect()), key=str)
    assert got == want
    spans = sorted(((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.duplicate_suffix_spans(df, words).collect()), key=str)
    assert spans == [w[:3] for w in want]


def test_spans_of_nothing(spark):
    for f in (substring_dedup.repeated_passages, suffix_dedup.duplicate_suffix_spans):
        assert f(docs(spark, EDGE).limit(0)).count() == 0
        assert f(docs(spark, [(1, "short"), (2, "short")])).count() == 0


def test_very_long_text(spark):
    rng = random.Random(6)
    long = some_words(rng, 300_000)
    rows = [(1, long), (2, " ".join(long.split()[200_000:200_060]))]
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.duplicate_suffix_spans(docs(spark, rows)).collect()}
    assert got == {(1, 200_000, 200_060), (2, 0, 60)}
    assert ngram_join.jaccard_pairs(docs(spark, rows)).count() == 0


def test_suffix_sort_is_a_suffix_sort():
    rng = np.random.default_rng(7)
    symbols = rng.integers(0, 3, 400).astype(np.uint64)
    stop = np.repeat([150, 150, 400], [100, 50, 250])
    s = suffix_dedup.Suffixes(symbols, np.arange(400), stop)
    o = s.sort(np.zeros(400, np.uint64))
    assert o.tolist() == sorted(range(400), key=lambda i: (symbols[i : stop[i]].tolist(), i))


def test_colliding_hashes_are_caught(monkeypatch):
    rng = random.Random(8)
    strings = [some_words(rng, 12).encode() for _ in range(5)]
    strings.append(strings[0][strings[0].index(b" ") + 1 :] + b" tail0")
    times = np.ones(6, np.int64)
    want, _ = substring_dedup.count_windows(strings, times, 10)
    assert want.max() == 2
    for module, f in ((substring_dedup, substring_dedup.count_windows), (suffix_dedup, suffix_dedup.repeats)):
        monkeypatch.setattr(module, "word_hashes", lambda data, s, e, seed=1: np.ones(len(s), np.uint64))
        assert f(strings, times, 10)[0].tolist() == want.tolist()


def test_kernels_equal_plain_python():
    texts = ["Über x-y", "", "a b c", " lead", "tail ", "é漢", "ab" * 30]
    import pyarrow as pa

    data, offs = textkernel.string_buffers(pa.array([t.lower() for t in texts]))
    starts, ends, first = textkernel.word_bounds(data, offs)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [WORD.findall(t.lower()) for t in texts]
    flat, s, e, f = textkernel.normalise(data, offs)
    assert flat.tobytes().decode().split() == [w for g in got for w in g] and np.array_equal(f, first)
    x = np.random.default_rng(9).integers(0, 99, 50)
    for w in (1, 2, 7, 43):
        assert textkernel.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]


def test_superkmers_carry_every_window_once():
    import pyarrow as pa

    rng = random.Random(10)
    texts = [some_words(rng, n).lower() for n in (200, 49, 50, 0, 120)]
    meta, strings = superkmers.split(pa.array(texts), np.arange(5), 50)
    got = sorted((int(m["doc"]), int(m["at"]) + k) for m, s in zip(meta, strings) for k in range(len(s.split()) - 49))
    assert got == [(d, k) for d, t in enumerate(texts) for k in range(len(t.split()) - 49)]
    assert all(" ".join(texts[m["doc"]].split()[m["at"] :]).encode().startswith(s) for m, s in zip(meta, strings))
