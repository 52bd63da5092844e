import random
import time

import numpy as np
import pyarrow as pa

from loomgraph.llm.common import word_hashes
from loomgraph.llm.decontaminate import Index, drop_contaminated, edit_distance, find_contamination, limits, op8_benchmark_decontamination, span_distance

from .helpers import CLASHING, SCHEMA, frame, rows, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y or x is None), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(texts, items, ratio=0.2):
    """(doc, item): distance of the best window of the item's length, padded at the ends."""
    split = lambda t: word_hashes(pa.array([t or ""]))[0].tolist()
    found = {}
    for d, t in enumerate(texts):
        a = split(t)
        for i, x in enumerate(items):
            b = split(x)
            if not b or not a:
                continue
            limit = limits(len(b), ratio)[0]
            best = min(distance([a[k] if 0 <= k < len(a) else None for k in range(s, s + len(b))], b) for s in range(-limit, max(1, len(a))))
            if best <= limit:
                found[d, i] = best
    return found


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        p = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[p] = f"new{rng.randrange(99)}"
        elif kind == 1:
            out.insert(p, f"ins{rng.randrange(99)}")
        else:
            del out[p]
    return out


def test_edit_distance():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (60, 9)).astype(np.uint64), rng.integers(1, 4, (60, 9)).astype(np.uint64)
    m = rng.integers(1, 10, 60)
    want = [distance([int(x) or None for x in p[:n]], [int(x) for x in q[:n]]) for p, q, n in zip(a, b, m)]
    assert edit_distance(a, b, m).tolist() == want


def test_recall_at_the_distance_limit():
    rng = random.Random(5)
    for m in (10, 25, 40, 90):
        base = [words(rng, m, 3000) for _ in range(150)]
        near = [(edited(rng, w, limits(m, 0.2)[0]) + words(rng, m, 3000))[:m] for w in base]
        h = lambda lists: np.stack([word_hashes(pa.array([" ".join(x)]))[0] for x in lists])
        a, b, sizes = h(near), h(base), np.full(150, m)
        index = Index([(i, x) for i, x in enumerate(b)], 0.2, 4, 24)
        close = edit_distance(a, b, sizes) <= limits(m, 0.2)[0]
        hit = (index.buckets(a, sizes) == index.buckets(b, sizes)).any(axis=0)
        assert close.sum() > 30 and hit[close].mean() >= 0.95


def corpus(rng):
    items = [" ".join(words(rng, rng.randrange(8, 30), 2000)) for _ in range(12)]
    texts = []
    for k in range(60):
        body = words(rng, rng.randrange(0, 60), 2000)
        if k % 3:
            item = items[k % 12].split()
            at = rng.randrange(len(body) + 1)
            body[at:at] = edited(rng, item, rng.randrange(0, limits(len(item), 0.2)[0] + 2))
        texts.append(" ".join(body))
    return texts, items


def test_against_brute_force(spark):
    texts, items = corpus(random.Random(8))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, texts, **CLASHING)
    got = {(r.doc_id, r.item_id): r.distance for r in find_contamination(df, bench).collect()}
    want = brute(texts, items)
    assert all(want.get(k) is not None and want[k] <= d for k, d in got.items())
    assert len(got) >= 0.95 * len(want) and len(want) > 20
    clean = drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}
    parts = {(r.doc_id, r.item_id): r.distance for r in find_contamination(df, bench, index_grams=40).collect()}
    assert {k for k in want} >= set(parts) and len(parts) >= 0.95 * len(want)


def test_case_and_punctuation_do_not_hide(spark):
    bench = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    df = frame(spark, ["x ONE, two; three! four five... SIX y", "one two three"])
    assert rows(find_contamination(df, bench), "doc_id", "item_id", "distance", "start") == [(0, 7, 0, 1)]


def test_nulls_empty_long_ties_and_repeats(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (1, item), (2, ""), (None, item), (3, None)], "item_id long, text string")
    df = frame(spark, [None, "", item, (2, item), (None, item), "x " * 60_000 + item, item + " " + item])
    got = rows(find_contamination(df, bench), "doc_id", "item_id", "start", "distance")
    assert got == sorted([(2, 1, 0, 0)] * 4 + [(None, 1, 0, 0)] * 2 + [(5, 1, 60_000, 0)] * 2 + [(6, 1, 0, 0)] * 2, key=repr)
    assert rows(drop_contaminated(df, bench), "doc_id") == [(0,), (1,)]
    assert find_contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    none = bench.limit(0)
    assert find_contamination(df, none).count() == 0 and drop_contaminated(df, none).count() == df.count()


def test_query_finds_whole_items(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(map(str, word_hashes(pa.array([t]))[0].tolist())) + " "
    texts = {d: flat(t) for d, t in docs}
    want = {(d, i) for i, x in items for d, t in texts.items() if flat(x) in t}
    assert want and want <= {(r.doc_id, r.item_id) for r in op8_benchmark_decontamination(spark, sf_dir).collect()}


def best_span(a, b):
    """The distance of b to the span of a that is nearest to it, of any length."""
    row = [0] * (len(a) + 1)
    for i, y in enumerate(b, 1):
        new = [i]
        for j, x in enumerate(a, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_span_distance():
    rng = np.random.default_rng(1)
    a, b, m = rng.integers(0, 4, (80, 14)).astype(np.uint64), rng.integers(1, 4, (80, 9)).astype(np.uint64), rng.integers(1, 10, 80)
    d, start = span_distance(a, b, m)
    for p, q, n, x, s in zip(a.tolist(), b.tolist(), m, d, start):
        p, q = [v or None for v in p], q[:n]
        assert x == best_span(p, q) and min(distance(p[s:e], q) for e in range(s, 15)) == x
        assert all(distance(p[k:e], q) > x for k in range(s) for e in range(k, 15))


def test_insertions_against_free_spans(spark):
    rng = random.Random(31)
    items = [words(rng, m, 3000) for m in (10, 15, 30, 45, 60) for _ in range(6)]
    texts = []
    for k in range(180):
        item = items[k % 30]
        t = limits(len(item), 0.2)[0]
        out = list(item)
        for _ in range(rng.randrange(t // 2, t + 2)):
            if k % 4 == 3:
                del out[rng.randrange(len(out))]
            else:
                out.insert(rng.randrange(1, len(out)), f"ins{rng.randrange(999)}")
        texts.append(" ".join(words(rng, rng.randrange(0, 40), 3000) + out + words(rng, rng.randrange(0, 40), 3000)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    split = lambda t: word_hashes(pa.array([t]))[0].tolist()
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            if (best := best_span(split(t), split(" ".join(x)))) <= limits(len(x), 0.2)[0]:
                want[d, i] = best
    df = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r.distance for r in find_contamination(df, bench, free_spans=True).collect()}
    assert len(want) > 120 and all(want.get(k) == d for k, d in got.items())
    assert len(got) >= 0.98 * len(want)
    clean = {r.doc_id for r in drop_contaminated(df, bench, free_spans=True).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}
    assert len(find_contamination(df, bench).collect()) < 0.8 * len(want)  # windows of m words lose them


def test_items_without_id_still_filter(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    df = frame(spark, ["x one two three four five six", "alpha beta gamma delta epsilon zeta y", "neither"])
    assert rows(find_contamination(df, bench), "doc_id", "item_id") == [(0, 1)]
    for free in (False, True):
        assert rows(drop_contaminated(df, bench, free_spans=free), "doc_id") == [(2,)]


def test_long_items_and_short_ones_in_one_index(spark):
    rng = random.Random(4)
    sizes = (8, 30, 500, 3000, 10_000)
    items = [words(rng, m, 20_000) for m in sizes]
    held = [(i, h) for i, h in enumerate(word_hashes(pa.array([" ".join(x)]))[0] for x in items)]
    noise = lambda n: words(rng, n, 20_000)
    texts = [" ".join(noise(300) + x + noise(300)) for x in items] + [" ".join(noise(50) + edited(rng, " ".join(x).split(), len(x) // 10) + noise(50)) for x in items] + [" ".join(noise(12_000))]
    began = time.process_time()
    index = Index(held, 0.2, 4, 24)
    built = time.process_time() - began
    for k, t in enumerate(texts):
        h, o = word_hashes(pa.array([t]))
        began = time.process_time()
        got = index.search(h, o, True)
        assert time.process_time() - began + built < 30
        got = [(index.ids[i], s, d) for _, i, s, d in got.tolist()]
        if k < 5:
            assert got == [(k, 300, 0)]
        elif k < 10:
            assert [g[0] for g in got] == [k - 5] and got[0][2] <= sizes[k - 5] // 10
        else:
            assert got == []
    h, o = word_hashes(pa.array(texts))  # all at once
    assert [(r, index.ids[i]) for r, i, _, _ in index.search(h, o, True).tolist()] == [(k, k % 5) for k in range(10)]


def test_ids_of_items_and_documents_may_be_text(spark):
    bench = spark.createDataFrame([("x-1", "one two three four five six"), (None, "seven eight nine ten eleven twelve")], "item_id string, text string")
    df = frame(spark, ["so one two three four five six", "seven eight nine ten eleven twelve", "neither"]).selectExpr("concat('d', doc_id) doc_id", "text")
    for free in (False, True):
        assert rows(find_contamination(df, bench, free_spans=free), "doc_id", "item_id") == [("d0", "x-1")]
        assert rows(drop_contaminated(df, bench, free_spans=free), "doc_id") == [("d2",)]


def test_parts_give_what_one_index_gives(spark):
    texts, items = corpus(random.Random(18))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, texts)
    whole = rows(find_contamination(df, bench, free_spans=True), "doc_id", "item_id", "distance")
    assert whole == rows(find_contamination(df, bench, free_spans=True, index_grams=60), "doc_id", "item_id", "distance") and len(whole) > 20
    assert rows(drop_contaminated(df, bench, free_spans=True), "doc_id") == rows(drop_contaminated(df, bench, free_spans=True, index_grams=60), "doc_id")


def test_whole_query_against_free_spans(spark, sf_dir):
    """Every pair of the tables by dynamic programming; short documents, as the plain version is slow."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    split = lambda t: word_hashes(pa.array([t or ""]))[0]
    want = set()
    for d, t in docs:
        a = split(t)
        known = set(a.tolist())
        for i, x in items:
            b = split(x)
            limit = limits(len(b), 0.2)[0]
            if len(a) and sum(w in known for w in b.tolist()) >= len(b) - limit and span_distance(a[None, :], b[None, :], np.array([len(b)]))[0][0] <= limit:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in op8_benchmark_decontamination(spark, sf_dir).collect()}
    assert want and got <= want and len(got) >= 0.98 * len(want)
