import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from loomgraph.llm.common import word_hashes
from loomgraph.llm.near_dedup import SHINGLE, THRESHOLD, components, connect, drop_near_copies, near_groups, op9_minhash_near_dedup, samples, shingles, signatures, similarity
from loomgraph.llm.lm_score import _unpack

from .helpers import CLASHING, SCHEMA, frame, rows, words


def brute(texts):
    """Groups of documents by comparing all pairs; document frequencies by counting all of them."""
    sets = []
    for t in texts:
        h = word_hashes(pa.array([t or ""]))[0].tolist()
        sets.append(Counter(tuple(h[i : i + SHINGLE]) for i in range(max(1, len(h) - SHINGLE + 1))) if h else Counter())
    df = Counter(s for x in sets for s in x)
    n = sum(t is not None for t in texts)
    idf = {s: max(np.log(n / c), 0.01) for s, c in df.items()}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {}
    for i in range(len(texts)):
        for j in range(i):
            both = sets[i].keys() | sets[j].keys()
            low = sum(min(sets[i][s], sets[j][s]) * idf[s] for s in both)
            high = sum(max(sets[i][s], sets[j][s]) * idf[s] for s in both)
            if sets[i] and sets[j] and low / high >= THRESHOLD:
                pairs[j, i] = low / high
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    return {i: g[0] for g in groups.values() if len(g) > 1 for i in g}, pairs


def corpus(rng, n=120):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(int(len(w) * rng.choice((0, 0.01, 0.04, 0.3)))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        else:
            w = words(rng, rng.randrange(30, 150), 5000)
        out.append(" ".join(w))
    return out


def test_groups_against_brute_force(spark):
    texts = corpus(random.Random(4))
    df = frame(spark, texts, **CLASHING)
    got = {r.doc_id: r.keep_doc_id for r in near_groups(df).collect()}
    want, _ = brute(texts)
    right = sum(got.get(i) == k for i, k in want.items())
    assert len(want) > 40 and set(got) <= set(want) and right >= 0.95 * len(want)
    left = {r.doc_id for r in drop_near_copies(df).collect()}
    assert left == set(range(len(texts))) - {i for i, k in got.items() if i != k}
    assert drop_near_copies(df).columns == df.columns


def test_samples_collide_with_the_similarity():
    rng = np.random.default_rng(0)
    for overlap in (40, 80):
        g = np.sort(rng.integers(0, 1 << 63, 120).astype(np.uint64))
        w = rng.gamma(2.0, size=120)
        a, b = np.arange(100), np.arange(100 - overlap, 120) if overlap > 80 else np.arange(100 - overlap, 120)
        s = similarity(g[a], w[a], g[b], w[b] * 1.3)
        k = 2000
        x = samples(np.zeros(len(a), dtype=np.int64), g[a], w[a], 1, k)
        y = samples(np.zeros(len(b), dtype=np.int64), g[b], w[b] * 1.3, 1, k)
        assert abs((x == y).mean() - s) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 60), (61, 60), (100, 3)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {i: 0 for i in range(21)} | {100: 0, 50: 50, 60: 50, 61: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_empty_ties_repeats_and_long_texts(spark):
    long = " ".join(f"v{i}" for i in range(40_000))
    df = frame(spark, [None, None, "", "", "...", "one", "one", (9, "x y z"), (9, "x y z"), (None, "x y z"), (10, long), (11, long + " more")])
    got = rows(near_groups(df), "doc_id", "keep_doc_id", "keep")
    assert got == sorted([(5, 5, True), (6, 5, False), (9, 9, True), (9, 9, True), (None, 9, False), (10, 10, True), (11, 10, False)], key=repr)
    assert sorted(repr(r.doc_id) for r in drop_near_copies(df).collect()) == sorted(map(repr, [0, 1, 2, 3, 4, 5, 9, 9, 10]))
    empty = spark.createDataFrame([], SCHEMA)
    assert near_groups(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_query_against_whole_table(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, _ = brute([t for _, t in docs])
    want = {docs[i][0]: docs[k][0] for i, k in want.items() if i != k}
    got = {r.doc_id: r.keep_doc_id for r in op9_minhash_near_dedup(spark, sf_dir).collect()}
    assert set(got) <= set(want) and sum(got.get(i) == k for i, k in want.items()) >= 0.9 * len(want)


def test_frequencies_of_all_shingles_over_chunks(spark):
    texts = corpus(random.Random(6), 40) + ["one", "", "one"]
    slim = frame(spark, texts).selectExpr("doc_id as node", "text").where("text != ''")
    got = {r.node: _unpack(r.df) + 1 for r in signatures(slim, 43, 20_000, 2, 12, 4, 1000).collect()}
    sets = [shingles(pa.array([t]), 2)[1].tolist() for t in texts]
    count = Counter(g for x in sets for g in x)
    assert {k: v.tolist() for k, v in got.items()} == {i: [count[g] for g in x] for i, x in enumerate(sets) if x}


def test_passages_of_few_documents_weigh_less_than_unique_text(spark):
    """Above 1,000 documents, where a passage of N / 1000 documents would weigh as unique text."""
    texts, n = [], 3000
    for p in range(8):
        passage = [f"p{p}x{i}" for i in range(85)]
        texts += [" ".join(passage + [f"own{p}a{d}x{i}" for i in range(16)]) for d in range(2)]
        texts.append(" ".join(passage + [f"own{p}bx{i}" for i in range(400)]))
    same = [f"s{i}" for i in range(100)]
    texts += [" ".join(same), " ".join(same + ["more"])]
    texts += [f"f{i} g{i} h{i}" for i in range(n - len(texts))]
    shared, own = 84 * np.log(n / 3), 16 * np.log(n)
    assert shared / (shared + 2 * own) < THRESHOLD < 84 / (84 + 2 * 16)
    assert rows(near_groups(frame(spark, texts)), "doc_id", "keep_doc_id") == [(24, 24), (25, 24)]


def test_connect_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        vectors = []
        for _ in range(12):
            keep = np.flatnonzero(rng.random(30) < rng.choice((0.5, 0.9)))
            vectors.append((keep.astype(np.uint64), np.ones(len(keep)) + (keep % 3)))
        roots = rng.integers(0, 9, 12).tolist()
        parent = list(range(12))
        for i in range(12):
            for j in range(i):
                if roots[i] == roots[j] or similarity(*vectors[i], *vectors[j]) >= 0.7:
                    parent = [parent[j] if p == parent[i] else p for p in parent]
        got = list(range(12))
        for i in range(12):
            for j in range(i):
                if roots[i] == roots[j]:
                    got = [got[j] if p == got[i] else p for p in got]
        for a, b in connect(vectors, roots, 0.7):
            assert got[a] != got[b]
            got = [got[a] if p == got[b] else p for p in got]
        same = lambda x: [[p == q for q in x] for p in x]
        assert same(got) == same(parent)


def test_large_buckets_are_divided_without_loss(spark):
    """Cells of three documents: buckets of many blocks, of which some have several groups."""
    rng = random.Random(12)
    texts = corpus(rng, 60)
    shared = words(rng, 60, 5000)
    texts += [" ".join(shared + words(rng, 4, 5000)) for _ in range(40)] + [texts[3]] * 15
    df = frame(spark, texts)
    columns = ("doc_id", "keep_doc_id", "keep")
    assert rows(near_groups(df, cell=3), *columns) == rows(near_groups(df), *columns)
    df = frame(spark, [" ".join(f"c{i}" for i in range(80)) + f" own{k % 7} {k}" for k in range(50)] + ["x " * 5] * 4 + [f"f{i} g{i} h{i}" for i in range(250)])
    assert rows(near_groups(df, cell=2), *columns) == sorted([(k, 0, k == 0) for k in range(50)] + [(k, 50, k == 50) for k in range(50, 54)], key=repr)
