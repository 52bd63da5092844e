import random
from collections import Counter

import numpy as np

from loomgraph.llm.common import WORD_RE
from loomgraph.llm.suffix_dedup import multikey_sort, repeated, op6_suffix_array_dedup, repeated_spans

from .helpers import CLASHING, SCHEMA, frame, words


def brute(pairs, n):
    """Maximal spans of windows of n words that occur twice in the rows."""
    split = [WORD_RE.findall((t or "").lower()) for _, t in pairs]
    count = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = set()
    for (d, _), w in zip(pairs, split):
        start = finish = None
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                if finish is not None and i <= finish:
                    finish = i + n
                else:
                    if finish is not None:
                        out.add((d, start, finish))
                    start, finish = i, i + n
        if finish is not None:
            out.add((d, start, finish))
    return out


def check(spark, pairs, **extra):
    got = {tuple(r) for r in repeated_spans(frame(spark, pairs, **extra), min_words=20, window=6).collect()}
    assert got == brute(pairs, 20)
    return got


def test_multikey_sort():
    rng = np.random.default_rng(1)
    words_ = rng.integers(0, 3, (200, 7)).astype(np.uint32)
    order, lcp = multikey_sort(words_)
    s = [tuple(x) for x in words_[order]]
    assert s == sorted(s)
    want = [0] + [next((k for k in range(7) if a[k] != b[k]), 7) for a, b in zip(s, s[1:])]
    assert lcp.tolist() == want


def test_against_brute_force(spark):
    rng = random.Random(9)
    passages = [words(rng, rng.randrange(15, 50), 3000) for _ in range(12)]
    pairs = []
    for i in range(80):
        w = words(rng, rng.randrange(0, 60), 3000)
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:]
        pairs.append((i, " ".join(w)))
    assert len(check(spark, pairs, **CLASHING)) > 40


def test_thresholds_are_exact(spark):
    rng = random.Random(2)
    p = words(rng, 20, 10**6)
    texts = [(1, " ".join(["a1", *p, "a2"])), (2, " ".join(["b1", *p, "b2"])), (3, " ".join(p[1:] + ["c"]))]
    assert check(spark, texts) == {(1, 1, 21), (2, 1, 21)}


def test_repeats_within_a_document_and_periods(spark):
    rng = random.Random(3)
    line = words(rng, 7, 10**6)
    check(spark, [(1, " ".join(line * 9)), (2, "the " * 100), (3, " ".join(words(rng, 60, 10**6)))])


def test_nulls_empty_short_long_and_repeated_rows(spark):
    rng = random.Random(4)
    long = " ".join(words(rng, 30_000, 10**7))
    text = " ".join(words(rng, 30, 10**6))
    check(spark, [(1, None), (2, ""), (3, "a b"), (4, long), (5, long), (6, text), (6, text)])
    got = [tuple(r) for r in repeated_spans(frame(spark, [(None, text), (None, text)]), min_words=20, window=6).collect()]
    assert got == [(None, 0, 30)]
    assert repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_whole_table(spark, sf_dir):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(pairs, 50)
    assert want and {tuple(r) for r in op6_suffix_array_dedup(spark, sf_dir).collect()} == want


def test_the_two_orders_decide_as_all_windows_do():
    rng = np.random.default_rng(5)
    n, window, some = 9, 4, 0
    for _ in range(200):
        words_ = rng.integers(1, 3, (25, n + window - 1)).astype(np.uint32)
        for row in words_:  # texts that end, and texts that begin
            row[n - rng.integers(0, n) : n] = 0
            row[n : n + rng.integers(0, window)] = 0
        copies = rng.integers(1, 3, 25)
        copies[rng.random(25) < 0.8] = 1
        count = Counter()
        texts = [tuple(r[n:]) + tuple(r[:n]) for r in words_.tolist()]
        for t, c in zip(texts, copies.tolist()):
            for d in range(window):
                count[d, t[window - 1 - d :][:n]] += c
        want = {}
        for i, t in enumerate(texts):
            ds = [d for d in range(window) if 0 not in (x := t[window - 1 - d :][:n]) and count[d, x] > 1]
            if ds:
                want[i] = (ds[0], ds[-1])
        record, least, most = repeated(words_, copies, n, window)
        assert {i: (a, b) for i, a, b in zip(record.tolist(), least.tolist(), most.tolist())} == want
        some += len(want)
    assert some > 100


def test_records_are_folded_and_tasks_agree(spark):
    rng = random.Random(8)
    passage, other = words(rng, 40, 10**6), words(rng, 30, 10**6)
    pairs = [(i, " ".join(words(rng, i % 9, 10**6) + passage + words(rng, i % 5, 10**6))) for i in range(150)] + [(200 + i, " ".join(other[i:])) for i in range(9)]
    want = brute(pairs, 20)
    for parts in (1, 7):
        got = [tuple(r) for r in repeated_spans(frame(spark, pairs).repartition(parts), min_words=20, window=6).collect()]
        assert set(got) == want and len(got) == len(want)
