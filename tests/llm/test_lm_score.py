import math
import random
from collections import Counter

from loomgraph.llm.common import WORD_RE
from loomgraph.llm.lm_score import ALPHA, op10_lm_score, scores

from .helpers import CLASHING, SCHEMA, frame, words


def brute(pairs, order=3, min_count=2):
    split = [WORD_RE.findall((t or "").lower()) for _, t in pairs]
    count = Counter(tuple(w[i : i + n]) for w in split for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, split))
    out = []
    for (d, _), w in zip(pairs, split):
        s = 0.0
        for i in range(len(w)):
            n = min(order, i + 1)
            back = 0
            while n > 1 and count[tuple(w[i - n + 1 : i + 1])] < min_count:
                n, back = n - 1, back + 1
            whole = count[tuple(w[i - n + 1 : i + 1])]
            s += back * math.log(ALPHA) + math.log(whole / (count[tuple(w[i - n + 1 : i])] if n > 1 else total))
        out.append((d, len(w), round(s, 6) if w else None))
    return sorted(out, key=repr)


def check(df, pairs, **options):
    got = sorted(((r.doc_id, r.n_words, None if r.score is None else round(r.score, 6)) for r in scores(df, **options).collect()), key=repr)
    want = brute(pairs, options.get("order", 3), options.get("min_count", 2))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(x == y or abs(x - y) < 1e-5 for (_, _, x), (_, _, y) in zip(got, want))


def test_against_brute_force(spark):
    rng = random.Random(1)
    pairs = [(i, " ".join(words(rng, rng.randrange(0, 80), 40))) for i in range(60)]
    df = frame(spark, pairs, **CLASHING)
    for options in ({}, {"order": 2}, {"order": 1}, {"order": 4, "min_count": 3}, {"chunk_bytes": 500}):
        check(df, pairs, **options)


def test_nulls_empty_long_ties_and_repeats(spark):
    pairs = [(1, None), (2, ""), (3, "a"), (4, "a b"), (4, "a b"), (None, "a b c"), (None, "a b c"), (7, "z " * 50_000)]
    check(frame(spark, pairs), pairs)
    assert scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_whole_table(spark, sf_dir):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.score) for r in op10_lm_score(spark, sf_dir).collect())
    want = sorted(brute(pairs))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, want) if b[2] is not None)
