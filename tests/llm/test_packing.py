import random
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm.common import word_hashes
from loomgraph.llm.packing import op2_best_fit_packing, pack, plan

from .helpers import CLASHING, SCHEMA, frame


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time: how full the bins are.  Which of equally full bins a piece
    goes to changes what is with what, but not this."""
    free, bins = [], []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            bins[i].append(n)
            free[i] -= n
        else:
            bins.append([n])
            free.append(capacity - n)
    return Counter(sum(b) for b in bins)


def bins_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.bin_id].append(r)
    for b in by.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
    return Counter(sum(r.length for r in b) for b in by.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 50))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    made = defaultdict(list)
    taken = Counter()
    for length, lo, hi, first, each, _ in plan(Counter(lengths), capacity):
        for rank in range(lo, hi + 1):
            made[first + (rank - lo) // each].append(length)
            taken[length] += 1
    assert taken == Counter(lengths)
    assert Counter(sum(b) for b in made.values()) == best_fit(lengths, capacity)


def check(spark, df, capacity):
    got = pack(df, capacity).collect()
    want = []
    pieces = Counter()
    for r in df.collect():
        n = len(word_hashes(pa.array([r.text or ""]))[0])
        for start in range(0, n, capacity):
            want.append(min(capacity, n - start))
            pieces[r.doc_id, start, want[-1]] += 1
    assert Counter((r.doc_id, r.start, r.length) for r in got) == pieces
    assert bins_of(got) == best_fit(want, capacity)


def test_against_brute_force(spark):
    rng = random.Random(2)
    check(spark, frame(spark, ["w " * rng.randrange(0, 70) for _ in range(150)], **CLASHING), 32)


def test_nulls_empty_ties_and_repeats(spark):
    check(spark, frame(spark, [None, "", "...", "a", "a", (1, "a b"), (1, "a b"), (None, "a b c"), (None, "a b c"), "a " * 33, "a " * 32]), 8)
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, docs, 2048)
    assert op2_best_fit_packing(spark, sf_dir).count() == pack(docs, 2048).count()
