import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.llm.exact_dedup import NAME, drop_exact_copies, exact_dedup, identities, op4_exact_dedup

from .helpers import CLASHING, SCHEMA, frame, rows


def brute(pairs):
    """keep_doc_id and number of different texts by comparing whole texts."""
    by = defaultdict(list)
    for i, t in pairs:
        if t is not None:
            by[t].append(i)
    return {t: min((i for i in ids if i is not None), default=None) for t, ids in by.items()}


def check(spark, pairs, block=5):
    df = frame(spark, pairs)
    got = exact_dedup(df, block=block).collect()
    keep = brute(pairs)
    assert len(got) == len(pairs)
    assert len({r.identity for r in got if r.identity is not None}) == len(keep)
    assert sum(r.keep for r in got if r.identity is not None) == len(keep)
    by_id = dict(pairs)
    for r in got:
        if r.identity is not None and r.doc_id is not None and list(dict(pairs)).count(r.doc_id) == 1 and sum(i == r.doc_id for i, _ in pairs) == 1:
            assert r.keep_doc_id == keep[by_id[r.doc_id]]
    left = drop_exact_copies(df, block=block)
    assert left.columns == df.columns
    assert sorted(repr(r.text) for r in left.collect()) == sorted([repr(t) for t in keep] + ["None"] * sum(t is None for _, t in pairs))


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    check(spark, [(i, rng.choice(base)) for i in range(200)])


def test_nulls_empty_long_and_repeated_rows(spark):
    long = "xyz" * 50_000
    check(spark, [(3, None), (4, None), (5, ""), (6, ""), (7, long), (8, long + "!"), (9, long), (None, "a"), (None, "a"), (2, "a"), (2, "a"), (2, "b"), (11, "a\nb"), (12, "a\nb")], block=4096)


def test_identities_do_not_depend_on_partitions(spark):
    texts = [f"text {i % 7} " * (i % 5) for i in range(40)]
    one = rows(exact_dedup(frame(spark, texts).repartition(1), block=8), "doc_id", "identity")
    assert one == rows(exact_dedup(frame(spark, texts).repartition(5), block=8), "doc_id", "identity")


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0
    df = frame(spark, ["a", "a", "b"], **CLASHING)
    out = drop_exact_copies(df)
    assert out.columns == df.columns and rows(out, "doc_id", "text") == [(0, "a"), (2, "b")]
    assert exact_dedup(df).columns == ["doc_id", "identity", "keep_doc_id", "keep"]


def test_query_against_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op4_exact_dedup(spark, sf_dir).collect()
    keep = brute([(r.doc_id, r.text) for r in docs.collect()])
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.keep_doc_id == keep[text[r.doc_id]] for r in got) and len(got) == len(text)


def test_blocks_of_one_hash_are_told_apart(spark):
    """Three hashes for all blocks: nearly all of them collide."""
    rng = random.Random(6)
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 30))) for _ in range(25)] + ["same"]
    pairs = [(i, rng.choice(base)) for i in range(80)]
    found = identities(frame(spark, pairs), block=4, block_hash=lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("long"))
    got = defaultdict(set)
    for r in found.collect():
        got[r[NAME]].add(dict(pairs)[r["__lg_id"]])
    assert all(len(texts) == 1 for texts in got.values()) and len(got) == len({t for _, t in pairs})


def test_of_rows_with_one_id_and_text_the_same_stays_each_time(spark):
    df = frame(spark, [(7, "twice")] * 12 + [(8, "once")]).selectExpr("doc_id", "text", "cast(spark_partition_id() * 0 + rand(3) * 1e6 as long) extra").cache()
    one = rows(drop_exact_copies(df.repartition(1)), "doc_id", "text", "extra")
    assert len(one) == 2 and one == rows(drop_exact_copies(df.repartition(5)), "doc_id", "text", "extra")
    df.unpersist()
