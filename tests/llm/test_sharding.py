from collections import Counter, defaultdict

from loomgraph.llm.sharding import ROW_BYTES, op7_sharding, shard

from .helpers import CLASHING, SCHEMA, frame


def check(df, bytes_, **options):
    out = shard(df, shard_bytes=bytes_, **options)
    got = out.collect()
    names = [c for c in df.columns if c != "shard"]
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(tuple(r[c] for c in names) for r in df.collect())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.source or "", r.doc_id if r.doc_id is not None else -(2**63) + 1))
    ranges = [(min(v), max(v)) for _, v in sorted(by.items())]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))  # shards are ranges of the order
    size = Counter()
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + ROW_BYTES
    return size


def test_hot_key_is_subdivided(spark):
    texts = [(i, "x" * (50 + i * 37 % 200)) for i in range(3000)]
    df = frame(spark, texts).selectExpr("doc_id", "text", "lang", "if(doc_id % 10 < 8, 'hot', concat('s', doc_id % 7)) source", "n_chars")
    size = check(df, 20_000)
    assert max(size.values()) <= 20_000 * 1.25 + 300
    assert len(size) > 15


def test_nulls_repeats_and_clashing_columns(spark):
    df = frame(spark, [(None, None), (None, None), (1, ""), (1, ""), (2, "y" * 5000), (3, "z")] * 20, **CLASHING)
    df = df.selectExpr("* except (source)", "if(doc_id = 3, null, source) source")
    check(df, 2000)
    assert check(df, 1 << 30).keys() == {0}
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_partition_a_shard(spark):
    df = frame(spark, [(i, "t" * 100) for i in range(500)])
    got = shard(df, shard_bytes=5000).selectExpr("shard", "spark_partition_id() p").distinct().collect()
    assert len({r.shard for r in got}) == len(got) == len({r.p for r in got}) > 5


def test_query_keeps_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = op7_sharding(spark, sf_dir)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "shard"]
    check(docs, 30_000)


def test_ids_that_are_no_numbers(spark):
    df = frame(spark, [(i, "x" * (50 + i % 90)) for i in range(1500)]).selectExpr("if(doc_id % 50 = 0, null, concat('id-', doc_id)) doc_id", "text", "lang", "if(doc_id % 3 = 0, 'hot', source) source", "n_chars")
    out = shard(df, shard_bytes=8000).collect()
    assert Counter(tuple(r)[:-1] for r in out) == Counter(tuple(r) for r in df.collect())
    by = defaultdict(list)
    for r in out:
        by[r.shard].append((r.source, r.doc_id or ""))
    ranges = [(min(v), max(v)) for _, v in sorted(by.items())]
    assert len(ranges) > 15 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_rounds_go_on_until_nothing_can_be_divided(spark):
    """Two pieces a round and a sample of a record or two: far more rounds than a limit would allow; and one record as large as all others."""
    df = frame(spark, [(0, "h" * 40_000)] + [(i, "x" * 100) for i in range(1, 70)]).selectExpr("doc_id", "text", "lang", "'one' source", "n_chars")
    size = check(df, 1000, fan_out=2, oversample=1)
    assert sorted(size.values())[-2:] == [sorted(size.values())[-2], 40_000 + ROW_BYTES] and sorted(size.values())[-2] <= 1250


def test_against_a_brute_force_search_of_the_cuts(spark):
    import random

    import pyarrow as pa

    from loomgraph.llm.sharding import Cuts

    rng = random.Random(2)
    for kind in (lambda: rng.randrange(4), lambda: rng.choice(["", "=a", "=b", "=é"])):
        cuts = sorted({(rng.choice("abc"), kind(), rng.randrange(3)) for _ in range(12)})
        found = [(rng.choice("abcd"), kind(), rng.randrange(3)) for _ in range(300)]
        got = Cuts(cuts).numbers(*(pa.array(x) for x in zip(*found)))
        assert got.tolist() == [sum(c <= x for c in cuts) for x in found]
