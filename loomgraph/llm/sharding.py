"""Sharding by sampled splitters.

Records are range-partitioned on (key, doc_id, hash of the text).  A range that is too large is cut at quantiles of a
sample in which a record is drawn with a probability in proportion to its size, so that the
pieces have about the same number of bytes.  A range of several keys is cut between keys; one of a single key, as when one key
holds a third of the data, is cut on the whole order.  Ranges are measured and cut again until none is
too large or can't be divided any more, however many rounds that takes.  Where a sample gives no new splitter
(one huge record), the range is cut behind its first key, or its first record, which is exact.

Rounds read a narrow checkpoint (key, id, hash, size) and not the texts.  A round cuts a range into at most
`fan_out` pieces, from a sample of about `oversample` x `fan_out` records, which is gathered and sorted on the executors, a
task for each range.  The driver holds and sends one splitter and one size a shard, which is less than what
Spark itself keeps there for a shuffle of that many partitions.  Draws depend on hashes of the record, so a lost task draws
the same records again.

Defined results: a null key sorts with the empty one, ids that aren't whole numbers are ordered as text, a null
id comes before others, a null text has size `ROW_BYTES` like an empty one, repeated rows that are equal in all three parts of the
order stay in one shard, texts of any length are one record.  No rows in, no rows out.  All columns are kept; `shard` is added (a
column of that name is replaced).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .common import OWN, checkpoint, documents, ship_package

SHARD_BYTES = 32 << 20
ROW_BYTES = 32
OVERSAMPLE = 64
FAN_OUT = 256
TOLERANCE = 1.25
LOW = -(1 << 63)
K, T, H, S, R, W, N, KEYS = (OWN + x for x in ("k", "t", "h", "s", "r", "w", "n", "keys"))


class Cuts:
    """Sorted splitters; finds the number of them that are not above a record."""

    def __init__(self, cuts: list[tuple]):
        self.cuts = cuts
        self.keys = [c[0] for c in cuts]
        ties = [c[1] for c in cuts]
        self.ties = np.array(ties, dtype=object if ties and isinstance(ties[0], str) else np.int64)

    def numbers(self, k: pa.Array, t: pa.Array, h: pa.Array) -> np.ndarray:
        encoded = k.dictionary_encode()
        code, ties = encoded.indices.to_numpy(zero_copy_only=False), t.to_numpy(zero_copy_only=False)
        out = np.zeros(len(k), dtype=np.int32)
        for c, key in enumerate(encoded.dictionary.to_pylist()):
            rows = np.flatnonzero(code == c)
            lo, hi = bisect_left(self.keys, key), bisect_right(self.keys, key)
            out[rows] = lo
            if lo < hi:
                own = self.ties[lo:hi]
                left, right = np.searchsorted(own, ties[rows], "left"), np.searchsorted(own, ties[rows], "right")
                out[rows] += left.astype(np.int32)
                for i in rows[left < right]:  # the id of a splitter: the hash decides
                    out[i] = bisect_right(self.cuts, (key, t[int(i)].as_py(), h[int(i)].as_py()), lo, hi)
        return out

    def column(self):
        @F.arrow_udf("int")
        def number(k: pa.Array, t: pa.Array, h: pa.Array) -> pa.Array:
            return pa.array(self.numbers(k, t, h))

        return number(K, T, H) if self.cuts else F.lit(0)


def _quantiles(sample: list[tuple], pieces: int) -> list[tuple]:
    """Cuts of a sorted sample of (order key, weight) into pieces of equal weight."""
    total, cuts, done = sum(w for _, w in sample), [], 0.0
    for key, w in sample:
        if done > 0 and len(cuts) < pieces - 1 and done + w / 2 >= total * (len(cuts) + 1) / pieces and (not cuts or key > cuts[-1]):
            cuts.append(key)
        done += w
    return cuts


def _cut(table: pa.Table) -> pa.Table:
    """The new splitters of one range, from its sample."""
    keys_only, first = table.column(KEYS)[0].as_py(), "" if pa.types.is_string(table.schema.field(T).type) else LOW
    merged: dict[tuple, float] = {}
    for k, t, h, s, w in zip(*(table.column(c).to_pylist() for c in (K, T, H, S, W))):
        key = (k, first, LOW) if keys_only else (k, t, h)
        merged[key] = merged.get(key, 0.0) + max(s, w)
    cuts = _quantiles(sorted(merged.items()), table.column(N)[0].as_py())
    return pa.table({c: pa.array([x[i] for x in cuts], table.schema.field(c).type) for i, c in enumerate((K, T, H))})


def splitters(slim: DataFrame, shard_bytes: int, oversample: int, tolerance: float, fan_out: int = FAN_OUT) -> list[tuple]:
    """Sorted cuts (key, id, hash) of (K, T, H, S) rows."""
    spark, order = slim.sparkSession, F.struct(K, T, H)
    tie = slim.schema[T].dataType
    first = "" if isinstance(tie, T_.StringType) else LOW
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(7), K, T, H), 11) / F.lit(float(1 << 53))).cast("double")
    cuts: list[tuple] = []
    while True:
        ranged = slim.withColumn(R, Cuts(cuts).column())
        sizes = ranged.groupBy(R).agg(F.sum(S).alias("s"), F.min(order).alias("lo"), F.max(order).alias("hi"))
        over = [r for r in sizes.where(F.col("s") > shard_bytes * tolerance).collect() if tuple(r.lo) != tuple(r.hi)]
        if not over:
            return cuts
        plan = []
        for r in over:
            pieces = max(2, min(fan_out, -(-r.s // shard_bytes)))
            plan.append((r[R], pieces, r.s / (oversample * pieces), r.lo[K] != r.hi[K]))
        rates = F.broadcast(spark.createDataFrame(plan, f"{R} int, {N} int, {W} double, {KEYS} boolean"))
        drawn = ranged.join(rates, R).where(unit < F.col(S) / F.col(W)).select(R, K, T, H, S, N, W, KEYS)
        new = {tuple(x) for x in drawn.groupBy(R).applyInArrow(_cut, f"{K} string, {T} {tie.simpleString()}, {H} long").collect()} - set(cuts)
        at = [bisect_right(cuts, c) for c in new]
        stuck = {r[R]: r for r in over} if not new else {r[R]: r for r in over if r[R] not in set(at)}
        if stuck:  # no splitter from the sample: exactly behind the first key or record
            behind = F.broadcast(spark.createDataFrame([(q, *tuple(r.lo), r.lo[K] != r.hi[K]) for q, r in stuck.items()], f"{R} int, k0 string, t0 {tie.simpleString()}, h0 long, {KEYS} boolean"))
            later = F.when(F.col(KEYS), F.col(K) > F.col("k0")).otherwise(order > F.struct(F.col("k0").alias(K), F.col("t0").alias(T), F.col("h0").alias(H)))
            for k, t, h, by_key in ranged.join(behind, R).where(later).groupBy(R, KEYS).agg(F.min(order).alias("o")).select("o.*", KEYS).collect():
                new.add((k, first, LOW) if by_key else (k, t, h))
        if not new - set(cuts):
            return cuts
        cuts = sorted({*cuts, *new})


def shard(docs: DataFrame, key_col: str = "source", id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, oversample: int = OVERSAMPLE, tolerance: float = TOLERANCE, fan_out: int = FAN_OUT) -> DataFrame:
    """The records with their shard, one partition a shard, in the order of the shards' ranges."""
    whole = isinstance(docs.schema[id_col].dataType, T_.IntegralType)
    order = {
        K: F.coalesce(F.col(key_col).cast("string"), F.lit("")),
        T: F.coalesce(F.col(id_col).cast("long"), F.lit(LOW + 1)) if whole else F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")),
        H: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))),
    }
    size = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + ROW_BYTES).cast("long")
    ship_package(docs.sparkSession)
    cuts = splitters(checkpoint(docs.select(*(c.alias(n) for n, c in order.items()), size.alias(S))), shard_bytes, oversample, tolerance, fan_out)
    out = docs.withColumns(order).withColumn("shard", Cuts(cuts).column()).drop(K, T, H)
    return out.repartitionById(len(cuts) + 1, F.col("shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


ORACLE_SQL = None
