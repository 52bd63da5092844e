"""Best-fit packing of documents into training sequences of a fixed number of words.

A document longer than the sequence is cut into full pieces and a rest.  The plan is made over
the histogram of piece lengths, at most `capacity` numbers: best-fit decreasing where all pieces
of one length and all bins of one free space are handled at once, which gives the bins that
best-fit decreasing gives piece by piece.  The plan is a list of slot ranges; a piece takes the
slot of its rank among the pieces of its length, so that only the histogram and the slot
ranges, bounded by the capacity, reach the driver.

Defined results: a document without words (null, empty, punctuation only) has nothing to pack
and no row.  Repeated rows are packed once each.  A null doc_id is packed like others.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, checkpoint, documents, map_arrow, partitions, word_bounds

CAPACITY = 2048


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, first rank, last rank, first bin, pieces a bin, offset in the bin) of
    best-fit decreasing.  Ranks count from 0 within a length."""
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> (first bin, bins)
    spaces: list[int] = []  # the keys of free, sorted
    slots, bins = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if not free[space]:
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, have = free[space].pop()
                if not free[space]:
                    spaces.pop(i)
            else:
                space, first, have = capacity, bins, -(-n // (capacity // length))
                bins += have
            each = space // length
            full = min(have, n // each)
            if full:
                slots.append((length, rank, rank + full * each - 1, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            if n and full < have:  # fewer than `each` are left: they share one bin
                slots.append((length, rank, rank + n - 1, first + full, n, capacity - space))
                put(space - n * length, first + full, 1)
                rank, n, full = rank + n, 0, full + 1
            put(space, first + full, have - full)
    return slots


def _counts(it):
    for b in it:
        for s in batches([b]):
            n = np.diff(word_bounds(s.column(1)))
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n)], names=["id", "n"])


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start (in words of the document), length, bin_id and
    bin_offset (in words of the sequence)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark, shards = docs.sparkSession, partitions(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    counted = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), _counts, f"id {id_type}, n long")
    pieces = checkpoint(
        counted.where("n > 0")
        .select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
        .select("id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"), F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int").alias("shard"))
    )
    # lengths x shards rows at most
    sizes = pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("length", "shard", (F.sum("c").over(Window.partitionBy("length").orderBy("shard")) - F.col("c")).alias("before"))
    slots = plan({r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("c")).collect()}, capacity)
    table = F.broadcast(spark.createDataFrame(slots, "s_length int, rank_from long, rank_to long, first_bin long, per_bin long, bin_start long"))
    at = F.row_number().over(Window.partitionBy("length", "shard").orderBy("id", "piece")) - 1
    ranked = pieces.withColumn("at", at).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("at"))
    nth = F.col("rank") - F.col("rank_from")
    return ranked.join(table, (F.col("length") == F.col("s_length")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to"))).select(
        F.col("id").alias("doc_id"), "piece", (F.col("piece") * capacity).alias("start"), F.col("length"),
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("bin_id"),
        (F.col("bin_start") + nth % F.col("per_bin") * F.col("length")).alias("bin_offset"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


ORACLE_SQL = None
