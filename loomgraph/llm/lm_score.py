"""Language-model scores by stupid backoff over n-gram counts of the corpus itself.

The score of a word w after u v is log c(u v w) / c(u v) if that trigram occurs at least `min_count`
times in the corpus, else log(alpha c(v w) / c(v)) if the bigram does, else log(alpha^2 c(w) / N);
the first words of a document start at the order that they have.  A document's score is the sum over
its words.  Counts are over all documents.

In relational terms the n-gram tables are grouped by hash partition and joined to the n-grams of each
document, summed by document.  An exploded row for each n-gram and order would be many times the
corpus, so both sides move as sorted blocks:

1. Documents are hashed to chunks of about `chunk_bytes` of text.  A chunk's distinct n-grams are sorted
   by a 56-bit hash; a block is the part of one hash range, written as 4 low bytes and the
   differences of the high ones, with the counts.
2. There are so many hash ranges that each holds the n-grams of about `range_bytes` of text (one n-gram is at most
   once in each chunk's block, however often it occurs).  A hash range's blocks from all chunks meet in one task, which adds the counts (the n-gram table of that
   partition) and returns to each chunk, in the order of its block, the counts of the other chunks.
3. A chunk joins them to its n-grams by place and sums the scores of its documents.

The chunks' shuffle is used by both ends.  What moves follows the distinct n-grams of the chunks, about
5 bytes each.

Defined results: a document without words (null or empty text) has n_words 0 and a null score.
Repeated rows count as often as they occur and have a row each.  An empty table has no rows.  Texts are read whole, whatever
their length.  Extra columns, whatever their names, aren't carried.  min_count is 2 because an n-gram that occurs
once is the one being scored: by its own count it would be certain.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, checkpoint, documents, partitions, row_grams, rows_of, ship_package, word_hashes

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 32 << 20
_U64 = np.uint64
_SHIFT = _U64(8)  # 56 bits of a hash are used


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The chunk's rows in a fixed order, their words and offsets."""
    table = table.take(pa.array(np.argsort(table.column("node").to_numpy(), kind="stable")))
    return table, *word_hashes(table.column("text"))


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers, byte by byte: all low bytes, then all next ones, compressed."""
    return zlib.compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _encode(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    high = (keys >> _U64(32)).astype(np.int64)
    return keys.astype("<u4").tobytes(), _pack(np.diff(high, prepend=0)), _pack(counts - 1)


def _decode(low: bytes, high: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    top = np.cumsum(_unpack(high)).astype(_U64)
    return (top << _U64(32)) | np.frombuffer(low, dtype="<u4"), _unpack(counts) + 1


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_words, score) for each document."""
    spark, n = docs.sparkSession, partitions(docs)
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    chunks, ranges = max(1, -(-size // chunk_bytes)), max(n, -(-size // range_bytes))
    node = F.xxhash64(F.col(id_col).cast("string"), text)
    placed = docs.select(F.pmod(node, F.lit(chunks)).cast("int").alias("chunk"), node.alias("node"), F.col(id_col).alias("id"), text.alias("text")).repartition(n, "chunk")
    span = (1 << 56) // ranges + 1

    def blocks(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, h, o = _ordered(table)
        out: dict[str, list] = {c: [] for c in ("range", "level", "chunk", "low", "high", "counts")}
        for level in range(order):
            keys, count = np.unique(row_grams(h, o, level + 1)[0] >> _SHIFT, return_counts=True)
            cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=_U64) * _U64(span))
            for r in np.flatnonzero(np.diff(cut)):
                part = slice(cut[r], cut[r + 1])
                for c, v in zip(out, (int(r), level, chunk, *_encode(keys[part], count[part]))):
                    out[c].append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    def totals(table: pa.Table) -> pa.Table:
        parts = [_decode(a.as_py(), b.as_py(), c.as_py()) for a, b, c in zip(table.column("low"), table.column("high"), table.column("counts"))]
        keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)
        others = total[which] - np.concatenate([c for _, c in parts])  # mostly 0
        mine = np.split(others, np.cumsum([len(k) for k, _ in parts])[:-1])
        return pa.table({
            "chunk": table.column("chunk"), "level": table.column("level"), "range": table.column("range"),
            "others": pa.array([_pack(t) for t in mine], pa.binary()),
        })

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        kept, h, o = _ordered(left)
        words = int(o[-1])
        found = {(level, r): t for level, r, t in zip(right.column("level").to_pylist(), right.column("range").to_pylist(), right.column("others"))}
        count = []  # for each order the corpus count of the n-gram that ends at each word
        for level in range(order):
            g, _, at = row_grams(h, o, level + 1)
            _, which, own = np.unique(g >> _SHIFT, return_inverse=True, return_counts=True)
            others = [_unpack(found[level, r].as_py()) for r in range(ranges) if (level, r) in found]
            whole = own + (np.concatenate(others) if others else 0)
            c = np.zeros(words, dtype=np.int64)
            c[at + level] = whole[which]
            count.append(c)
        value, decided, steps = np.zeros(words), np.zeros(words, dtype=bool), np.zeros(words)
        for level in range(order - 1, 0, -1):
            there = count[level] > 0
            use = ~decided & (count[level] >= min_count)
            at = np.flatnonzero(use)
            value[at] = np.log(count[level][at]) - np.log(count[level - 1][at - 1]) + steps[at] * np.log(alpha)
            steps += ~decided & ~use & there
            decided |= use
        rest = np.flatnonzero(~decided)
        value[rest] = np.log(np.maximum(count[0][rest], 1)) + steps[rest] * np.log(alpha)
        row = rows_of(o)
        rows = kept.num_rows
        return pa.table({
            "doc_id": kept.column("id"), "n_words": pa.array(np.diff(o)), "part": pa.array(np.bincount(row, weights=value, minlength=rows)),
            "bare": pa.array(np.bincount(row[rest], minlength=rows)),
        })

    table = placed.groupBy("chunk").applyInArrow(blocks, "range int, level int, chunk int, low binary, high binary, counts binary")
    back = table.groupBy("range", "level").applyInArrow(totals, "chunk int, level int, range int, others binary").repartition(n, "chunk")
    found = placed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scored, f"doc_id {id_type}, n_words long, part double, bare long")
    found = checkpoint(found)
    corpus = found.agg(F.sum("n_words")).head()[0] or 1
    score = F.when(F.col("n_words") > 0, F.col("part") - F.col("bare") * F.lit(float(np.log(corpus))))
    return found.select("doc_id", "n_words", score.alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir)).select("doc_id", "n_words", F.round("score", 4).alias("score"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_PATTERN}') AS w FROM documents
), t AS (
  SELECT r, unnest(w) AS w3, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (
  SELECT r, i, w3, lag(w3, 1) OVER (PARTITION BY r ORDER BY i) AS w2, lag(w3, 2) OVER (PARTITION BY r ORDER BY i) AS w1 FROM t
), c1 AS (
  SELECT w3 AS a, count(*) AS n FROM g GROUP BY 1
), c2 AS (
  SELECT w2 AS a, w3 AS b, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2
), c3 AS (
  SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY 1, 2, 3
), s AS (
  SELECT g.r,
    CASE WHEN c3.n >= {MIN_COUNT} THEN ln(c3.n) - ln(ctx.n)
         WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n) - ln(u.n) + CASE WHEN g.i >= 3 THEN ln({ALPHA}) ELSE 0 END
         ELSE ln(c1.n) - ln((SELECT count(*) FROM g)) + CASE WHEN g.i >= 3 THEN 2 * ln({ALPHA}) WHEN g.i = 2 THEN ln({ALPHA}) ELSE 0 END END AS v
  FROM g
  JOIN c1 ON c1.a = g.w3
  LEFT JOIN c1 u ON u.a = g.w2
  LEFT JOIN c2 ON c2.a = g.w2 AND c2.b = g.w3
  LEFT JOIN c2 ctx ON ctx.a = g.w1 AND ctx.b = g.w2
  LEFT JOIN c3 ON c3.a = g.w1 AND c3.b = g.w2 AND c3.c = g.w3
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(x.score, 4) AS score
FROM d LEFT JOIN (SELECT r, sum(v) AS score FROM s GROUP BY r) x ON x.r = d.r
"""
