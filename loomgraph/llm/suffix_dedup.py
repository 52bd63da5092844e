"""Suffix-array deduplication: passages of at least `min_words` words that occur more than once.

The result is exact: a word is covered if and only if it lies in a window of `min_words` words that
occurs at least twice in the corpus (in one document or in several).

1. Suffixes.  A suffix array of all positions isn't needed: of any `window` consecutive positions
   the one with the smallest hash of its next words (the first of ties) is a suffix.  Which one depends
   on the words alone, so all occurrences of a repeated passage have a suffix at the same place,
   in its first `window` words.
2. Only suffixes whose first min_words - window + 1 words recur can be part of a repeat; the hashes of
   these are counted, with partial sums before the shuffle, and the others dropped, before any text moves.
3. A suffix is written as a record: the codes of its words, up to min_words of them, and of the window - 1 words
   before it.  Equal records are folded, with their number, before they are shuffled, so a passage that a
   million documents share is one record a task.  Sampled splitters on the leading words range-partition the records.  A
   splitter never divides suffixes with equal leading words, so that neighbours which share
   enough words to matter are never on two sides of a boundary.
4. Each bucket is sorted by a multikey quicksort (ternary splits on one word at a time, all groups of a
   depth at once) by what follows, and once more by what precedes, read backwards.  The longest common prefixes of
   neighbours in the two orders decide: the window that begins d words before a suffix is repeated if and only if another
   record is in the same run of common prefixes of min_words - d words in the one order and of d words in the other.
5. Records of repeated windows are joined to the places in the documents that have them, and a document's windows become
   maximal spans.

Defined results: null and empty texts, texts of fewer than min_words words and empty tables have no row.  A
repeated row is an occurrence of its own: both rows' document is covered in full.  Ties between equal suffixes need no order.  Texts
are read whole, whatever their length; extra columns, whatever their names, are ignored.  Spans are in words
of the document, `finish` is exclusive.  Words are compared by 31-bit codes, records and documents are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, batches, checkpoint, documents, map_arrow, mix, partitions, release, row_grams, rows_of, window_hashes, word_hashes

MIN_WORDS = 50
WINDOW = 24
ORDER_WORDS = 3
LEADING = 8
FOLD_ROWS = 60_000
_U64 = np.uint64


def suffixes(h: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Chosen positions: the smallest of each `window` positions within a row."""
    g, row, at = row_grams(h, offsets, ORDER_WORDS)
    if len(g) < window:
        return np.empty(0, dtype=np.int64)
    best, reach = np.arange(len(g)), 1
    while reach < window:
        step = min(reach, window - reach)
        a, b = best[:-step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        reach += step
    ok = row[: len(best)] == row[window - 1 :]
    return at[np.unique(best[ok])]


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of words, and each row's common prefix with the one before."""
    n, depth_max = words.shape
    order, lcp = np.arange(n), np.zeros(n, dtype=np.int64)
    group = np.zeros(n, dtype=np.int64)  # of the places in order; a group is still tied
    open_ = np.arange(n) if n > 1 else np.empty(0, dtype=np.int64)
    for depth in range(depth_max):
        if not len(open_):
            break
        rows = order[open_]
        key = words[rows, depth]
        by = np.lexsort((key, group[open_]))
        order[open_] = rows[by]
        key, own = key[by], group[open_]
        # places of a group are contiguous, so sorting within groups keeps them in place
        split = np.zeros(len(open_), dtype=bool)
        split[1:] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        start = np.ones(len(open_), dtype=bool)
        start[1:] = own[1:] != own[:-1]
        lcp[open_[split]] = depth
        new = np.cumsum(split | start)
        size = np.bincount(new)
        group[open_] = new
        open_ = open_[size[new] > 1]
    if len(open_):
        own = group[open_]
        tied = np.zeros(len(open_), dtype=bool)
        tied[1:] = own[1:] == own[:-1]
        lcp[open_[tied]] = depth_max
    return order, lcp


def _codes(h: np.ndarray) -> np.ndarray:
    return np.maximum(h >> _U64(33), _U64(1)).astype(np.uint32)


def repeated(words: np.ndarray, copies: np.ndarray, min_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which suffix records of a bucket lie in repeated windows: record, and least and largest
    number of words by which such a window starts before the suffix.  Columns of words: min_words
    from the suffix on, then the window - 1 words before it; 0 is no word."""
    order, lcp = multikey_sort(words[:, :min_words])
    near = np.append(lcp >= min_words - window + 1, False)
    near[0] = False
    keep = np.zeros(len(words), dtype=bool)
    keep[order] = near[:-1] | near[1:]
    keep |= copies > 1
    order, lcp = order[keep[order]], _least_of_runs(lcp, keep[order])
    place = np.cumsum(keep) - 1  # of the kept records
    order, keep = place[order], np.flatnonzero(keep)
    before = words[keep][:, min_words:][:, ::-1]
    back, back_lcp = multikey_sort(before)
    follow, precede = (words[keep][:, :min_words] != 0).sum(axis=1), (before != 0).sum(axis=1)
    least, most = np.full(len(keep), window), np.full(len(keep), -1)
    run, back_run = np.empty(len(keep), dtype=np.int64), np.empty(len(keep), dtype=np.int64)
    for d in range(window):
        run[order] = np.cumsum(lcp < min_words - d)
        back_run[back] = np.cumsum(back_lcp < d)
        some = np.flatnonzero((follow >= min_words - d) & (precede >= d))
        _, which = np.unique(run[some] * (len(keep) + 1) + back_run[some], return_inverse=True)
        number = np.bincount(which, weights=copies[keep[some]])
        hit = some[number[which] > 1] if len(some) else some
        least[hit], most[hit] = np.minimum(least[hit], d), d
    found = most >= 0
    return keep[found], least[found], most[found]


def _least_of_runs(lcp: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Common prefixes of kept neighbours: the least of those between them."""
    at = np.flatnonzero(keep)
    if not len(at):
        return lcp[:0]
    low = np.minimum.reduceat(lcp, np.append(0, at[:-1] + 1))
    low[0] = 0
    return low


def _prints(words: np.ndarray) -> np.ndarray:
    return mix(np.bitwise_xor.reduce(mix(words.astype(_U64) + (np.arange(words.shape[1], dtype=_U64) << _U64(32))[None, :]), axis=1))


def _folded(words: list[np.ndarray], copies: list[np.ndarray]) -> pa.RecordBatch:
    """Different records with their numbers."""
    w, c = np.concatenate(words), np.concatenate(copies)
    _, first, which = np.unique(_prints(w), return_index=True, return_inverse=True)
    w, n = w[first], np.bincount(which, weights=c).astype(np.int64)
    bounds = (np.arange(len(w) + 1) * w.shape[1] * 4).astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(w.astype(">u4").tobytes())])
    return pa.RecordBatch.from_arrays([payload, pa.array(n)], names=["words", "copies"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, finish): maximal spans of words of repeated windows."""
    if not 1 <= window <= min_words - ORDER_WORDS - LEADING:
        raise ValueError("window must be smaller than min_words by the words of the order and of the leading key")
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("node"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") >= min_words)
    sure, width = min_words - window + 1, min_words + window - 1

    def seeds(it):
        for b in it:
            for s in batches([b]):
                h, o = word_hashes(s.column(1))
                p, row = suffixes(h, o, window), rows_of(o)
                r = row[p]
                ok = (p + sure <= o[r + 1]) & (np.diff(o)[r] >= min_words)
                p, r = p[ok], r[ok]
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(r)), pa.array(window_hashes(h, p, sure).view(np.int64)), pa.array((p - o[r]).astype(np.int32))], names=["node", "seed", "pos"])

    found = map_arrow(slim.select("node", "text"), seeds, "node long, seed long, pos int")
    several = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    recurring = checkpoint(found.join(several, "seed").groupBy("node").agg(F.collect_set("pos").alias("pos")))
    release(docs.sparkSession)

    def chosen(it):
        """Slices with the records of their chosen suffixes: batch, row, position in the row, words."""
        for b in it:
            for s in batches([b]):
                h, o = word_hashes(s.column(2))
                codes = _codes(h)
                lists = s.column(3)
                row = np.repeat(np.arange(s.num_rows), np.diff(lists.offsets.to_numpy()))
                p = lists.flatten().to_numpy().astype(np.int64) + o[row]
                column = np.concatenate([np.arange(min_words), np.arange(1 - window, 0)])[None, :]
                for lo in range(0, len(p), 20_000):
                    pp, rr = p[lo : lo + 20_000], row[lo : lo + 20_000]
                    at = pp[:, None] + column
                    ok = (at >= o[rr][:, None]) & (at < o[rr + 1][:, None])
                    yield s, rr, pp - o[rr], np.where(ok, codes[np.clip(at, 0, len(codes) - 1)], np.uint32(0))

    def records(it):
        held, size = [], 0
        for _, _, _, words in chosen(it):
            held.append(words)
            size += len(words)
            if size > FOLD_ROWS:
                yield _folded(held, [np.ones(size, dtype=np.int64)])
                held, size = [], 0
        if size:
            yield _folded(held, [np.ones(size, dtype=np.int64)])

    def places(it):
        for s, rr, pos, words in chosen(it):
            prints = _prints(words)
            by = np.lexsort((prints, rr))
            rr, pos, prints = rr[by], pos[by], prints[by]
            fresh = np.append(True, (rr[1:] != rr[:-1]) | (prints[1:] != prints[:-1]))
            first = np.flatnonzero(fresh)
            ends = np.append(first, len(rr)).astype(np.int32)
            take = pa.array(rr[first])
            yield pa.RecordBatch.from_arrays([s.column(0).take(take), s.column(1).take(take), pa.array(prints[first].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))], names=["node", "id", "record", "pos"])

    def compare(it):
        parts = [b for b in it if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        words = np.frombuffer(b"".join(t.column("words").to_pylist()), dtype=">u4").reshape(-1, width).astype(np.uint32)
        record, least, most = repeated(words, t.column("copies").to_numpy(), min_words, window)
        out = pa.table({"record": pa.array(_prints(words[record]).view(np.int64)), "least": pa.array(least), "most": pa.array(most)})
        yield from out.group_by("record").aggregate([("least", "min"), ("most", "max")]).rename_columns(["record", "least", "most"]).combine_chunks().to_batches()

    chosen_of = slim.join(recurring, "node").select("node", "id", "text", "pos")
    bucketed = map_arrow(chosen_of, records, "words binary, copies long").repartitionByRange(partitions(docs), F.substring(F.col("words"), 1, LEADING * 4))
    verdict = map_arrow(bucketed, compare, "record long, least long, most long")
    at = map_arrow(chosen_of, places, f"node long, id {id_type}, record long, pos array<int>").join(verdict, "record").select("node", "id", F.explode("pos").alias("pos"), "least", "most")
    spans = at.select("node", F.col("id").alias("doc_id"), (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + min_words).alias("finish"))
    w = Window.partitionBy("node").orderBy("start", "finish")
    reach = F.max("finish").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("node", "island").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("finish").alias("finish")).select("doc_id", "start", "finish")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_PATTERN}') AS w FROM documents
), p AS (
  SELECT r, doc_id, unnest(list_transform(range(1, len(w) - {MIN_WORDS - 2}), lambda i: array_to_string(list_slice(w, i, i + {MIN_WORDS - 1}), ' '))) AS k, unnest(range(len(w) - {MIN_WORDS - 1})) AS s
  FROM d WHERE len(w) >= {MIN_WORDS}
), hit AS (
  SELECT r, doc_id, s FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)
), step AS (
  SELECT r, doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= {MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM hit
), island AS (
  SELECT r, doc_id, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS i FROM step
)
SELECT doc_id, min(s) AS start, max(s) + {MIN_WORDS} AS finish FROM island GROUP BY r, doc_id, i
"""
