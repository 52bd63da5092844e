"""Benchmark decontamination under edit distance.

A document is contaminated by an item of m words if some span of it, of any length, is within t =
`max_ratio` * m word edits of the item (`free_spans`, as the query and the pipeline have it).  Without
`free_spans` only windows of exactly m words (padded at the document's ends) are compared, for
which each inserted word costs a second edit at the window's end.

The search is an index over the benchmark that each task holds, so the corpus is read once and
nothing of it is shuffled:

* Windows.  All windows of all documents count, with free spans those of m - t, m and m + t words, so
  that a span differs from one of them by at most t / 2 words at its end; from t = 32 on they begin at every
  (t / 16)th word.  Windows that can't match are left out without loss:
  t edits leave at least m - q + 1 - q t of the item's q-grams, so a document that has fewer of
  them anywhere has no matching window, and a matching window starts within t words of where
  a shared q-gram puts the item's start.  q follows from m and t so that the number is positive.
* CGK embedding (random walk over the words; an edit distance k becomes a Hamming distance of
  O(k^2) at most, about 2 k in the mean) of the remaining windows and of the items, one walk for
  each repetition.
* Bit-sampling LSH: `bits` random coordinates of an embedding make a bucket; `repetitions` of
  them reach the target recall (the tests measure at least 0.95 for windows at the very distance limit, and 0.98
  of all pairs with free spans, where several windows meet a span).
* Exact verification of all pairs that share a bucket by the edit distance of words: of the window,
  or of the best span of the words from 2 t before the window to 2 t after it (semi-global).

Items of all lengths are in one index: work is done in blocks of about one length.  An item collection of more than
`index_grams` words is taken in parts of that size, one pass over the documents each, and the driver and
the tasks hold one part at a time.

Defined results: null and empty texts, items without words and empty tables match nothing; items
with a null item_id aren't reported by `find_contamination`, but filter in `drop_contaminated`; ids may be of any type; repeated items match
each by themselves; repeated documents are reported alike.  Ties between windows of a document go to
the smallest distance and then the first window or span.  Texts and items of any length are read whole.  Extra columns, whatever their
names, are ignored by `find_contamination` and kept by the filter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, checkpoint, documents, grams, map_arrow, mix, row_grams, ship_package, word_hashes

MAX_RATIO = 0.2
BITS = 4
REPETITIONS = 24
STRETCH = 3
INDEX_GRAMS = 20_000_000
BLOCK_ROWS = 20_000
BLOCK_WORDS = 1 << 20
_U64 = np.uint64
_ODD, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def limits(m: int, max_ratio: float) -> tuple[int, int, int]:
    """Edits allowed, q, and how many q-grams of the item must be in the document."""
    t = int(max_ratio * m + 1e-9)
    q = max(1, min(4, m // (t + 1)))
    return t, q, max(1, m - q + 1 - q * t)


class Index:
    """Everything that a task needs to know about the items of one part; its size is that of their words."""

    def __init__(self, items: list[tuple[object, np.ndarray]], max_ratio: float, bits: int, repetitions: int, seed: int = 17):
        items = sorted(items, key=lambda x: len(x[1]))
        self.ids = [i for i, _ in items]
        self.m = np.array([len(h) for _, h in items], dtype=np.int64)
        spec = [limits(len(h), max_ratio) for _, h in items]
        self.t, self.q, self.need = (np.array([s[k] for s in spec], dtype=np.int64) for k in range(3))
        #: windows begin at multiples of this, which costs a window at most so many edits again
        self.step = np.maximum(1, self.t // 16)
        self.flat, self.begin = np.concatenate([h for _, h in items]), np.append(0, np.cumsum(self.m))
        self.by_q = {}
        for q in np.unique(self.q):
            g, item, pos = [], [], []
            for i in np.flatnonzero(self.q == q):
                x = grams(items[i][1], int(q))
                g.append(x), item.append(np.full(len(x), i)), pos.append(np.arange(len(x)))
            g, item, pos = np.concatenate(g), np.concatenate(item), np.concatenate(pos)
            order = np.argsort(g, kind="stable")
            keys, first = np.unique(g[order], return_index=True)
            self.by_q[int(q)] = keys, np.append(first, len(g)), item[order], pos[order]
        self.max_ratio, self.bits, self.repetitions, self.seed = max_ratio, bits, repetitions, seed
        own = np.concatenate([self.buckets(self.matrix(part), self.m[part]) for part in _blocks(self.m, self.m)], axis=1)  # repetitions x items
        self.tables = [(np.sort(b), np.argsort(b, kind="stable")) for b in own]

    def matrix(self, items: np.ndarray) -> np.ndarray:
        """The words of these items, a row each, padded to the longest of them."""
        col = np.arange(int(self.m[items].max()))[None, :]
        at = self.begin[items][:, None] + col
        return np.where(col < self.m[items][:, None], self.flat[np.minimum(at, len(self.flat) - 1)], _U64(0))

    def buckets(self, words: np.ndarray, m: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """The bucket of each window in each repetition: a hash of its length class m and of `bits`
        coordinates of its CGK embedding.  A window has m words, or size."""
        size = m if size is None else size
        n, width = words.shape
        rep = np.arange(self.repetitions, dtype=_U64)[:, None]
        salt = mix(rep + _U64(self.seed * 1000))
        at = np.zeros((self.repetitions, n), dtype=np.int64)
        row = np.arange(n)[None, :]
        out = np.broadcast_to(mix(m.astype(_U64))[None, :], at.shape).copy()
        # coordinates are drawn over the walk's length of each window, and read in the order of the walk
        draws = (mix(salt * _U64(31) + np.arange(1, self.bits + 1, dtype=_U64)[None, :]) >> _U64(11)).astype(float) / (1 << 53)
        wanted = np.floor(draws[:, :, None] * (m * STRETCH)[None, None, :]).astype(np.int64).ravel()  # reps x bits x n
        events = np.argsort(wanted, kind="stable")
        ends = np.searchsorted(wanted[events], np.arange(int(m.max()) * STRETCH + 1))
        padded = np.concatenate([words, np.zeros((n, 1), dtype=_U64)], axis=1)
        turn = salt * _U64(_ODD)

        def read(which: np.ndarray, inside: bool) -> None:
            r, b, i = which // (self.bits * n), which // n % self.bits, which % n
            w = padded[i, np.minimum(at[r, i], size[i])] if inside else np.zeros(len(which), dtype=_U64)
            np.add.at(out, (r, i), mix(w + b.astype(_U64) + _U64(1)))

        with np.errstate(over="ignore"):
            for j in range(len(ends) - 1):
                if ends[j] < ends[j + 1]:
                    read(events[ends[j] : ends[j + 1]], True)
                if ends[j + 1] == len(events):
                    break
                if not j % 64 and (at >= size[None, :]).all():  # behind the last word there is nothing to tell apart
                    read(events[ends[j + 1] :], False)
                    break
                w = padded[row, np.minimum(at, size[None, :])]
                at += (((w ^ (turn + _U64(j * 2 + 1) * _U64(_STEP))) * _U64(_ODD)) >> _U64(63)).astype(np.int64)
        return mix(out + salt)

    def candidates(self, h: np.ndarray, offsets: np.ndarray, free_spans: bool = False) -> np.ndarray:
        """(row, length of the items, start, length) of the windows that may match, by the length of the
        items; start is in words of the batch and may lie before the row's first word."""
        found = []
        for q, (keys, first, item, pos) in self.by_q.items():
            g, row, at = row_grams(h, offsets, q)
            if not len(g) or not len(keys):
                continue
            k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == g)
            if not len(hit):
                continue
            count = first[k[hit] + 1] - first[k[hit]]
            each = np.repeat(hit, count)
            entry = np.repeat(first[k[hit]], count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            r, i, a = row[each], item[entry], at[each]
            pair = r * len(self.ids) + i
            known, back, number = np.unique(pair, return_inverse=True, return_counts=True)
            ok = (number >= self.need[known % len(self.ids)])[back]
            r, i, a = r[ok], i[ok], (a - pos[entry])[ok]
            found.append(np.column_stack([r, i, (a - offsets[r]) // self.step[i]]))
        if not found:
            return np.empty((0, 4), dtype=np.int64)
        base = np.unique(np.concatenate(found), axis=0)
        step = self.step[base[:, 1]]
        t = -(-self.t[base[:, 1]] // step)  # in steps
        wide = np.repeat(base, 2 * t + 1, axis=0)
        wide[:, 2] += np.arange(len(wide)) - np.repeat(np.cumsum(2 * t + 1) - t - 1, 2 * t + 1)
        # a window is looked up by its length only: the bucket decides which items it meets
        m, t = self.m[wide[:, 1]], self.t[wide[:, 1]]
        start = offsets[wide[:, 0]] + wide[:, 2] * self.step[wide[:, 1]]
        sizes = (m - t, m, m + t) if free_spans else (m,)
        out = np.unique(np.concatenate([np.column_stack([m, wide[:, 0], start, n]) for n in sizes]), axis=0)
        return out[:, [1, 0, 2, 3]]

    def search(self, h: np.ndarray, offsets: np.ndarray, free_spans: bool = False) -> np.ndarray:
        """(row, item index, start in the row, distance) of verified pairs, the best window or span of each."""
        windows = self.candidates(h, offsets, free_spans)
        results, pairs_of = [], []
        for part in _blocks(windows[:, 3], windows[:, 1]) if len(windows) else ():
            row, m, start, size = windows[part].T
            at = start[:, None] + np.arange(int(size.max()))[None, :]
            inside = (at < (start + size)[:, None]) & (at >= offsets[row][:, None]) & (at < offsets[row + 1][:, None])
            words = np.where(inside, h[np.clip(at, 0, len(h) - 1)], _U64(0))
            pairs = []
            for (keys, order), b in zip(self.tables, self.buckets(words, m, size)):
                left, right = np.searchsorted(keys, b, "left"), np.searchsorted(keys, b, "right")
                n = right - left
                each = np.repeat(np.arange(len(b)), n)
                entry = np.repeat(left, n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(each * len(self.ids) + order[entry])
            pairs = np.unique(np.concatenate(pairs))
            w, i = pairs // len(self.ids), pairs % len(self.ids)
            if free_spans:
                pairs_of.append(np.column_stack([row[w], i, start[w]]))
                continue
            for sub in _blocks(self.m[i], self.m[i]) if len(i) else ():
                ww, ii = w[sub], i[sub]
                width = int(self.m[ii].max())
                d = edit_distance(words[ww][:, :width], self.matrix(ii), self.m[ii])
                ok = d <= self.t[ii]
                results.append(np.column_stack([row[ww], ii, start[ww] - offsets[row[ww]], d])[ok])
        if pairs_of:
            results = self.verify_spans(h, offsets, np.concatenate(pairs_of))
        if not results:
            return np.empty((0, 4), dtype=np.int64)
        r = np.concatenate(results)
        r = r[np.lexsort((r[:, 2], r[:, 3], r[:, 1], r[:, 0]))]
        first = np.ones(len(r), dtype=bool)
        first[1:] = (r[1:, :2] != r[:-1, :2]).any(axis=1)
        return r[first]

    def verify_spans(self, h: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
        """As search, of (row, item index, start of a window) pairs.  The words from 2 t before to 2 t after a window are
        searched; where those of several windows overlap, their union is searched once."""
        if not len(pairs):
            return []
        row, i, start = np.unique(pairs, axis=0).T
        m, t = self.m[i], self.t[i]
        first, stop = start - 2 * t, start + m + 3 * t
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1]) | (first[1:] > start[:-1] + t[:-1] + 1)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(row)) - 1
        row, i = row[head], i[head]
        first, stop = np.maximum(first[head], offsets[row]), np.minimum(stop[tail], offsets[row + 1])
        m, t = self.m[i], self.t[i]
        results = []
        order = np.lexsort((stop - first, m))  # pairs of about one size together
        for part in _blocks((stop - first)[order], m[order]):
            k = order[part]
            at = first[k][:, None] + np.arange(int((stop - first)[k].max()))[None, :]
            words = np.where(at < stop[k][:, None], h[np.minimum(at, len(h) - 1)], _U64(0))
            d, begin = span_distance(words, self.matrix(i[k]), m[k], t[k])
            ok = d <= t[k]
            results.append(np.column_stack([row[k], i[k], np.minimum(first[k] + begin, stop[k]) - offsets[row[k]], d])[ok])
        return results


def _blocks(size: np.ndarray, length: np.ndarray):
    """Index ranges of rows that are sorted by length, so that a matrix of a block's rows is of bounded size and
    little of it is padding."""
    lo = 0
    while lo < len(size):
        hi = min(len(size), lo + BLOCK_ROWS)
        hi = lo + max(1, int(np.searchsorted(length[lo:hi], 2 * length[lo] + 16, "right")))
        hi = lo + max(1, int(np.searchsorted(np.maximum.accumulate(size[lo:hi]) * np.arange(1, hi - lo + 1), BLOCK_WORDS, "right")))
        yield np.arange(lo, hi)
        lo = hi


def span_distance(a: np.ndarray, b: np.ndarray, m: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word edit distance of b[:m] and the span of a that is nearest to it, and where the span begins;
    the first of the nearest.  A 0 in a is a missing word that equals nothing.  Beyond `limit` any greater distance may be given."""
    n, width = a.shape
    edit = 1 << 32  # numbers are distance * edit + begin, so the smallest one has both
    ramp = np.arange(width + 1, dtype=np.int64)
    row = np.broadcast_to(ramp, (n, width + 1)).copy()
    done, left = np.zeros(n, dtype=np.int64), np.arange(n)
    for i in range(1, int(m.max()) + 1):
        bi = b[left, i - 1 : i]
        cur = row + edit
        cur[:, 1:] = np.minimum(cur[:, 1:], row[:, :-1] + ((a != bi) | (a == 0)) * edit)
        row = np.minimum.accumulate(cur - ramp * edit, axis=1) + ramp * edit
        out = m[left] == i
        if limit is not None and not i % 32:  # the least number of a row doesn't become smaller
            out |= (row.min(axis=1) >> 32) > limit[left]
        if out.any():
            done[left[out]] = row[out].min(axis=1)
            a, row, left = a[~out], row[~out], left[~out]
            if not len(left):
                break
    return done >> 32, done & (edit - 1)


def edit_distance(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Word edit distance of rows a[:m] and b[:m], for all pairs at once; a 0 in a is a missing word
    that equals nothing."""
    n, width = a.shape
    ramp = np.arange(width + 1)
    row = np.broadcast_to(ramp, (n, width + 1)).copy()
    done = np.zeros(n, dtype=np.int64)
    for i in range(1, width + 1):
        ai = a[:, i - 1 : i]
        cur = np.empty_like(row)
        cur[:, 0] = i
        cur[:, 1:] = np.minimum(row[:, :-1] + ((ai != b) | (ai == 0)), row[:, 1:] + 1)
        row = np.minimum.accumulate(cur - ramp, axis=1) + ramp
        last = m == i
        if last.any():
            done[last] = row[last, i]
    return done


def _parts(bench: DataFrame, item_col: str, text_col: str, max_ratio: float, bits: int, repetitions: int, index_grams: int, unnamed: bool = False):
    """Indexes of at most index_grams words (or one item), one at a time; `unnamed` items, of a null id, only on demand."""
    held, have = [], 0
    for item, text in bench.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        words = word_hashes(pa.array([text], pa.string()))[0]
        if len(words) and (unnamed or item is not None):
            if have and have + len(words) > index_grams:
                yield Index(held, max_ratio, bits, repetitions)
                held, have = [], 0
            held.append((item, words))
            have += len(words)
    if held:
        yield Index(held, max_ratio, bits, repetitions)


def find_contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_ratio: float = MAX_RATIO,
    bits: int = BITS, repetitions: int = REPETITIONS, index_grams: int = INDEX_GRAMS, free_spans: bool = False,
) -> DataFrame:
    """(doc_id, item_id, start, distance): the best window or span of each contaminated document and item."""
    id_type, item_type = (f.schema[c].dataType.simpleString() for f, c in ((docs, id_col), (bench, item_col)))
    schema = f"doc_id {id_type}, item_id {item_type}, start long, distance long"
    item_arrow = to_arrow_type(bench.schema[item_col].dataType)

    def search_with(index: Index):
        def run(it):
            ids = pa.array(index.ids, item_arrow)
            for b in it:
                for s in batches([b]):
                    h, o = word_hashes(s.column(1))
                    r = index.search(h, o, free_spans)
                    yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(r[:, 0])), ids.take(pa.array(r[:, 1])), pa.array(np.ascontiguousarray(r[:, 2])), pa.array(np.ascontiguousarray(r[:, 3]))], names=["doc_id", "item_id", "start", "distance"])

        return run

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    found: list[DataFrame] = []
    for index in _parts(bench, item_col, "text", max_ratio, bits, repetitions, index_grams):
        if found:  # so that only one index is held at a time
            found[-1] = checkpoint(found[-1])
        found.append(map_arrow(slim, search_with(index), schema))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", max_ratio: float = MAX_RATIO,
    bits: int = BITS, repetitions: int = REPETITIONS, index_grams: int = INDEX_GRAMS, free_spans: bool = False,
) -> DataFrame:
    """The documents that no item contaminates, with their columns."""
    ship_package(docs.sparkSession)

    def clean_of(index: Index):
        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            ok = []
            for s in batches([pa.RecordBatch.from_arrays([texts], names=["t"])]):
                h, o = word_hashes(s.column(0))
                flags = np.ones(s.num_rows, dtype=bool)
                flags[index.search(h, o, free_spans)[:, 0]] = False
                ok.append(flags)
            return pa.array(np.concatenate(ok) if ok else np.empty(0, dtype=bool))

        return clean(F.col(text_col).cast("string"))

    first = True
    for index in _parts(bench, item_col, "text", max_ratio, bits, repetitions, index_grams, unnamed=True):
        docs = (docs if first else checkpoint(docs)).where(clean_of(index))
        first = False
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), free_spans=True)


ORACLE_SQL = None
