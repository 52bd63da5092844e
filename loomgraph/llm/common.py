"""Shared pieces of the text operators: word hashing, checkpoints, row handling.

Words are maximal runs of word characters of the lower-cased text.  A byte is part of a word
when it is an ASCII letter or digit or belongs to a non-ASCII code point outside three
punctuation blocks (U+0080-00BF, U+2000-206F, U+3000-303F).  ``WORD_PATTERN`` is the same
definition as a regular expression.  A word is represented by a 64-bit hash, computed for a
whole Arrow batch at once without creating Python strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, release, ship_package  # noqa: F401

WORD_PATTERN = "[0-9A-Za-zÀ-῿⁰-⿿぀-\U0010ffff]+"
WORD_RE = re.compile(WORD_PATTERN)

_U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): spreads every input bit over the word."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(x.astype(_U64, copy=False))


with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=_U64) * _U64(0xD1B54A32D192ED03))
_WORD_BYTE = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _WORD_BYTE[_lo : _hi + 1] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0..r^n and r^-0..r^-n modulo 2^64, kept per process."""
    if "p" not in _POW or len(_POW["p"]) <= n:
        size = max(n, _CHUNK) + 1
        with np.errstate(over="ignore"):
            for key, base in (("p", _R), ("q", pow(_R, -1, 1 << 64))):
                steps = np.full(size, base, dtype=_U64)
                steps[0] = 1
                _POW[key] = np.cumprod(steps)
    return _POW["p"], _POW["q"]


def _segment(data: np.ndarray, hashes: bool = True, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list]:
    """Hashes (or nothing) and first byte of the words of one byte buffer; for each prefix length
    the hashes of the first bytes of longer words and these words' numbers."""
    word = _WORD_BYTE[data]
    if (data >= 0xC2).any():
        for lead, second in ((0xC2, None), (0xE2, (0x80, 0x81)), (0xE3, (0x80, 0x80))):
            at = np.flatnonzero(data == lead)
            if len(at):
                if second:
                    at = at[at + 2 < len(data)]
                    at = at[(data[at + 1] >= second[0]) & (data[at + 1] <= second[1])]
                    if lead == 0xE2:
                        at = at[(data[at + 1] == 0x80) | (data[at + 2] < 0xB0)]
                for k in range(3 if second else 2):
                    word[at[at + k < len(data)] + k] = False
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start = np.flatnonzero(edge == 1)
    if not hashes:
        return start[:0].astype(_U64), start, []
    end = np.flatnonzero(edge == -1)
    p, q = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, dtype=_U64)
        total[0] = 0
        np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * q[start] + (end - start).astype(_U64)
        extra = []
        for k in prefixes:
            longer = np.flatnonzero(end - start > k)
            b = start[longer]
            extra.append((_mix((total[b + k] - total[b]) * q[b] + _U64(k << 32)), longer))
        return _mix(h), start, extra


def word_bounds(texts: pa.Array) -> np.ndarray:
    """As the second result of word_hashes."""
    return word_hashes(texts, False)[1]


def word_hashes(texts: pa.Array, hashes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array and where each row's begin (one more entry than
    rows).  A null text has no words."""
    return word_features(texts, (), hashes)[:2]


def word_features(texts: pa.Array, prefixes: tuple[int, ...], hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and the hashes of the words' prefixes of so many bytes with the word of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(texts)
    if n == 0:
        return np.empty(0, dtype=_U64), np.zeros(1, dtype=np.int64), np.empty(0, dtype=_U64), np.empty(0, dtype=np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    out, more, of, offsets = [], [], [], np.zeros(n + 1, dtype=np.int64)
    i = done = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _CHUNK, "right")) - 1)
        part = data[bounds[i] : bounds[j]]
        if len(part):
            # a word never spans two rows: the last byte of a row ends it
            h, start, extra = _segment_rows(part, bounds[i : j + 1] - bounds[i], hashes, prefixes)
            for x, word in extra:
                more.append(x)
                of.append(word + done)
            offsets[i + 1 : j + 1] = done + np.searchsorted(start, bounds[i + 1 : j + 1] - bounds[i], "left")
            done += len(start)
            out.append(h)
        else:
            offsets[i + 1 : j + 1] = done
        i = j
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
    return join(out, _U64), offsets, join(more, _U64), join(of, np.int64)


def _segment_rows(part: np.ndarray, bounds: np.ndarray, hashes: bool, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list]:
    """As _segment, with row bounds: a separator byte is put between touching rows."""
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(part))]
    if not len(inner):
        return _segment(part, hashes, prefixes)
    touching = np.unique(inner[_WORD_BYTE[part[inner - 1]] & _WORD_BYTE[part[inner]]])
    if not len(touching):
        return _segment(part, hashes, prefixes)
    h, start, extra = _segment(np.insert(part, touching, 32), hashes, prefixes)
    return h, start - np.searchsorted(np.arange(len(touching)) + touching, start, "left"), extra


def hash_of(word: str) -> int:
    """The hash that word_hashes gives to this single word."""
    return int(word_hashes(pa.array([word]))[0][0])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries; entry i covers h[i:i+n]."""
    if len(h) < n:
        return np.empty(0, dtype=_U64)
    with np.errstate(over="ignore"):
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = _mix(g * _U64(_R) + h[k : len(h) - n + 1 + k])
        return g


def window_hashes(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[s : s + n] for each start; as grams, but with a cost that doesn't depend on n."""
    p, q = _powers(len(h))
    with np.errstate(over="ignore"):
        total = np.empty(len(h) + 1, dtype=_U64)
        total[0] = 0
        np.cumsum(_mix(h) * p[: len(h)], out=total[1:])
        return _mix((total[starts + n] - total[starts]) * q[starts])


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def row_grams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams that stay within a row: hash, row and index of the first word."""
    g, row = grams(h, n), rows_of(offsets)
    if not len(g):
        return g, row[:0], row[:0]
    ok = row[: len(g)] == row[n - 1 :]
    return g[ok], row[: len(g)][ok], np.flatnonzero(ok)


def batches(it: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices batches so that none has much more than max_bytes unless one row has."""
    for b in it:
        if b.num_rows == 0:
            continue
        step = max(1, int(b.num_rows * max_bytes / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Columns that operators add for themselves start with this, so that clashes with a user's
#: column are as good as impossible.
OWN = "__lg_"
