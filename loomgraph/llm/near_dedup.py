"""Near-duplicate search: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles (`shingle` consecutive words), a shingle weighs its
count in the document times its inverse document frequency.  Two documents are near duplicates
if the weighted Jaccard similarity (sum of minima over sum of maxima) reaches `threshold`.

1. Document frequencies of all shingles over the whole corpus, by a hash-partitioned count as in
   `lm_score`: documents are hashed to chunks of about `chunk_bytes` of text, a hash range's blocks
   from all chunks meet in one task, which returns to each chunk the counts of the others.  A shingle
   weighs log(documents with text / its frequency).
2. `bands` x `rows` consistent weighted samples of each document; a band of equal samples makes a
   candidate.  The chance to miss a pair at similarity s is (1 - s^rows)^bands: under 0.04 at
   the threshold.
3. Rows of one text are folded to one of them; only distinct texts are compared.
4. Documents that share a band's bucket meet in cells of the bucket and are compared by their exact similarity, unless links
   found before connect them already: such a pair can't change the groups.  The buckets of `FIRST` bands come
   first, and the connected components of their links spare most of the comparisons in the other buckets: one whose documents
   are all connected isn't looked at again.
5. A bucket of more than `cell` documents is divided into blocks.  At first each block is compared within itself and
   with the bucket's first document, which connects a group of similar ones however large it is; if
   documents of the bucket are still apart after that, all pairs of blocks are, each in a task's cell of its own.  So a
   task holds 2 x `cell` documents at most, and no pair is left out.

The result are groups, the connected components of the verified pairs, by alternating large-star and small-star steps,
which aggregate before they shuffle.

Defined results: documents with fewer words than a shingle are the single shingle of all their
words; documents without words (null, empty) are near duplicates of nothing.  Rows that agree
in doc_id and text count as one document and share their fate (exact deduplication removes
them); a row's key is a 64-bit hash of the two.  The document that stays is that of the smallest doc_id, null doc_ids
last, ties by that key.  An empty table gives no rows.  Texts are read whole, whatever their length.  Extra columns, whatever
their names, are ignored by `near_groups` and kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, batches, checkpoint, documents, map_arrow, mix, partitions, release, row_grams, ship_package, word_hashes
from .lm_score import CHUNK_BYTES, RANGE_BYTES, _decode, _encode, _pack, _unpack

SHINGLE = 2
THRESHOLD = 0.7
BANDS, ROWS = 12, 4
FIRST = 3
CELL = 256
FLUSH_BYTES = 4 << 20
_U64 = np.uint64
_TABLE = 1 << 16


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, hash (sorted within a row) and count."""
    h, o = word_hashes(texts)
    g, row, _ = row_grams(h, o, n)
    few = np.flatnonzero((np.diff(o) > 0) & (np.diff(o) < n))
    if len(few):
        whole = np.array([mix(np.bitwise_xor.reduce(mix(h[o[i] : o[i + 1]] + np.arange(o[i + 1] - o[i], dtype=_U64)))[None])[0] for i in few], dtype=_U64)
        g, row = np.concatenate([g, whole]), np.concatenate([row, few])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    fresh = np.ones(len(g), dtype=bool)
    fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    return row[at], g[at], np.diff(np.append(at, len(g)))


def idf_weights(df: np.ndarray, count: np.ndarray, total: int) -> np.ndarray:
    # a shingle of all documents still weighs a little, so that no document is weightless
    return np.maximum(np.log(total / df), 0.01) * count


_DRAWS: dict[int, tuple] = {}


def _draws(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r ~ Gamma(2, 1), beta ~ U(0, 1) and of an exponential, a row for each 16 bits of a
    shingle's hash; c ~ Gamma(2, 1) is the sum of two rows of the last."""
    if k not in _DRAWS:
        rng = np.random.default_rng(20240229)
        shape = (_TABLE, k)
        r = (rng.standard_exponential(shape, dtype=np.float32) + rng.standard_exponential(shape, dtype=np.float32)).astype(np.float32)
        _DRAWS[k] = r, rng.random(shape, dtype=np.float32), rng.standard_exponential(shape, dtype=np.float32)
    return _DRAWS[k]


def samples(row: np.ndarray, g: np.ndarray, w: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k consistent samples as hashes of (shingle, step); rows without shingles have 0."""
    r, beta, e = _draws(k)
    best = np.full((rows, k), np.iinfo(np.uint64).max, dtype=_U64)
    log_w = np.log(w).astype(np.float32)
    i1, i2, i3 = ((g >> _U64(s) & _U64(0xFFFF)).astype(np.int64) for s in (0, 16, 32))
    step = 4096
    for lo in range(0, len(g), step):
        part = slice(lo, min(lo + step, len(g)))
        rr = r[i1[part]]
        y = rr * (np.floor(log_w[part, None] / rr + beta[i1[part]]) - beta[i1[part]])
        a = np.log(e[i2[part]] + e[i3[part]]) - y - rr
        # order-preserving integer of the float, then the shingle's number
        bits = a.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(_U64)
        keys = (bits << _U64(32)) | np.arange(lo, part.stop, dtype=_U64)[:, None]
        start = np.flatnonzero(np.diff(row[part], prepend=-1))
        mine = row[part][start]
        best[mine] = np.minimum(best[mine], np.minimum.reduceat(keys, start, axis=0))
    out = np.zeros((rows, k), dtype=_U64)
    have = np.unique(row)
    if len(have):
        chosen = (best[have] & _U64(0xFFFFFFFF)).astype(np.int64)
        column = np.arange(k)[None, :]
        rr, bb = r[i1[chosen], column], beta[i1[chosen], column]
        t = np.floor(log_w[chosen] / rr + bb).astype(np.int64).view(_U64)
        out[have] = mix(g[chosen] ^ mix(t + _U64(0x51ED270B)))
    return out


def band_keys(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band; the band is part of it."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U64)[None, :], (len(sample), bands)).copy()
    parts = sample.reshape(len(sample), bands, rows)
    for j in range(rows):
        out = mix(out * _U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (a, b) links, root the smallest node: alternating
    large-star and small-star steps until nothing changes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", F.least("u", "m").alias("m"))
        if large:
            out = low.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = low.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    edges = checkpoint(edges)
    before = state(edges)
    while True:
        edges = checkpoint(star(star(edges, True), False))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _node(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def similarity(g1: np.ndarray, w1: np.ndarray, g2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard of two sorted shingle sets."""
    at = np.searchsorted(g2, g1)
    at[at == len(g2)] = 0
    hit = g2[at] == g1 if len(g2) else np.zeros(len(g1), dtype=bool)
    low = np.minimum(w1[hit], w2[at[hit]]).sum()
    return float(low / (w1.sum() + w2.sum() - low))


def connect(vectors: list[tuple[np.ndarray, np.ndarray]], roots: list[int], threshold: float) -> list[tuple[int, int]]:
    """Pairs that reach the threshold, of documents that neither equal roots nor pairs before connect."""
    known: dict[int, int] = {}
    parent = [known.setdefault(r, i) for i, r in enumerate(roots)]
    links = []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    weight = [float(w.sum()) for _, w in vectors]
    for i in range(len(vectors)):
        for j in range(i):
            # sums too different can't reach it, whatever the shingles are
            if min(weight[i], weight[j]) < threshold * max(weight[i], weight[j]) * (1 - 1e-9):
                continue
            a, b = find(i), find(j)
            if a != b and similarity(*vectors[i], *vectors[j]) >= threshold:
                parent[max(a, b)] = min(a, b)
                links.append((j, i))
    return links


def signatures(slim: DataFrame, total: int, size: int, shingle: int, bands: int, rows: int, chunk_bytes: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(node, keys, df) of each (node, text) row with words: its band keys and the packed document
    frequencies of its shingles, in the order of their hashes."""
    ship_package(slim.sparkSession)
    n = partitions(slim)
    chunks, ranges = max(1, -(-size // chunk_bytes)), max(n, -(-size // range_bytes))
    placed = slim.select(F.pmod("node", F.lit(chunks)).cast("int").alias("chunk"), "node", "text").repartition(n, "chunk")
    span, shift = (1 << 56) // ranges + 1, _U64(8)  # 56 bits of a hash are counted

    def blocks(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("range", "chunk", "low", "high", "counts")}
        keys, count = np.unique(shingles(table.column("text").combine_chunks(), shingle)[1] >> shift, return_counts=True)
        cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=_U64) * _U64(span))
        for r in np.flatnonzero(np.diff(cut)):
            part = slice(cut[r], cut[r + 1])
            for c, v in zip(out, (int(r), table.column("chunk")[0].as_py(), *_encode(keys[part], count[part]))):
                out[c].append(v)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    def totals(table: pa.Table) -> pa.Table:
        parts = [_decode(a.as_py(), b.as_py(), c.as_py()) for a, b, c in zip(table.column("low"), table.column("high"), table.column("counts"))]
        keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        own = np.concatenate([c for _, c in parts])
        others = np.bincount(which, weights=own, minlength=len(keys)).astype(np.int64)[which] - own  # mostly 0
        mine = np.split(others, np.cumsum([len(k) for k, _ in parts])[:-1])
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "others": pa.array([_pack(t) for t in mine], pa.binary())})

    def signed(left: pa.Table, right: pa.Table) -> pa.Table:
        row, g, count = shingles(left.column("text").combine_chunks(), shingle)
        _, which, own = np.unique(g >> shift, return_inverse=True, return_counts=True)
        found = dict(zip(right.column("range").to_pylist(), right.column("others")))
        others = [_unpack(found[r].as_py()) for r in sorted(found)]
        df = (own + np.concatenate(others) if others else own)[which]
        keys = band_keys(samples(row, g, idf_weights(df, count, total), left.num_rows, bands * rows), bands, rows)
        some, start = np.unique(row, return_index=True)
        packed = [_pack(x - 1) for x in np.split(df, start[1:])] if len(some) else []
        return pa.table({
            "node": left.column("node").take(pa.array(some)),
            "keys": pa.FixedSizeListArray.from_arrays(pa.array(keys[some].ravel().view(np.int64)), bands).cast(pa.list_(pa.int64())),
            "df": pa.array(packed, pa.binary()),
        })

    table = placed.groupBy("chunk").applyInArrow(blocks, "range int, chunk int, low binary, high binary, counts binary")
    back = table.groupBy("range").applyInArrow(totals, "chunk int, range int, others binary").repartition(n, "chunk")
    return placed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(signed, "node long, keys array<long>, df binary")


def _links(members: DataFrame, docs: DataFrame, shingle: int, threshold: float, total: int) -> DataFrame:
    """(a, b) verified pairs from (key, cell, node, root) rows and the documents (node, text, df)."""

    def verify(it):
        def flush(table: pa.Table):
            """Whole cells."""
            texts, nodes, roots = table.column("text").combine_chunks(), table.column("node").to_numpy(), table.column("root").to_numpy()
            key, cell = table.column("key").to_numpy(), table.column("cell").to_numpy()
            first = np.unique(nodes, return_index=True)[1]  # a document may be in several cells
            place = dict(zip(nodes[first].tolist(), range(len(first))))
            row, g, count = shingles(texts.take(pa.array(first)), shingle)
            df = np.concatenate([_unpack(x.as_py()) for x in table.column("df").take(pa.array(first))]) + 1
            w, bounds = idf_weights(df, count, total), np.searchsorted(row, np.arange(len(first) + 1))
            fresh = np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            starts = np.append(np.flatnonzero(fresh), len(key))
            a, b = [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                at = [place[x] for x in nodes[lo:hi].tolist()]
                for i, j in connect([(g[bounds[k] : bounds[k + 1]], w[bounds[k] : bounds[k + 1]]) for k in at], roots[lo:hi].tolist(), threshold):
                    a.append(nodes[lo + i]), b.append(nodes[lo + j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in it:
            for s in batches([b]):
                # rows come sorted by cell: those from `first` on may go on in the next slice
                key, cell = s.column(s.schema.get_field_index("key")).to_numpy(), s.column(s.schema.get_field_index("cell")).to_numpy()
                other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
                first = int(other[-1]) + 1 if len(other) else 0
                if size > FLUSH_BYTES and (first or (key[0], cell[0]) != last):
                    yield flush(pa.Table.from_batches([*held, s.slice(0, first)]))
                    held, size, s = [], 0, s.slice(first)
                held.append(s)
                size, last = size + s.nbytes, (key[-1], cell[-1])
        if held:
            yield flush(pa.Table.from_batches(held))

    rows = members.join(docs, "node").select("key", "cell", "node", "root", "text", "df")
    return map_arrow(rows.repartition(partitions(docs), "key", "cell").sortWithinPartitions("key", "cell", "node"), verify, "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    chunk_bytes: int = CHUNK_BYTES, cell: int = CELL,
) -> DataFrame:
    """One row for each document that has a near duplicate: doc_id, keep_doc_id (the document of its
    group that stays), keep, and __lg_node, a key of the row."""
    slim = docs.select(_node(id_col, text_col).alias("node"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    total, size = docs.agg(F.count(F.col(text_col)), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).head()
    signed = checkpoint(signatures(slim.select("node", "text"), total, size, shingle, bands, rows, chunk_bytes))
    release(docs.sparkSession)
    # rows of one text: its hash and a band key of its own are the same
    twins = checkpoint(slim.select("node", F.xxhash64("text").alias("twin")).join(signed.select("node", F.col("keys")[0].alias("k0")), "node").distinct())
    several = twins.groupBy("twin", "k0").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = checkpoint(twins.join(several, ["twin", "k0"]).where("node != rep").select("node", "rep"))
    alone = signed.join(copies.select("node"), "node", "left_anti")
    keyed = alone.select("node", F.posexplode("keys").alias("band", "key")).distinct()
    # only what shares a bucket is of interest, and only its texts move again
    count = [F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")]
    shared = checkpoint(keyed.join(keyed.groupBy("key").agg(*count).where("n > 1"), "key"))
    texts = checkpoint(slim.select("node", "text").join(alone.select("node", "df").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node"))
    release(docs.sparkSession)

    block = F.pmod(F.xxhash64("node", "key"), F.col("g"))
    g = F.ceil(F.col("n") / cell).alias("g")
    blocks = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).otherwise(F.array(block))
    members = shared.where(F.col("band") < FIRST).select("key", "node", "lead", g).select("key", "node", F.col("node").alias("root"), F.explode(blocks).alias("cell"))
    links = checkpoint(_links(members, texts, shingle, threshold, total))
    roots = checkpoint(components(links))

    rooted = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("key").agg(count[0], F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key", g)
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda x: F.least(x, block) * F.col("g") + F.greatest(x, block))
    members = rooted.join(apart, "key").select("key", "node", "root", F.explode(every).alias("cell"))
    more = checkpoint(_links(members, texts, shingle, threshold, total))
    groups = checkpoint(components(links.unionByName(more)))

    folded = copies.join(groups.withColumnsRenamed({"node": "rep", "root": "r"}), "rep", "left").select("node", "rep", F.coalesce("r", "rep").alias("root"))
    whole = groups.unionByName(folded.select("node", "root")).unionByName(folded.where("root = rep").select(F.col("rep").alias("node"), "root")).distinct()
    found = checkpoint(slim.select("node", "id").join(whole, "node"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    stays = found.groupBy("root").agg(F.min(order).alias("stay"))
    return found.join(stays, "root").select(F.col("id").alias("doc_id"), F.col("stay.id").alias("keep_doc_id"), (F.col("node") == F.col("stay.node")).alias("keep"), F.col("node").alias(OWN + "node"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near duplicates of those that stay, with their columns."""
    gone = near_groups(docs, id_col, text_col, **options).where(~F.col("keep")).select(F.col(OWN + "node"))
    gone = checkpoint(gone.distinct())
    return docs.withColumn(OWN + "n", _node(id_col, text_col)).join(gone, F.col(OWN + "n") == F.col(OWN + "node"), "left_anti").select(*docs.columns)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a near duplicate and the document that stays for it."""
    return near_groups(documents(spark, sf_dir)).where(~F.col("keep")).select("doc_id", "keep_doc_id")


ORACLE_SQL = None
