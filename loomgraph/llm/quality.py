"""Quality and toxicity classifier with hierarchical empirical Bayes over hosts and paths.

1. A logistic model of two targets (quality, toxic) is fitted on labelled documents: statistics
   of the text and the presence of words and beginnings of words that tell the classes apart
   (chi-square on the sample).
   The sample is bounded by `max_labelled` rows, the labels with the smallest hash of their row;
   the bound keeps the fit on one machine and doesn't depend on the corpus.  The model has at most `max_words` features for a
   target, those of the highest chi-square, of at least `min_chi2` and in at least `min_df` of the sample's documents; these
   are the size of the model and not a bound on what is read.
2. The evidence of every document of the corpus is summed by site, a host and the whole path.  Sites form a hierarchy: host,
   host/a, host/a/b and so on, as deep as a path goes; a level's sums hold those below.  Hosts are shrunk towards the global
   prior and each further level towards the one above.  The strength of a level's prior is
   estimated from the spread of its means about those above (method of moments on grouped sums).
3. A document's log-odds are those of its own evidence, moved from the global prior to the
   posterior of its site, from which its own evidence is taken out at every level, so that it doesn't count twice.  It is kept if
   it is more likely of quality than not and more likely not toxic than toxic.

Evidence is computed twice instead of carrying texts through a shuffle: once for the sums, once
for the decision.  The posteriors are one row a site; they are broadcast only if they are
few (`broadcast_paths`), else joined.

Defined results: a null or empty text is scored as a text without words; a null source is a site
of its own; hosts are compared in lower case, query and fragment of an address are no part of its path, nor are empty segments.
Labels with a null doc_id are not used, a null label isn't used for its target; a
document with several labels counts once for each.  Without labels of both classes of a target,
that target decides nothing.  Repeated rows are decided alike, and each is evidence for the others' site.  Texts are read whole,
whatever their length.  No rows in, no rows out.  All columns, whatever their names, are kept.  Levels of a path are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, batches, checkpoint, documents, map_arrow, rows_of, ship_package, word_features

MAX_LABELLED = 8000
MAX_WORDS = 512
MIN_CHI2 = 30.0
MIN_DF = 5
PREFIXES = (4, 5, 6, 7)
RIDGE = 0.1
BROADCAST_PATHS = 50_000
TARGETS = ("quality", "toxic")
STATS = 7
#: A slice's words and beginnings of words take many times its bytes.
SLICE_BYTES = 2 << 20

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1  # upper case
_CLASS[48:58] = 2  # digits
for _c in b"#$%&*|!<>{}[]=^~@\\_+":
    _CLASS[_c] = 3


def statistics(texts: pa.Array, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x STATS: length, shares of upper case, digits and symbols, word length, distinct words,
    words that repeat the one before."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    kinds, at = _CLASS[data], bounds - bounds[0]
    size = np.maximum(1, np.diff(at))
    shares = []
    for k in (1, 2, 3):
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(kinds == k, out=total[1:])
        shares.append(np.diff(total[at]) / size)
    words = np.diff(offsets)
    some, row = np.maximum(1, words), rows_of(offsets)
    keys = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    repeats = np.bincount(row[again], minlength=n)
    return np.column_stack([np.log1p(words), *shares, size / some, distinct / some, repeats / some])


def _marks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and offsets, and all features (words and prefixes of words) with their rows."""
    h, o, p, word = word_features(texts, PREFIXES)
    row = rows_of(o)
    return h, o, np.concatenate([h, p]), np.concatenate([row, row[word]])


def _counted(it):
    """For each feature in how many sampled documents of each class it is."""
    for b in it:
        for s in batches([b], SLICE_BYTES):
            _, _, f, row = _marks(s.column(2))
            order = np.lexsort((row, f))
            f, row = f[order], row[order]
            fresh = np.ones(len(f), dtype=bool)
            fresh[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
            keys, at = np.unique(f[fresh], return_inverse=True)
            columns = [pa.array(keys.view(np.int64))]
            for k in (0, 1):
                y = s.column(k).to_numpy(zero_copy_only=False).astype(float)[row[fresh]]
                columns += [pa.array(np.bincount(at[y == c], minlength=len(keys))) for c in (0.0, 1.0)]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "quality_0", "quality_1", "toxic_0", "toxic_1"])


def _measured(features: np.ndarray):
    """Statistics of the sampled documents and which of the chosen features they have."""

    def run(it):
        for b in it:
            for s in batches([b], SLICE_BYTES):
                h, o, f, row = _marks(s.column(2))
                at = np.minimum(np.searchsorted(features, f), max(0, len(features) - 1))
                hit = features[at] == f if len(features) else np.zeros(len(f), dtype=bool)
                pair = np.unique(row[hit] * max(1, len(features)) + at[hit])
                row, have = pair // max(1, len(features)), (pair % max(1, len(features))).astype(np.int32)
                ends = np.searchsorted(row, np.arange(s.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(list(statistics(s.column(2), h, o))), pa.ListArray.from_arrays(pa.array(ends), pa.array(have))], names=["quality", "toxic", "stats", "have"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights with the intercept first; Newton's method, the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, min_chi2: float = MIN_CHI2, min_df: int = MIN_DF) -> dict:
    """The model: for each target None or (mean, scale, word hashes, weights)."""
    own = OWN + "label_id"
    drawn = (
        labels.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias(own), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
        .orderBy(F.xxhash64(own, "quality", "toxic"), own)
        .limit(max_labelled)
    )
    rows = docs.select(F.col(id_col).alias(OWN + "id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), F.col(OWN + "id") == F.col(own))
    rows = checkpoint(rows.select("quality", "toxic", "text"))  # the sample, max_labelled rows or few more
    total = rows.agg(*(F.count(F.when(F.col(t) == c, 1)).alias(f"{t}_{c}") for t in TARGETS for c in (0, 1))).head()
    usable = [t for t in TARGETS if total[f"{t}_0"] and total[f"{t}_1"]]
    model: dict = {t: None for t in TARGETS}
    if not usable:
        return model
    counts = map_arrow(rows, _counted, "feature long, quality_0 long, quality_1 long, toxic_0 long, toxic_1 long")
    counts = counts.groupBy("feature").agg(*(F.sum(c).cast("double").alias(c) for c in counts.columns[1:]))
    chosen = {}
    for t in usable:
        n0, n1, a, b = float(total[f"{t}_0"]), float(total[f"{t}_1"]), F.col(f"{t}_1"), F.col(f"{t}_0")
        df = a + b
        chi2 = (n0 + n1) * (a * n0 - b * n1) ** 2 / (n1 * n0 * df * (n0 + n1 - df))
        best = counts.where((df >= min_df) & (df < n0 + n1)).withColumn("chi2", chi2).where(F.col("chi2") > min_chi2).orderBy(F.desc("chi2"), "feature").limit(max_words)
        chosen[t] = np.sort(np.array([r[0] for r in best.select("feature").collect()], dtype=np.int64).view(np.uint64))
    features = np.unique(np.concatenate([*chosen.values()]))
    got = map_arrow(rows, _measured(features), "quality double, toxic double, stats array<double>, have array<int>").toArrow()
    stats = np.array(got.column("stats").to_pylist(), dtype=float).reshape(-1, STATS)
    lists = got.column("have").combine_chunks()
    present = np.zeros((len(lists), len(features)))
    present[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    for t in usable:
        y = got.column(t).to_numpy(zero_copy_only=False).astype(float)
        use = np.isin(y, (0.0, 1.0))
        mean, scale = stats[use].mean(0), stats[use].std(0) + 1e-6
        own_columns = np.searchsorted(features, chosen[t])
        w = _logistic(np.column_stack([(stats[use] - mean) / scale, present[use][:, own_columns]]), y[use])
        model[t] = (mean, scale, chosen[t], w)
    return model


def evidence(model: dict):
    """An Arrow UDF text -> struct<quality, toxic>: probabilities from the document alone."""

    @F.arrow_udf("struct<quality:double,toxic:double>")
    def score(texts: pa.Array) -> pa.Array:
        parts = []
        for s in batches([pa.RecordBatch.from_arrays([texts], names=["t"])], SLICE_BYTES):
            h, o, f, row = _marks(s.column(0))
            stats = statistics(s.column(0), h, o)
            out = []
            for t in TARGETS:
                if model[t] is None:
                    out.append(np.full(s.num_rows, 0.5))
                    continue
                mean, scale, words, w = model[t]
                z = w[0] + ((stats - mean) / scale) @ w[1 : STATS + 1]
                if len(words):
                    at = np.minimum(np.searchsorted(words, f), len(words) - 1)
                    hit = words[at] == f
                    pair = np.unique(row[hit] * len(words) + at[hit])
                    z += np.bincount(pair // len(words), weights=w[STATS + 1 :][pair % len(words)], minlength=s.num_rows)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            parts.append(pa.StructArray.from_arrays([pa.array(x) for x in out], names=list(TARGETS)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(t, pa.float64()) for t in TARGETS]))

    return score


def _strength(n, s1, s2, s, k, square, between):
    """Pseudo-counts of the prior (method of moments) as a column: n rows, s2 the sum of squares of
    the evidence, s the sum of site sums squared over site sizes, k sites, square the sum of site
    sizes squared over those of the group, between the weighted squares about the parent's mean."""
    mean = s1 / n
    within = F.greatest((s2 - s) / F.greatest(n - k, F.lit(1.0)), F.lit(1e-9))
    spread = F.greatest((between - k * within) / F.greatest(n - square / n, F.lit(1.0)), F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(1e6))


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, chain, quality_prior, toxic_prior) from (host, path, quality, toxic), a row a site; the chain
    has for the host and each level of the path: level, n, the sums and the strengths of the priors."""
    n = F.count(F.lit(1)).cast("double")
    aggregates = [n.alias("n")]
    for t in TARGETS:
        aggregates += [F.sum(t).alias(f"{t}_1"), F.sum(F.col(t) * F.col(t)).alias(f"{t}_2")]
    own = checkpoint(scored.groupBy("host", "path").agg(*aggregates))
    numbers = [c for c in own.columns if c not in ("host", "path")]
    segments = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != "")
    keys = F.aggregate(segments, F.array(F.xxhash64("host")), lambda done, x: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), x))))
    levels = own.select("*", keys.alias("keys")).select("host", "path", *numbers, F.posexplode("keys").alias("level", "key"), "keys")
    levels = levels.select("host", "path", *numbers, "level", "key", F.when(F.col("level") > 0, F.col("keys")[F.col("level") - 1]).alias("above"))
    sums = [F.sum(c).alias(c) for c in numbers]
    nodes = checkpoint(levels.groupBy("level", "key", "above").agg(*sums))
    total = own.agg(*(F.sum(c).alias("g_" + c) for c in numbers))
    means = nodes.select((F.col("level") + 1).alias("level"), F.col("key").alias("above"), *((F.col(f"{t}_1") / F.col("n")).alias(f"{t}_above") for t in TARGETS))
    joined = nodes.join(means, ["level", "above"], "left").crossJoin(F.broadcast(total))  # one row
    square = lambda t: F.col("n") * (F.col(f"{t}_1") / F.col("n") - F.coalesce(f"{t}_above", F.col(f"g_{t}_1") / F.col("g_n"))) ** 2
    stats = joined.groupBy("level").agg(
        F.sum("n").alias("g_n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col("n") * F.col("n")).alias("square"),
        *(F.sum(f"{t}_1").alias(f"g_{t}_1") for t in TARGETS), *(F.sum(f"{t}_2").alias(f"g_{t}_2") for t in TARGETS),
        *(F.sum(F.col(f"{t}_1") ** 2 / F.col("n")).alias(f"s_{t}") for t in TARGETS), *(F.sum(square(t)).alias(f"b_{t}") for t in TARGETS),
    )
    strengths = stats.select("level", *(_strength(F.col("g_n"), F.col(f"g_{t}_1"), F.col(f"g_{t}_2"), F.col(f"s_{t}"), F.col("k"), F.col("square"), F.col(f"b_{t}")).alias(f"{t}_k") for t in TARGETS))
    step = F.struct("level", F.col("nn").alias("n"), *(F.col(f"n_{t}_1").alias(t) for t in TARGETS), *(f"{t}_k" for t in TARGETS))
    known = nodes.select("level", "key", F.col("n").alias("nn"), *(F.col(f"{t}_1").alias(f"n_{t}_1") for t in TARGETS)).join(strengths, "level")
    chains = levels.select("host", "path", "level", "key").join(known, ["level", "key"]).groupBy("host", "path").agg(F.sort_array(F.collect_list(step)).alias("chain"))
    return checkpoint(chains.crossJoin(F.broadcast(total)).select("host", "path", "chain", *((F.col(f"g_{t}_1") / F.col("g_n")).alias(f"{t}_prior") for t in TARGETS)))


def posterior(chain, prior, target: str, own=None):
    """The posterior at the end of a chain, without the evidence `own` of one of its documents."""
    one, mine = (F.lit(0.0), F.lit(0.0)) if own is None else (F.lit(1.0), own)
    return F.aggregate(chain, prior, lambda p, x: (x[target] - mine + x[f"{target}_k"] * p) / (x["n"] - one + x[f"{target}_k"]))


def _logit(c):
    p = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_labelled: int = MAX_LABELLED, broadcast_paths: int = BROADCAST_PATHS,
) -> DataFrame:
    """The documents with __lg_quality, __lg_toxic (posterior probabilities) and __lg_keep."""
    ship_package(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, max_labelled)
    site = F.regexp_replace(F.regexp_replace(F.col(source_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)[?#].*$", "")
    host, path = F.lower(F.substring_index(site, "/", 1)), F.regexp_replace(site, r"^[^/]*/?", "")
    ev = evidence(model)(F.col(text_col).cast("string"))
    scored = docs.select(host.alias("host"), path.alias("path"), ev.alias("e")).select("host", "path", "e.quality", "e.toxic")
    table = sites(scored)
    table = table.select(*(F.col(c).alias(f"{OWN}p_{c}") for c in table.columns))
    if table.count() <= broadcast_paths:
        table = F.broadcast(table)
    wide = docs.withColumns({OWN + "host": host, OWN + "path": path, OWN + "e": ev})
    wide = wide.join(table, F.col(OWN + "host").eqNullSafe(F.col(OWN + "p_host")) & F.col(OWN + "path").eqNullSafe(F.col(OWN + "p_path")), "left")
    own = {t: F.col(f"{OWN}e.{t}") for t in TARGETS}
    prior = {t: F.col(f"{OWN}p_{t}_prior") for t in TARGETS}
    moved = {t: _logit(posterior(F.col(OWN + "p_chain"), prior[t], t, own[t])) - _logit(prior[t]) for t in TARGETS}
    p = {t: 1 / (1 + F.exp(-(_logit(own[t]) + F.coalesce(moved[t], F.lit(0.0))))) for t in TARGETS}
    good = p["quality"] >= 0.5 if model["quality"] else F.lit(True)
    clean = p["toxic"] <= 0.5 if model["toxic"] else F.lit(True)
    return wide.select(*docs.columns, p["quality"].alias(OWN + "quality"), p["toxic"].alias(OWN + "toxic"), (good & clean).alias(OWN + "keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    return classify(docs, labels, **options).where(OWN + "keep").select(*docs.columns)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their posterior probabilities."""
    scored = classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).where(OWN + "keep")
    return scored.select("doc_id", "source", F.col(OWN + "quality").alias("quality"), F.col(OWN + "toxic").alias("toxic"))


ORACLE_SQL = None
