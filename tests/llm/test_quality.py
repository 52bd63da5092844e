import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm.common import OWN
from loomgraph.llm.quality import TARGETS, _marks, classify, fit, keep_good, op1_quality_classifier, posterior, sites, statistics

from .helpers import CLASHING, SCHEMA, frame, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(rng, n=400):
    """Texts, of which some have toxic words and some are junk."""
    texts, labels = [], []
    for i in range(n):
        w, toxic, quality = words(rng, rng.randrange(30, 120)), int(i % 6 == 0), int(i % 5 != 0)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "scummy", "hateful"])
        if not quality:
            w = [x + rng.choice(["###", "$$$", "%%"]) for x in w]
        texts.append(" ".join(w))
        labels.append((i, quality, toxic))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus(random.Random(3))
    df = frame(spark, texts, **CLASHING)
    seen = spark.createDataFrame([r for r in labels if r[0] < 250], LABELS)
    out = {r.doc_id: r[OWN + "keep"] for r in classify(df, seen).collect()}
    assert len(out) == len(texts)
    held = [r for r in labels if r[0] >= 250]
    assert np.mean([out[i] == (q == 1 and t == 0) for i, q, t in held]) > 0.97
    kept = keep_good(df, seen)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in out.items() if k}


def brute_posteriors(rows, without=None, only=None):
    """The same hierarchy in plain Python, for one target; `without` leaves one row's evidence out of its sums, not out of
    the strengths."""
    every = [x for _, _, x in rows]
    mean = np.mean(every)
    chain = lambda h, p: [(h,) + tuple(s for s in p.split("/") if s)[:k] for k in range(1 + sum(s != "" for s in p.split("/")))]
    nodes = {}
    for h, p, x in rows:
        for c in chain(h, p):
            nodes.setdefault(c, []).append(x)
    kappa = {}
    for level in {len(c) for c in nodes}:
        groups = {c: g for c, g in nodes.items() if len(c) == level}
        xs = [x for g in groups.values() for x in g]
        n, k = len(xs), len(groups)
        within = max((sum(x * x for x in xs) - sum(sum(g) ** 2 / len(g) for g in groups.values())) / max(n - k, 1), 1e-9)
        between = sum(len(g) * (np.mean(g) - (np.mean(nodes[c[:-1]]) if level > 1 else mean)) ** 2 for c, g in groups.items())
        spread = max((between - k * within) / max(n - sum(len(g) ** 2 for g in groups.values()) / n, 1), 1e-9)
        m = np.mean(xs)
        kappa[level] = min(max(m * (1 - m) / spread - 1, 1), 1e6)
    out = {}
    for h, p in {r[:2] for r in rows} if only is None else {only}:
        value = mean
        for c in chain(h, p):
            g, k = list(nodes[c]), kappa[len(c)]
            if without is not None:
                g.remove(without)
            value = (sum(g) + k * value) / (len(g) + k)
        out[h, p] = value
    return out


def some_sites(rng):
    rows = []
    for h in range(6):
        for p in ["", "a", "a/b", "a//c/", "d/e/f/g"][: rng.randrange(1, 6)]:
            level = rng.random()
            rows += [(f"h{h}", p, min(1.0, max(0.0, rng.gauss(level, 0.1)))) for _ in range(rng.choice((1, 2, 30)))]
    return rows


def posteriors(spark, rows, own=None):
    df = spark.createDataFrame([(h, p, x, x) for h, p, x in rows], "host string, path string, quality double, toxic double")
    return {(r.host, r.path): r.x for r in sites(df).withColumn("x", posterior(F.col("chain"), F.col("quality_prior"), "quality", own)).collect()}


def test_posteriors_against_brute_force(spark):
    rows = some_sites(random.Random(6))
    got, want = posteriors(spark, rows), brute_posteriors(rows)
    assert got.keys() == want.keys() and len({p for _, p in got}) == 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_own_evidence_is_taken_out_at_every_level(spark):
    rows = [*some_sites(random.Random(7)), ("lone", "x/y", 0.25)]
    got, want = posteriors(spark, rows, F.lit(0.25))["lone", "x/y"], brute_posteriors(rows)["lone", "x/y"]
    alone = np.mean([x for _, _, x in rows])
    assert abs(got - alone) < 1e-9 < abs(want - alone)  # nothing but the prior is left


def test_sparse_sites_shrink_and_bad_sites_sink(spark):
    rows = [("good", "", 0.9)] * 200 + [("bad", "", 0.1)] * 200 + [("new", "", 0.1)]
    q = {h: x for (h, _), x in posteriors(spark, [(h, p, x + (i % 5 - 2) * 0.02) for i, (h, p, x) in enumerate(rows)]).items()}
    assert q["bad"] < 0.2 < q["new"] < q["good"]


def test_whole_classifier_against_brute_force(spark):
    """Own evidence by the model's weights, the posteriors of all levels, and the decision, in plain Python."""
    texts, labels = corpus(random.Random(9), 150)
    df = frame(spark, texts).selectExpr("doc_id", "text", "concat('HTTPS://H', doc_id % 4, '.org/a', doc_id % 3, if(doc_id % 2 = 0, '/b?q=1', '')) source")
    lab = spark.createDataFrame(labels, LABELS)
    model = fit(df, lab)
    alone = {t: {} for t in TARGETS}
    for i, text in enumerate(texts):
        column = pa.array([text])
        h, o, f, _ = _marks(column)
        for t in TARGETS:
            mean, scale, known, w = model[t]
            x = np.concatenate([(statistics(column, h, o)[0] - mean) / scale, np.isin(known, f).astype(float)])
            alone[t][i] = 1 / (1 + np.exp(-np.clip(w[0] + w[1:] @ x, -30, 30)))
    site = lambda i: (f"h{i % 4}.org", f"a{i % 3}" + ("/b" if i % 2 == 0 else ""))
    logit = lambda p: np.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    for r in classify(df, lab).collect():
        z = {}
        for t in TARGETS:
            rows_ = [(*site(i), x) for i, x in alone[t].items()]
            mine = rows_[r.doc_id]
            only = brute_posteriors(rows_, mine[2], mine[:2])[mine[:2]]
            z[t] = logit(mine[2]) + logit(only) - logit(np.mean([x for _, _, x in rows_]))
            assert abs(r[OWN + t] - 1 / (1 + np.exp(-z[t]))) < 1e-6
        assert r[OWN + "keep"] == (z["quality"] >= 0 and z["toxic"] <= 0)


def test_nulls_empty_long_and_repeated_rows(spark):
    texts, labels = corpus(random.Random(3), 120)
    extra = [(500, None), (501, ""), (None, "good words here"), (None, "good words here"), (502, "word " * 60_000), (503, texts[0]), (503, texts[0])]
    df = frame(spark, [*texts, *extra]).selectExpr("* except (source)", "if(doc_id % 4 = 0, null, concat('http://h', doc_id % 3, '.org/p', doc_id % 2, '/x')) source")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (1, None, None), (0, 0, 1), (0, 0, 1), (9999, 1, 0)], LABELS)
    got = classify(df, lab, broadcast_paths=0).collect()
    assert len(got) == len(texts) + len(extra)
    assert all(0 < r[OWN + "quality"] < 1 and 0 < r[OWN + "toxic"] < 1 for r in got)
    assert len({r[OWN + "keep"] for r in got if r.doc_id == 503}) == 1
    same = {repr(r) for r in classify(df, lab).collect()}
    assert same == {repr(r) for r in got}


def test_no_labels_and_no_documents(spark):
    df, none = frame(spark, ["a b", None]), spark.createDataFrame([], LABELS)
    assert keep_good(df, none).count() == 2
    one_class = spark.createDataFrame([(0, 1, 0)], LABELS)
    assert keep_good(df, one_class).count() == 2
    assert keep_good(spark.createDataFrame([], SCHEMA), one_class).count() == 0


def test_query_drops_toxic_words(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in op1_quality_classifier(spark, sf).select("doc_id").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, l in labels.items() if l == (1, 0)]
    bad = [i for i, (q, t) in labels.items() if t == 1 or q == 0]
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in bad]) < 0.15
