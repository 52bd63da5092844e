import random
import subprocess
import sys

import corpus_pipeline
import duckdb
import pytest

from loomgraph.llm import queries as llm_queries
from loomgraph.llm.common import WORD_RE
from loomgraph.llm.quality import classify

from .helpers import frame, words
from .test_decontaminate import brute as brute_leaks
from .test_exact_dedup import brute as brute_copies
from .test_near_dedup import brute as brute_near
from .test_packing import best_fit, bins_of


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with toxic texts, junk, copies, near copies and benchmark passages."""
    rng, folder = random.Random(12), tmp_path_factory.mktemp("sf")
    items = [" ".join(words(rng, 15, 10**6)) for _ in range(4)]
    texts, labels = [], []
    for i in range(260):
        w, toxic, quality = words(rng, rng.randrange(25, 90), 10**5), int(i % 7 == 0), int(i % 5 != 0)
        if toxic:
            w[3:3] = ["vile", "hateful"]
        if not quality:
            w = [x + "###" for x in w]
        texts.append(" ".join(w))
        labels.append((i, quality, toxic))
    for k in range(40):
        base = texts[rng.randrange(260)].split()
        if k % 3 == 0:
            base[rng.randrange(len(base))] = f"edit{k}"
        elif k % 3 == 1:
            base[5:5] = items[k % 4].split()
        texts.append(" ".join(base))
    texts += [None, "", "a", "a", "x " * 5000]
    frame(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages_against_brute_force(spark, small):
    folder, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, columns, checked = [n for n, _ in corpus_pipeline.STAGES], docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, folder)
        if k == 0:
            want = {r.doc_id for r in classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("__lg_keep").collect()}
            bad = {i for i, t in rows if t and ({"vile", "hateful"} & set(t.split()) or "###" in t)}
            assert not want & bad and len(want) > 0.9 * (len(rows) - len(bad))
        elif k == 1:
            want = {*brute_copies(rows).values()} | {i for i, t in rows if t is None}
        elif k == 2:
            near, _ = brute_near([t for _, t in rows])
            want = {d for i, (d, _) in enumerate(rows) if near.get(i, i) == i}
        elif k == 3:
            leaks = {d for d, _ in brute_leaks([t for _, t in rows], items)}
            want = {d for i, (d, _) in enumerate(rows) if i not in leaks}
        else:
            lengths = [len(WORD_RE.findall((t or "").lower())) for _, t in rows]
            pieces = [min(2048, n - s) for n in lengths for s in range(0, n, 2048)]
            assert bins_of(out.collect()) == best_fit(pieces, 2048)
            continue
        assert out.columns == columns
        out.write.mode("overwrite").parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        got = {r.doc_id for r in docs.collect()}
        assert got == want, name
        checked.append(len(got))
    assert names == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert checked == sorted(checked, reverse=True) and len(set(checked)) == 4  # each stage takes something out


def test_run_is_the_stages_in_a_row(spark, small):
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/again{k}")
        docs = spark.read.parquet(f"{folder}/again{k}")
    show = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length").collect()))
    assert show(corpus_pipeline.run(spark, folder)) == show(docs)


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_oracle_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(llm_queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = llm_queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(found.fetchall())


def test_one_query_for_each_operator():
    numbers = sorted(int(n.split("_")[0][2:]) for n in llm_queries.QUERIES)
    assert numbers == list(range(1, 11))


def test_the_rest_stands_without_this_package(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') or k == 'pipeline' for k in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
