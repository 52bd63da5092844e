"""Every query with SQL against DuckDB, at the smallest scale."""

import glob
import json
import os

import duckdb
import pytest

from loomgraph import catalogue, session
from loomgraph.catalogue import ORACLES, QUERIES
from loomgraph.operators import graph


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_records_without_sql(spark, sf_dir):
    assert QUERIES["snk8_json_records"](spark, sf_dir).count() == QUERIES["src4_symbols"](spark, sf_dir).count()


def test_suffix_of_all_edges_by_brute_force(spark, sf_dir):
    symbols = QUERIES["src4_symbols"](spark, sf_dir)
    sym = {r["id"]: r["qualified_name"] for r in symbols.collect()}
    by = {}
    for i, q in sym.items():
        parts = q.split(".")
        for k in range(1, len(parts)):
            t = ".".join(parts[k:])
            by[t] = min(by.get(t, i), i)
    want = {}
    for r in catalogue.edges(spark, sf_dir).where("target_id is not null").collect():
        if r.target_id in sym and (t := by.get(".".join(sym[r.target_id].split(".")[-2:]))) is not None:
            want[r.edge_id] = (t, 0.8)
    assert len(want) > QUERIES["j5_suffix"](spark, sf_dir).count()
    assert {r.edge_id: (r.target_id, r.confidence) for r in QUERIES["j5_suffix_all"](spark, sf_dir).collect()} == want


def test_records_have_their_ranks(spark, sf_dir):
    ranks = {r.id: r.pagerank for r in QUERIES["g7_pagerank_10"](spark, sf_dir).collect()}
    got = {r.id: json.loads(r.record)["pagerank"] for r in QUERIES["snk8_json_records"](spark, sf_dir).collect()}
    assert got.keys() == ranks.keys() and max(got.values()) > 0
    assert all(abs(got[i] - v) < 1e-6 for i, v in ranks.items())


def test_personalised_rank_reads_its_edges_once(spark, sf_dir, monkeypatch):
    """the links were computed for the matrix and again for each side of the restart."""
    frames = []
    for m in (catalogue, graph):
        monkeypatch.setattr(m, "checkpoint", lambda df: frames.append(df) or session.checkpoint(df), raising=False)
    assert QUERIES["g9_personalised_10_by_joins"](spark, sf_dir).count() == QUERIES["src4_symbols"](spark, sf_dir).count()
    plans = [f._jdf.queryExecution().analyzed().collectLeaves() for f in frames]
    assert sum("l_orderkey" in p.apply(k).output().toString() for p in plans for k in range(p.size())) == 1


def test_records_of_a_large_graph(spark, sf_dir, monkeypatch):
    """the ranks of the records by joins have small plans too, and the same values."""
    ranks = {r.id: r.pagerank for r in QUERIES["g7_pagerank_10"](spark, sf_dir).collect()}
    frames, ranked = [], catalogue._ranked
    monkeypatch.setattr(catalogue, "_ranked", lambda *a: ranked(*a, local_links=0))
    monkeypatch.setattr(graph, "checkpoint", lambda df: frames.append(df) or session.checkpoint(df))
    got = {r.id: json.loads(r.record)["pagerank"] for r in QUERIES["snk8_json_records"](spark, sf_dir).collect()}
    assert got.keys() == ranks.keys() and all(abs(got[i] - v) < 1e-6 for i, v in ranks.items())
    assert max(f._jdf.queryExecution().analyzed().collectLeaves().size() for f in frames) <= 4


def test_records_of_a_large_graph_need_no_join_a_round(spark, sf_dir, monkeypatch):
    """ten rounds by joins wrote ten checkpoints."""
    ranks = {r.id: r.pagerank for r in QUERIES["g7_pagerank_10_by_joins"](spark, sf_dir).collect()}
    frames, ranked = [], catalogue._ranked
    monkeypatch.setattr(catalogue, "_ranked", lambda *a: ranked(*a, local_links=1))
    monkeypatch.setattr(graph, "checkpoint", lambda df: frames.append(df) or session.checkpoint(df))
    got = {r.id: json.loads(r.record)["pagerank"] for r in QUERIES["snk8_json_records"](spark, sf_dir).collect()}
    assert got.keys() == ranks.keys() and all(abs(got[i] - v) < 1e-6 for i, v in ranks.items())
    assert len(frames) <= 3
