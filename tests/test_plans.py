"""A small tree from the scan to the output, questions, diffs and the change feed."""

import json
import os
import random
import subprocess
import time
import xml.etree.ElementTree as ET
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomgraph import cli, session
from loomgraph.functions import columns as C
from loomgraph.operators import aggregate, graph, lookup, resolve
from loomgraph.plans import generate, tools
from loomgraph.render import html
from loomgraph.render.markdown import edge_lines
from loomgraph.sources import diff, files
from loomgraph.streaming import feed

NOW = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
TREE = {
    "app/models.py": "from pydantic import BaseModel\nclass User(BaseModel):\n    id: int\n    name: str | None = None\n",
    "app/service.py": "from app.models import User\ndef create_user(name: str) -> User:\n    return User(name)\ndef get_user(u: User):\n    return helper(u)\ndef helper(u):\n    return u\n",
    "app/api.py": "from app.service import create_user\n@app.post('/users')\ndef register(name):\n    return create_user(name)\ndef main():\n    register('x')\n",
    "web/view.ts": "export function show(a: string) { draw(a) }\nfunction draw(b: string) { return b }\n",
    "build/gen.py": "def hidden(): pass\n",
    "docs/readme.md": "# no code\n",
    "tool.kt": "fun unsure(a: Int) {\n}\n",
    "img.png": "x",
}


def put(folder):
    for path, text in TREE.items():
        os.makedirs(folder / os.path.dirname(path), exist_ok=True)
        (folder / path).write_text(text)
    return str(folder)


@pytest.fixture()
def tree(tmp_path):
    return put(tmp_path)


@pytest.fixture(scope="module")
def same_tree(tmp_path_factory):
    return put(tmp_path_factory.mktemp("tree"))


@pytest.fixture(scope="module")
def g(spark, same_tree):
    return generate.scan(spark, same_tree)


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_scan_and_graph(spark, same_tree, g):
    tree = same_tree
    assert names(files.source_files(spark, tree), "path") == ["app/api.py", "app/models.py", "app/service.py", "tool.kt", "web/view.ts"]
    assert names(g.symbols) == ["User", "create_user", "draw", "get_user", "helper", "main", "register", "show", "unsure"]
    assert [r.id for r in g.symbols.orderBy("id").collect()] == list(range(1, 10))
    id_of = {r["name"]: r.id for r in g.symbols.collect()}
    e = {(r.source_id, r.edge_type, r.target_name): r for r in g.edges.collect()}
    assert e[id_of["register"], "calls", "create_user"].target_id == id_of["create_user"] and e[id_of["register"], "calls", "create_user"].confidence == 0.9
    assert (id_of["create_user"], "writes", "User") in e and (id_of["get_user"], "reads", "User") in e
    assert e[id_of["User"], "extends", "BaseModel"].target_id is None and e[id_of["User"], "extends", "BaseModel"].confidence == 0.5
    assert [r.framework for r in g.data_models.collect()] == ["pydantic"]
    assert any(k[1] == "imports" and k[2] == "app.models.User" and r.target_id == id_of["User"] for k, r in e.items())
    again = generate.scan(spark, tree)
    assert sorted(map(tuple, again.edges.collect()), key=repr) == sorted(map(tuple, g.edges.collect()), key=repr)


def test_outputs(spark, same_tree, monkeypatch):
    tree = same_tree
    g = generate.scan(spark, tree)
    monkeypatch.setattr(generate, "scan", lambda *_: g)
    text = generate.generate(spark, tree, "markdown", 100_000, hot=True, narrate=True, now=NOW)
    assert "2024-05-06T07:08:09Z | 4 files" not in text and "| 5 files | 9 symbols" in text
    assert "- `register` — `app/api.py:3`" in text and "**Written by:** `create_user`" in text and "| name | str | None | yes |" in text
    assert "## Module Summaries" in text and "→ calls: `create_user`" in text
    data = json.loads(generate.generate(spark, tree, "json", 100_000, now=NOW))
    assert data["stats"]["symbols_total"] == 9 and len(data["symbols"]) == 9 and "truncated" not in data
    assert abs(sum(s["pagerank"] for s in data["symbols"]) - 1) < 1e-4
    root = ET.fromstring(generate.generate(spark, tree, "xml", 100_000, now=NOW))
    assert root.find("data_models/model").attrib["read_by"] == "get_user"
    small = json.loads(generate.generate(spark, tree, "json", 400, now=NOW))
    assert small["truncated"] and 1 <= len(small["symbols"]) < 9
    one = json.loads(generate.generate(spark, tree, "json", 1, now=NOW))
    assert len(one["symbols"]) == 1
    near = json.loads(generate.generate(spark, tree, "json", 100_000, around="helper", depth=1, now=NOW))
    assert {s["name"] for s in near["symbols"]} == {"helper", "get_user"}


def test_empty_tree(spark, tmp_path):
    (tmp_path / "a.py").write_text("")
    assert json.loads(generate.generate(spark, str(tmp_path), "json"))["symbols"] == []


def test_questions(spark, g):
    assert "`create_user`" in tools.answer(g, "what functions write to User?")
    assert "`get_user`" in tools.answer(g, "who reads User?")
    assert "`register`" in tools.related(g, "callers", "create_user")
    assert "app/service.py" in tools.answer(g, "which files import `app.models`?")
    assert "★ `main`" in tools.answer(g, "show me all entry points")
    assert "Written by: create_user" in tools.data_models(g, "user")
    assert tools.answer(g, "helper").startswith("Symbols matching")
    assert tools.route("what are the callers of create_session?") == "writers"  # 'create' is tried first
    text = tools.impact_text(g, "create_user", 2)
    assert "[direct caller] function `register`" in text and "[2 hops] function `main`" in text
    assert tools.impact_text(g, "nobody") == "Symbol 'nobody' not found." and "No callers" in tools.impact_text(g, "main")


def test_diff(spark, g, tree):
    lines = ["diff --git a/app/service.py b/app/service.py", "+++ b/app/service.py", "@@ -5,0 +5,2 @@", "@@ -9 +9,0 @@", "+++ b/other.py", "@@ -1,3 +4 @@"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "diff int, line_no int, value string")
    assert sorted(map(tuple, diff.hunks(df).collect())) == [("app/service.py", 5, 6), ("other.py", 4, 4)]
    changed, affected = tools.diff_report(g, diff.hunks(df))
    assert names(changed) == ["get_user", "helper"] and names(affected, "qualified_name") == []
    only = spark.createDataFrame([("app/service.py", 2, 2)], diff.HUNK_SCHEMA)
    changed, affected = tools.diff_report(g, only)
    assert names(changed) == ["create_user"] and names(affected, "qualified_name") == ["app.api.main", "app.api.register"]
    assert "Affected upstream: 2" in tools.format_report(changed, affected, g.symbols)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tree, check=True, capture_output=True)
    git("init"), git("add", "-A"), git("commit", "-m", "x")
    with open(os.path.join(tree, "app/api.py"), "a") as f:
        f.write("def extra():\n    pass\n")
    assert [tuple(r) for r in diff.git_diff(spark, tree, "HEAD").collect()] == [("app/api.py", 7, 8)]
    assert diff.git_diff(spark, tree, "no-such-ref").count() == 0


def test_refresh_and_change_feed(spark, tree, tmp_path_factory):
    g = generate.scan(spark, tree)
    out = str(tmp_path_factory.mktemp("feed"))
    batches = []

    def poll():
        q = feed.change_feed(spark, tree, files.EXCLUDES).writeStream.foreachBatch(lambda b, n: batches.append(sorted((r.path, r.deleted) for r in b.collect()))).option("checkpointLocation", out).trigger(processingTime="200 milliseconds").start()
        deadline = time.time() + 30
        while not batches and time.time() < deadline and q.isActive:
            time.sleep(0.2)
        q.stop()

    poll()
    assert ("app/api.py", False) in batches[0] and all("build" not in p for p, _ in batches[0])
    os.remove(os.path.join(tree, "web/view.ts"))
    with open(os.path.join(tree, "app/service.py"), "w") as f:
        f.write("def create_user(a):\n    return a\ndef fresh():\n    create_user(1)\n")
    os.utime(os.path.join(tree, "app/service.py"), (10**9, 10**9))  # older, but different
    batches.clear()
    poll()
    assert batches[0] == [("app/service.py", False), ("web/view.ts", True)]
    new = generate.refresh(g, files.source_files(spark, tree))
    full = generate.scan(spark, tree)
    assert names(new.symbols, "qualified_name") == names(full.symbols, "qualified_name")
    key = lambda x: sorted((r.edge_type, r.target_name, r.confidence) for r in x.edges.collect())
    assert key(new) == key(full) and "fresh" in names(new.symbols)


def test_cli(spark, g, same_tree, capsys, tmp_path, monkeypatch):
    tree = same_tree
    monkeypatch.setattr(generate, "scan", lambda *_: g)
    monkeypatch.setattr(cli, "scan", lambda *_: g)
    assert cli.main(["stats", "--root", tree], spark) == 0 and "symbols: 9" in capsys.readouterr().out
    assert cli.main(["generate", "--root", tree, "--format", "all", "--output", str(tmp_path / "map")], spark) == 0
    assert {p.suffix for p in tmp_path.iterdir() if p.name.startswith("map")} == {".md", ".json", ".xml"}
    assert cli.main(["visual", "--root", tree, "--output", str(tmp_path / "v.html")], spark) == 0
    assert "create_user" in (tmp_path / "v.html").read_text()
    assert cli.main(["ask", "callers of `helper`", "--root", tree], spark) == 0 and "get_user" in capsys.readouterr().out


def test_resolution_tiers(spark):
    s = spark.createDataFrame([(1, "one", "a.one", "fa"), (2, "dup", "a.dup", "fa"), (3, "dup", "b.dup", "fb"), (4, "dup", "c.dup", "fc"), (5, "deep", "x.y.deep", "fd"), (6, "print", "a.print", "fa")], "id long, name string, qualified_name string, file_path string")
    cases = [(10, 1, "one"), (11, 3, "dup"), (12, 1, "b.dup"), (13, 5, "dup"), (14, 1, "y.deep"), (15, 1, "print"), (16, 1, "nothing"), (17, 1, "os.path")]
    e = spark.createDataFrame(cases, "edge_id long, source_id long, target_name string").withColumn("edge_type", F.lit("calls"))
    got = {r.edge_id: (r.target_id, r.confidence) for r in resolve.resolve(e, s).collect()}
    assert got == {10: (1, 0.9), 11: (3, 0.9), 12: (3, 1.0), 13: (2, 0.7), 14: (5, 0.9), 15: (None, 0.5), 16: (None, 0.5), 17: (None, 0.5)}
    tail = {r.edge_id: (r.target_id, r.confidence) for r in resolve.suffix(e, s).collect()}
    assert tail[14] == (5, 0.8) and tail[13] == (2, 0.8) and 16 not in tail


def test_access_predicates(spark):
    cases = [("create_user", "", True, False), ("f", "() -> User", True, False), ("get_user", "(x: User)", False, True), ("make_get_user", "", True, True), ("address", "", False, False), ("f", "(x: UserCreate)", False, True)]
    df = spark.createDataFrame([(n, s) for n, s, _, _ in cases], "n string, s string")
    got = df.select(C.writes_model(F.col("n"), F.col("s"), F.lit("User")).alias("w"), C.reads_model(F.col("n"), F.col("s"), F.lit("User")).alias("r")).collect()
    assert [(r.w, r.r) for r in got] == [(w, r) for _, _, w, r in cases]
    strict = df.select(C.reads_model(F.col("n"), F.col("s"), F.lit("User"), True).alias("r")).collect()
    assert [r.r for r in strict] == [False, False, True, True, False, False]


def test_pagerank_properties(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    r = {x.id: x.pagerank for x in graph.pagerank(nodes, ring).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and abs(r[0] - r[1]) < 1e-6 and r[3] < r[0]
    p = {x.id: x.pagerank for x in graph.pagerank(nodes, ring, personal=spark.createDataFrame([(3, 1.0)], "id long, weight double")).collect()}
    assert p[3] > 0.9 and abs(sum(p.values()) - 1) < 1e-9
    assert graph.pagerank(nodes.limit(0), ring).count() == 0
    for options in ({"rounds": 7, "tolerance": None}, {"rounds": 7, "tolerance": None, "personal": spark.createDataFrame([(1, 2.0), (3, 1.0)], "id long, weight double")}):
        small, large = ({x.id: round(x.pagerank, 12) for x in graph.pagerank(nodes, ring, local_links=k, **options).collect()} for k in (100, 0))
        assert small == large


def checkpointed(monkeypatch, *modules):
    """Gets what the modules checkpoint."""
    frames = []
    for m in modules:
        monkeypatch.setattr(m, "checkpoint", lambda df: frames.append(df) or session.checkpoint(df), raising=False)
    return frames


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_pagerank_rounds_have_small_plans(spark, monkeypatch):
    """a plan over five rounds named the first state hundreds of times."""
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    links = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(1, 0), (2, 0), (3, 1)], "src long, dst long")
    frames = checkpointed(monkeypatch, graph)
    got = []
    for chunk, local in ((1024, 100), (1024, 0), (2, 0), (2, 100)):  # the links of 0 fill several rows at 2
        monkeypatch.setattr(graph, "CHUNK", chunk)
        got.append({r.id: round(r.pagerank, 12) for r in graph.pagerank(nodes, links, rounds=7, tolerance=None, local_links=local).collect()})
    assert len(got[0]) == 7 and all(g == got[0] for g in got)
    assert max(map(leaves, frames)) <= 4


def test_pagerank_of_a_large_graph_has_no_checkpoint_a_round(spark, monkeypatch):
    """a round of a graph of more than `local_links` links wrote, sorted and joined all nodes and links."""
    rng = random.Random(5)
    ids = [i * i * 10**7 for i in range(60)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    pairs = {(rng.choice(ids[:50]), rng.choice(ids)) for _ in range(300)}
    links = spark.createDataFrame([(a, b, rng.random()) for a, b in pairs] + [(3, ids[0], 1.0), (ids[0], -3, 1.0), (None, ids[1], 1.0), (ids[1], None, 1.0), (10**15, 10**16, 1.0)], "src long, dst long, weight double")
    frames = checkpointed(monkeypatch, graph)
    for options in ({}, {"personal": spark.createDataFrame([(ids[3], 1.0), (ids[9], 2.0), (-1, 5.0)], "id long, weight double")}):
        want = {x.id: x.pagerank for x in graph.pagerank(nodes, links, rounds=12, tolerance=None, local_links=0, **options).collect()}
        del frames[:]
        for block in (1 << 18, 20):
            monkeypatch.setattr(graph, "BLOCK", block)
            for local in (1, 1000):
                got = {x.id: x.pagerank for x in graph.pagerank(nodes, links, rounds=12, tolerance=None, local_links=local, **options).collect()}
                assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-13 for i in ids)
        assert len(frames) <= 4 * 4
    few = graph.pagerank(nodes, links, rounds=12, tolerance=None, local_links=1, held_nodes=10)  # and by joins if its nodes are too many to hold
    assert {x.id: round(x.pagerank, 12) for x in few.collect()} == {x.id: round(x.pagerank, 12) for x in graph.pagerank(nodes, links, rounds=12, tolerance=None, local_links=0).collect()}
    assert graph.pagerank(nodes, links.limit(0), local_links=1).count() == 60


def test_path_counts_by_brute_force(spark):
    """300 entry points in a chain that ends in a ring, within few calls; their bits fill several longs."""
    n, ring = 300, 20
    s = spark.createDataFrame([(i, i < n) for i in range(n + ring)], "id long, is_entry_point boolean")
    calls = [(i, i + 1) for i in range(n + ring - 1)] + [(n + ring - 1, n)]
    e = spark.createDataFrame([(a, b, "calls") for a, b in calls], "source_id long, target_id long, edge_type string")
    for hops in (3, 8):
        want = {}
        for i in range(n):
            seen = at = {i}
            for _ in range(hops):
                at = {b if b < n + ring else n for a in at for b in [a + 1]}
                seen = seen | at
            for x in seen:
                want[x] = want.get(x, 0) + 1
        assert {r.id: r.entries for r in graph.path_counts(s, e, hops).collect()} == want


def test_impact_of_a_diamond_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (0, 4)], "source_id long, target_id long")
    seed = spark.createDataFrame([(0,)], "id long")
    for depth, want in ((1, {1: 1, 2: 1}), (2, {1: 1, 2: 1, 3: 2}), (9, {1: 1, 2: 1, 3: 2, 4: 3})):
        assert {r.id: r.hop for r in graph.impact(seed, e, depth).collect()} == want


def test_hot_paths_with_a_shared_tail(spark):
    s = spark.createDataFrame([(i, i in (0, 1)) for i in range(6)], "id long, is_entry_point boolean")
    e = spark.createDataFrame([(0, 2, "calls"), (1, 2, "calls"), (2, 3, "calls"), (0, 4, "calls"), (4, 5, "reads")], "source_id long, target_id long, edge_type string")
    assert {r.id: r.entries for r in graph.path_counts(s, e).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 1}
    assert {r.id for r in graph.hot_paths(s, e).collect()} == {2, 3}


def test_hot_paths_hold_no_row_for_each_pair(spark, monkeypatch):
    """200 entry points call a hub that calls 50 nodes, of which a round held 10,000 pairs."""
    n, fan = 200, 50
    s = spark.createDataFrame([(i, i < n) for i in range(n + 1 + fan)], "id long, is_entry_point boolean")
    calls = [(i, n) for i in range(n)] + [(n, n + 1 + i) for i in range(fan)]
    e = spark.createDataFrame([(a, b, "calls") for a, b in calls], "source_id long, target_id long, edge_type string")
    frames = checkpointed(monkeypatch, graph)
    assert {r.id: r.entries for r in graph.hot_paths(s, e).collect()} == {n + i: n for i in range(fan + 1)}
    assert max(f.count() for f in frames) < n * fan / 5


def test_hot_paths_take_no_round_for_each_call(spark, monkeypatch):
    """a chain of 19 calls took 19 rounds over all nodes that were reached, each with its checkpoint."""
    s = spark.createDataFrame([(i, i % 19 == 0) for i in range(60)], "id long, is_entry_point boolean")
    e = spark.createDataFrame([(i, i + 1, "calls") for i in range(59)], "source_id long, target_id long, edge_type string")
    frames = checkpointed(monkeypatch, graph)
    assert {r.id: r.entries for r in graph.hot_paths(s, e).collect()} == {i: 1 + (i in (19, 38, 57)) for i in range(60)}
    assert len(frames) <= 4


def test_path_counts_by_both_ways(spark):
    """Many calls with cycles, loops, copies, unknown sources and targets, a source without id, gaps in the ids, and no entry at all."""
    rng = random.Random(7)
    ids = [i * i * 10**7 for i in range(80)]
    s = spark.createDataFrame([(i, k % 7 == 0) for k, i in enumerate(ids)], "id long, is_entry_point boolean")
    calls = [(rng.choice(ids + [-5, None]), rng.choice(ids + [-6]), rng.choice(["calls", "calls", "reads"])) for _ in range(140)]
    e = spark.createDataFrame(calls + [(-5, ids[3], "calls"), (ids[0], None, "calls")], "source_id long, target_id long, edge_type string")
    known = set(ids)
    after = {}
    for a, b, kind in calls:
        if kind == "calls" and b in known:
            after.setdefault(a, set()).add(b)
    for hops in (0, 1, 4, 19):
        want = {}
        for i in ids[::7]:
            seen = {i}
            for _ in range(hops):
                seen = seen.union(*(after.get(x, ()) for x in seen))
            for x in seen:
                want[x] = want.get(x, 0) + 1
        for held in (0, 50, 1000):
            assert {r.id: r.entries for r in graph.path_counts(s, e, hops, held).collect()} == want
    for held in (0, 1000):
        assert graph.path_counts(s.where("id < 0"), e, 19, held).count() == 0
        assert graph.path_counts(s, e.limit(0), 19, held).count() == 12


def test_globs_and_edges(spark):
    paths = ["build/a.py", "src/build/a.py", "src/rebuild/a.py", "README.md", "x.min.js", "a/node_modules/b.js", "a.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.where(~C.glob_excluded(F.col("p"), files.EXCLUDES)).collect()] == ["src/rebuild/a.py", "a.py"]
    many = [{"edge_type": "calls", "arrow": "→", "target_qualified_name": f"a.f{i}"} for i in range(12)]
    assert edge_lines(many) == ["→ calls: " + ", ".join(f"`f{i}`" for i in range(8))]


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text("[tool.loomgraph]\nmax_tokens = 7\nother = 1\n")
    (tmp_path / ".loomgraph.toml").write_text("tier = '2'\n")
    c = files.Config.load(str(tmp_path))
    assert (c.max_tokens, c.tier, c.output_format) == (7, "2", "markdown")
    assert files.project_root(str(tmp_path)) == str(tmp_path) and [files.tier(n) for n in (5, 1000, 10_000)] == [1, 2, 3]


def test_threshold_rule(spark):
    counts = spark.createDataFrame([(c,) for c in (9, 7, 7, 5, 3, 1, 1, 1, 1, 1)], "c long")
    assert aggregate.nth_largest(counts, "c", 0.2).head()[0] == 7
    assert aggregate.nth_largest(counts.limit(1), "c", 0.2).head()[0] == 9


def test_html_escapes(spark):
    n = spark.createDataFrame([(1, "</script>", "q", "class", "a/b.py", 0.5)], "id long, name string, qualified_name string, kind string, file_path string, pagerank double")
    e = spark.createDataFrame([], "edge_id long, source_id long, target_id long, edge_type string, confidence double")
    assert html.page(n, e).count("</script>") == 1


def test_stale_and_lookup(spark):
    f = spark.createDataFrame([("new", 1.0), ("same", 2.0), ("older", 1.0)], "path string, mtime double")
    k = spark.createDataFrame([("same", 2.0), ("older", 5.0), ("gone", 1.0)], "path string, mtime double")
    assert names(lookup.stale(f, k), "path") == ["new", "older"] and names(lookup.deleted(f, k), "path") == ["gone"]
