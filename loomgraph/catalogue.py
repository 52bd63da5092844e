"""Registered queries over the driver's tables and their oracle SQL (DuckDB).

Each runs an operator of the library over the graph view of whole tables.  Keys begin with the operator's
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .graph_view import GRAPH_SQL, data_models, edges, symbols, table
from .operators import aggregate, graph, lookup, resolve
from .session import checkpoint, ship_package
from .streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GLOBS = ["**/en/**", "**/build/**", "**/*.min.js"]
PAGERANK_ROUNDS = 10


def query(sql: str | None = None, graph_view: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (GRAPH_SQL + sql) if graph_view else sql
        return f

    return register


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(n).cast("long").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty symbols with the most incoming resolved edges."""
    counts = lookup.resolved(edges(spark, sf_dir)).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return counts.join(symbols(spark, sf_dir), "id").select("id", "name", "kind", "in_degree").orderBy(F.desc("in_degree"), "id").limit(20)


@query("select s.id, s.name, s.kind, count(*) in_degree from edg e join sym s on s.id = e.target_id group by 1, 2, 3 order by in_degree desc, s.id limit 20")
def flagship_in_degree(spark, sf):
    return flagship(spark, sf)


# scans, filters, lookups


@query('select id, name, qualified_name, kind, file_path, line_start, line_end, signature, "language", is_entry_point from sym')
def src4_symbols(spark, sf):
    return _longs(symbols(spark, sf).drop("bases", "decorators"))


@query("select * from edg")
def src4_edges(spark, sf):
    return edges(spark, sf)


@query("select * from edg where target_id is null")
def src5_unresolved_edges(spark, sf):
    return lookup.unresolved(edges(spark, sf))


@query("select id, qualified_name from sym where name = 'red widget'")
def src6_lookup_by_name(spark, sf):
    return lookup.by_name(symbols(spark, sf), "red widget").select("id", "qualified_name")


@query("select id, name from sym where file_path = 'Brand#7'")
def src6_lookup_by_file(spark, sf):
    return lookup.by_file(symbols(spark, sf), "Brand#7").select("id", "name")


@query("select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as path from pages where not regexp_matches('/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/en/|/build/|/[^/]*[.]min[.]js$')", False)
def f1_glob_exclude(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path")).where(~C.glob_excluded(F.col("path"), GLOBS))


@query("select edge_id, target_name from edg where target_name not in ('red widget', 'blue bolt') and split_part(target_name, '.', 1) not in ('small ring')")
def f5_builtin_skip(spark, sf):
    return lookup.without_builtins(edges(spark, sf), frozenset({"red widget", "blue bolt"}), frozenset({"small ring"})).select("edge_id", "target_name")


def _related_sql(kind: str, text: str) -> str:
    return f"select e.edge_id, s.name, s.kind, s.file_path, s.line_start, e.target_name as target from edg e join sym s on s.id = e.source_id where edge_type = '{kind}' and lower(target_name) like '%{text}%' order by edge_id limit 50"


@query(_related_sql("calls", "widget"))
def f9_callers(spark, sf):
    return _longs(lookup.related(symbols(spark, sf), edges(spark, sf), "calls", "Widget"))


@query(_related_sql("reads", "bolt"))
def f9_readers(spark, sf):
    return _longs(lookup.related(symbols(spark, sf), edges(spark, sf), "reads", "bolt"))


@query(_related_sql("writes", "ring"))
def f9_writers(spark, sf):
    return _longs(lookup.related(symbols(spark, sf), edges(spark, sf), "writes", "RING"))


@query("select id, name, kind, file_path, line_start from sym where lower(name) like '%red%' or lower(qualified_name) like '%red%' order by id limit 30")
def f10_search(spark, sf):
    return _longs(lookup.search(symbols(spark, sf), "Red"))


@query("select id, name from sym where decorator like '%route%' or name = 'main'")
def f15_entry_points(spark, sf):
    return symbols(spark, sf).where(C.entry_point(F.col("name"), F.col("decorators"))).select("id", "name")


@query("select symbol_id, framework from dm")
def f16_frameworks(spark, sf):
    return data_models(spark, sf)


# extraction and edges from lists


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as link, unnest(range(1, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) + 1)) as nth from pages", False)
def x8_regex_extract(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("pos", "link")).select("page_id", "link", (F.col("pos") + 1).cast("long").alias("nth"))


@query("select id as source_id, base as target_name, 'extends' as edge_type from sym union all select distinct id, unnest(string_split(lower(name), ' ')), 'calls' from sym")
def x11_explode_refs(spark, sf):
    s = symbols(spark, sf)
    calls = s.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("target_name"), F.lit("calls").alias("edge_type"))
    return s.select(F.col("id").alias("source_id"), F.explode("bases").alias("target_name"), F.lit("extends").alias("edge_type")).unionByName(calls)


# joins


@query("select symbol_id, framework, name, qualified_name, file_path, line_start from dm join sym on sym.id = dm.symbol_id")
def j1_models_join(spark, sf):
    return _longs(lookup.models(symbols(spark, sf), data_models(spark, sf)))


@query("select id, name, kind, framework from sym left join dm on dm.symbol_id = sym.id")
def j7_nodes_with_models(spark, sf):
    return lookup.nodes(symbols(spark, sf), data_models(spark, sf)).select("id", "name", "kind", "framework")


def _dotted(spark, sf):
    """Targets as whole qualified names of the part with the edge's number."""
    s = symbols(spark, sf).select(F.col("id").alias("to"), "qualified_name")
    return edges(spark, sf).where("target_id is not null").join(s, F.col("target_id") == F.col("to")).select("edge_id", "source_id", F.col("qualified_name").alias("target_name"))


@query("select e.edge_id, max(t.id) as target_id, 1.0::double as confidence from edg e join sym s on s.id = e.target_id join sym t on t.qualified_name = s.qualified_name group by 1")
def j3_exact(spark, sf):
    return resolve.exact(_dotted(spark, sf), symbols(spark, sf))


@query("""select edge_id, target_id, confidence from (
  select e.edge_id, t.id as target_id, case when count(*) over (partition by e.edge_id) = 1 or t.file_path = s.file_path then 0.9 else 0.7 end::double as confidence,
    row_number() over (partition by e.edge_id order by case when t.file_path = s.file_path then 0 else 1 end, t.id) rn
  from edg e left join sym s on s.id = e.source_id join sym t on t.name = e.target_name where e.target_id is null) where rn = 1""")
def j4_ranked(spark, sf):
    return resolve.ranked(lookup.unresolved(edges(spark, sf)), symbols(spark, sf))


@query("""select e.edge_id, min(t.id) as target_id, 0.8::double as confidence from edg e join sym s on s.id = e.target_id
  join sym t on ends_with(t.qualified_name, '.' || split_part(s.qualified_name, '.', 2) || '.' || s.name) where e.edge_type = 'calls' group by 1""")
def j5_suffix(spark, sf):
    """Suffix resolution of the edges of type 'calls' only, as its SQL has it; `j5_suffix_all` is of all edges."""
    d = _dotted(spark, sf).join(edges(spark, sf).where("edge_type = 'calls'").select("edge_id"), "edge_id", "left_semi")
    return _suffix(spark, sf, d)


@query()
def j5_suffix_all(spark, sf):
    """Suffix resolution of the resolved edges of every type."""
    return _suffix(spark, sf, _dotted(spark, sf))


def _suffix(spark, sf, d):
    tail = F.concat_ws(".", F.element_at(F.split("target_name", r"\."), -2), F.element_at(F.split("target_name", r"\."), -1))
    return resolve.suffix(d.withColumn("target_name", tail), symbols(spark, sf))


@query("""select e.edge_id, coalesce(x.target_id, null) as target_id, coalesce(x.confidence, 0.5)::double as confidence from edg e left join (
  select edge_id, target_id, confidence from (
    select e.edge_id, t.id as target_id, case when count(*) over (partition by e.edge_id) = 1 or t.file_path = s.file_path then 0.9 else 0.7 end as confidence,
      row_number() over (partition by e.edge_id order by case when t.file_path = s.file_path then 0 else 1 end, t.id) rn
    from edg e left join sym s on s.id = e.source_id join sym t on t.name = e.target_name) where rn = 1) x on x.edge_id = e.edge_id""")
def j4_resolve_all(spark, sf):
    return resolve.resolve(edges(spark, sf), symbols(spark, sf)).select("edge_id", "target_id", "confidence")


_ACCESS = """select f.id as source_id, m.symbol_id as target_id, m.name as target_name, case when w then 'writes' else 'reads' end as edge_type, 0.8::double as confidence from (
  select f.id, m.name, m.symbol_id,
    contains(f.signature, '-> ' || m.name) or contains(lower(f.signature), '-> list[' || m.name) or (regexp_matches(lower(f.name), 'add|build|create|insert|make|new|save') and (contains(lower(f.name), lower(m.name)) or contains(lower(f.signature), lower(m.name)))) as w,
    contains(f.signature, ': ' || m.name) or contains(lower(f.signature), ': list[' || m.name) or (regexp_matches(lower(f.name), 'fetch|find|get|list|load|parse|read') and (contains(lower(f.name), lower(m.name)) or contains(lower(f.signature), lower(m.name)))) as r
  from sym f, (select s.name, max(d.symbol_id) as symbol_id from dm d join sym s on s.id = d.symbol_id group by 1) m
  where f.kind in ('function', 'method')) q"""


@query(_ACCESS.replace("f.id as source_id, m.symbol_id as target_id, m.name as target_name", "id as source_id, symbol_id as target_id, name as target_name", 1) + " where w or r")
def j6_read_write_inference(spark, sf):
    return resolve.infer_access(symbols(spark, sf), data_models(spark, sf))


@query("""select edge_id, source_id, target_id, coalesce(s.qualified_name, '') as source_qualified_name, coalesce(t.qualified_name, target_name) as target_qualified_name, edge_type, e.confidence::double as confidence,
  case when e.confidence >= 0.9 then '→' else '?→' end as arrow from edg e left join sym s on s.id = e.source_id left join sym t on t.id = e.target_id""")
def j8_edge_view(spark, sf):
    return lookup.edge_view(symbols(spark, sf), edges(spark, sf))


def _hunks(spark, sf):
    """Changed ranges: each supplier changes some lines of the file of its number."""
    s = table(spark, sf, "supplier")
    start = (F.col("s_suppkey") * 37 % 2000).cast("int")
    return s.select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("file_path"), start.alias("rng_start"), (start + F.col("s_nationkey") % 5).cast("int").alias("rng_end"))


@query("""select min(id) as id, qualified_name from sym where exists (select 1 from supplier where 'Brand#' || (s_suppkey % 25 + 1) = sym.file_path
  and sym.line_start <= s_suppkey * 37 % 2000 + s_nationkey % 5 and sym.line_end >= s_suppkey * 37 % 2000) group by qualified_name""")
def j9_interval_overlap(spark, sf):
    return lookup.overlapping(symbols(spark, sf), _hunks(spark, sf)).select("id", "qualified_name")


@query("select e.edge_id from edg e where e.source_id in (select id from sym where kind = 'function') and (target_id is null or target_id in (select id from sym where kind = 'function'))")
def j10_induced_edges(spark, sf):
    return lookup.induced(edges(spark, sf), symbols(spark, sf).where("kind = 'function'")).select("edge_id")


@query("select e.edge_id from edg e where e.source_id in (select id from sym where kind <> 'class') and target_id in (select id from sym where kind <> 'class')")
def j11_closed_edges(spark, sf):
    return lookup.closed(edges(spark, sf), symbols(spark, sf).where("kind <> 'class'")).select("edge_id")


def _snapshots(spark, sf):
    o = table(spark, sf, "orders")
    path = F.col("o_orderkey").cast("string").alias("path")
    return o.where("o_orderkey % 11 <> 0").select(path, F.col("o_totalprice").alias("mtime")), o.where("o_orderkey % 7 <> 0").select(path, F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("mtime"))


@query("select cast(o_orderkey as varchar) as path, o_totalprice as mtime from orders where o_orderkey % 11 <> 0 and (o_orderkey % 7 = 0 or o_orderkey % 5 = 0)", False)
def j13_stale_files(spark, sf):
    return lookup.stale(*_snapshots(spark, sf))


@query("select cast(o_orderkey as varchar) as path from orders where o_orderkey % 11 = 0 and o_orderkey % 7 <> 0", False)
def j13_deleted_files(spark, sf):
    return lookup.deleted(*_snapshots(spark, sf)).select("path")


@query("""select file_path, "at", owner_id, owner from (select c.file_path, c."at", s.id as owner_id, s.name as owner, row_number() over (partition by c.file_path, c."at" order by s.line_end - s.line_start, s.id) rn
  from (select distinct file_path, line_end as "at" from sym) c join sym s on s.file_path = c.file_path and c."at" between s.line_start and s.line_end) where rn = 1""")
def j14_innermost_range(spark, sf):
    s = symbols(spark, sf)
    return _longs(lookup.innermost(s.select("file_path", F.col("line_end").alias("at")).distinct(), s.select("file_path", "id", "name", "line_start", "line_end")))


@query("select a.id, b.id as other_id from sym a join sym b on a.file_path = b.file_path and a.kind = 'function' and b.kind = 'class' and abs(a.line_start - b.line_start) < 20")
def j16_proximity(spark, sf):
    s = symbols(spark, sf).select("file_path", "id", "kind", F.col("line_start").alias("at"))
    return lookup.proximate(s.where("kind = 'function'"), s.where("kind = 'class'"), 20)


@query("""select dm.symbol_id, dm.framework, coalesce(string_agg(s.name, ',' order by e.edge_id) filter (where e.edge_type = 'reads'), '') as readers,
  coalesce(string_agg(s.name, ',' order by e.edge_id) filter (where e.edge_type = 'writes'), '') as writers
  from dm left join edg e on e.target_id = dm.symbol_id left join sym s on s.id = e.source_id group by 1, 2""")
def j20_model_readers_writers(spark, sf):
    return lookup.readers_writers(symbols(spark, sf), edges(spark, sf), data_models(spark, sf))


# aggregates


@query("select (select count(*) from sym) as symbols, (select count(*) from edg) as edges, (select count(*) from edg where target_id is null) as unresolved, (select count(*) from dm) as data_models")
def a1_stats(spark, sf):
    return aggregate.stats(symbols(spark, sf), edges(spark, sf), data_models(spark, sf))


@query("select count(distinct file_path) as files from sym")
def a2_files(spark, sf):
    return symbols(spark, sf).agg(F.countDistinct("file_path").alias("files"))


@query("select file_path, count(*) as symbols, string_agg(name, ',' order by line_start, id) as names from sym group by 1")
def a3_by_file(spark, sf):
    return aggregate.by_file(symbols(spark, sf))


_PROFILE = """select n.file_path as module, total, entries, classes, functions, methods, models, coalesce(reads, 0) as reads, coalesce(writes, 0) as writes, coalesce(calls, 0) as calls from (
  select file_path, count(*) as total, count(*) filter (where is_entry_point) as entries, count(*) filter (where kind = 'class') as classes, count(*) filter (where kind = 'function') as functions,
    count(*) filter (where kind = 'method') as methods, count(framework) as models from sym left join dm on dm.symbol_id = sym.id group by 1) n
  left join (select file_path, count(*) filter (where edge_type = 'reads') as reads, count(*) filter (where edge_type = 'writes') as writes, count(*) filter (where edge_type = 'calls') as calls
    from edg join sym on sym.id = edg.source_id group by 1) e on e.file_path = n.file_path"""


@query(_PROFILE)
def a6_module_profile(spark, sf):
    return aggregate.module_profile(lookup.nodes(symbols(spark, sf), data_models(spark, sf)), edges(spark, sf))


def _verbed(spark, sf):
    """Customers as functions whose names have verbs."""
    verb = F.element_at(F.array(*map(F.lit, ("get", "set", "load", "walk", "list", "parse"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, ("get", "row", "list", "store"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("_", verb, other).alias("name"), F.lit("function").alias("kind"), F.col("c_mktsegment").alias("file_path"))


@query("""select module, verb, count(*) as functions from (select distinct c_custkey, c_mktsegment as module,
  unnest([['get','set','load','walk','list','parse'][c_custkey % 6 + 1], ['get','row','list','store'][c_custkey % 4 + 1]]) as verb from customer) where verb not in ('walk', 'parse', 'row') group by 1, 2""", False)
def a7_verb_counts(spark, sf):
    return aggregate.verb_counts(_verbed(spark, sf))


@query("""select module, cast(sum(functions) as bigint) as crud from (select module, verb, count(*) as functions, row_number() over (partition by module order by count(*) desc, verb) rn from (select distinct c_custkey, c_mktsegment as module,
  unnest([['get','set','load','walk','list','parse'][c_custkey % 6 + 1], ['get','row','list','store'][c_custkey % 4 + 1]]) as verb from customer) where verb not in ('walk', 'parse', 'row') group by 1, 2) where rn <= 3 group by 1""", False)
def a7_top_verbs(spark, sf):
    return aggregate.top_verbs(aggregate.verb_counts(_verbed(spark, sf)))


@query(f"""select module, narrative from (select module, case
    when reads + writes > calls * 0.5 and reads + writes > 2 then 'Data processing (heavy read/write) (' || tail || ').'
    when entries > total * 0.3 and entries >= 2 then 'Api endpoint handlers (' || tail || ').'
    when models > total * 0.3 then 'Data model definitions (' || case when entries > 0 then entries || ' entry points, ' else '' end || case when models > 0 then models || ' classes, ' else '' end || total || ' symbols total).'
    when classes > functions then 'Object-oriented module with ' || classes || ' classes and ' || methods || ' methods.'
    when functions > 0 then 'Module with ' || functions || ' functions and ' || classes || ' classes.' end as narrative
  from (select *, case when entries > 0 then entries || ' entry points, ' else '' end || case when classes > 0 then classes || ' classes, ' else '' end || total || ' symbols total' as tail from ({_PROFILE}))) where narrative is not null""")
def sc26_narratives(spark, sf):
    return aggregate.narratives(lookup.nodes(symbols(spark, sf), data_models(spark, sf)), edges(spark, sf))


@query("select max(c) as threshold from (select c, row_number() over (order by c desc) - 1 as place, count(*) over () as n from (select count(*) as c from edg where target_id is not null group by target_id)) where place >= least(greatest(1, cast(floor(n * 0.2) as bigint)), n - 1)")
def a10_threshold(spark, sf):
    counts = lookup.resolved(edges(spark, sf)).groupBy("target_id").agg(F.count(F.lit(1)).alias("c"))
    return aggregate.nth_largest(counts, "c", 0.2)


_VIEW = "(select coalesce(s.qualified_name, '') as src, coalesce(t.qualified_name, target_name) as dst from edg e left join sym s on s.id = e.source_id left join sym t on t.id = e.target_id)"


@query(f"select distinct src, dst from {_VIEW} where src <> '' and dst <> ''")
def a11_simple_digraph(spark, sf):
    return aggregate.simple_digraph(lookup.edge_view(symbols(spark, sf), edges(spark, sf)))


@query("select source_id as src, target_id as dst, round(sum(confidence)::double, 6) as weight from edg where target_id is not null group by 1, 2")
def a12_weighted_digraph(spark, sf):
    return aggregate.weighted_digraph(edges(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("select source_id as src, round(sum(confidence)::double, 6) as out_weight from edg where target_id is not null group by 1")
def a13_out_weights(spark, sf):
    return aggregate.out_weights(aggregate.weighted_digraph(edges(spark, sf))).withColumn("out_weight", F.round("out_weight", 6))


# graph


def _seed(spark, sf, *ids: int):
    return symbols(spark, sf).where(F.col("id").isin(*ids)).select("id")


_ADJ = "adj as (select distinct source_id as u, target_id as v from edg where target_id is not null union select distinct target_id, source_id from edg where target_id is not null)"


@query(f""", {_ADJ}, walk as (select 7::bigint as id, 0 as hop union select a.v, w.hop + 1 from walk w join adj a on a.u = w.id where w.hop < 2)
  select id, cast(min(hop) as bigint) as hop from walk where id in (select id from sym) group by 1""")
def g2_neighbourhood(spark, sf):
    return _longs(graph.neighbourhood(_seed(spark, sf, 7), symbols(spark, sf), edges(spark, sf), 2))


@query(""", up as (select distinct target_id as u, source_id as v from edg where target_id is not null), walk as (select 7::bigint as id, 0 as hop union select a.v, w.hop + 1 from walk w join up a on a.u = w.id where w.hop < 2)
  select id, cast(min(hop) as bigint) as hop from walk group by 1 having min(hop) > 0""")
def g3_impact(spark, sf):
    return _longs(graph.impact(_seed(spark, sf, 7), edges(spark, sf), 2))


@query(""", up as (select distinct t.qualified_name as u, s.qualified_name as v from edg e join sym s on s.id = e.source_id join sym t on t.id = e.target_id),
  walk as (select qualified_name as q, 0 as hop from sym where id in (7, 11) union select a.v, w.hop + 1 from walk w join up a on a.u = w.q where w.hop < 2)
  select q as qualified_name, cast(min(hop) as bigint) as hop from walk group by 1 having min(hop) > 0""")
def g4_blast_radius(spark, sf):
    s = symbols(spark, sf)
    return _longs(graph.blast_radius(s.where("id in (7, 11)"), lookup.edge_view(s, edges(spark, sf)), 2))


_HOT = """, calls as (select distinct source_id as u, target_id as v from edg where edge_type = 'calls' and target_id in (select id from sym)),
  walk as (select id as entry, id, 0 as hop from sym where is_entry_point union select w.entry, c.v, w.hop + 1 from walk w join calls c on c.u = w.id where w.hop < 19),
  counts as (select id, count(distinct entry) as entries from walk group by 1)"""


@query(_HOT + " select id, entries from counts")
def a9_path_counts(spark, sf):
    return graph.path_counts(symbols(spark, sf), edges(spark, sf))


@query(_HOT + """ select id, entries from counts where entries >= (select max(entries) from (select entries, row_number() over (order by entries desc) - 1 as place, count(*) over () as n from counts)
  where place >= least(greatest(1, cast(floor(n * 0.2) as bigint)), n - 1))""")
def g5_hot_paths(spark, sf):
    return graph.hot_paths(symbols(spark, sf), edges(spark, sf))


def _rank_sql(links: str, restart: str) -> str:
    """PageRank as a chain of CTEs; links (src, dst, w), restart (id, v)."""
    sql = f""", links as ({links}), share as materialized (select src, dst, w / sum(w) over (partition by src) as p from links),
  restart as materialized ({restart}), r0 as (select id, v, 1.0::double / (select count(*) from sym) as r from restart)"""
    for k in range(1, PAGERANK_ROUNDS + 1):
        sql += f""", r{k} as materialized (select b.id, b.v, {graph.DAMPING} * (coalesce(g.s, 0) + b.v * (select coalesce(sum(r), 0) from r{k - 1} where id not in (select src from share))) + {1 - graph.DAMPING:.2f} * b.v as r
  from r{k - 1} b left join (select dst, sum(r * p) as s from r{k - 1} join share on src = id group by 1) g on g.dst = b.id)"""
    return sql + f" select id, round(r, 9) as pagerank from r{PAGERANK_ROUNDS}"


_LINKS = "select distinct source_id as src, target_id as dst, 1.0::double as w from edg where target_id is not null"
_UNIFORM = "select id, 1.0::double / (select count(*) from sym) as v from sym"


def _links(spark, sf):
    return lookup.resolved(edges(spark, sf)).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()


def _ranked(nodes, links, personal=None, **options):
    return graph.pagerank(nodes, links, rounds=PAGERANK_ROUNDS, tolerance=None, personal=personal, **options).withColumn("pagerank", F.round("pagerank", 9))


_WEIGHTED_LINKS = "select source_id as src, target_id as dst, sum(confidence)::double as w from edg where target_id is not null group by 1, 2"
_PERSONAL = """select sym.id, coalesce(w, 0)::double / sum(coalesce(w, 0)) over () as v from sym left join (select id, sum(w) as w from (
  select 7::bigint as id, 1.0 as w union all select target_id, 0.5 from (select distinct source_id, target_id from edg where source_id = 7 and target_id is not null)
  union all select source_id, 0.5 from (select distinct source_id, target_id from edg where target_id = 7)) group by 1) p on p.id = sym.id"""


@query(_rank_sql(_LINKS, _UNIFORM))
def g7_pagerank_10(spark, sf):
    return _ranked(symbols(spark, sf), _links(spark, sf))


@query(_rank_sql(_WEIGHTED_LINKS, _UNIFORM))
def g8_pagerank_weighted_10(spark, sf):
    return _ranked(symbols(spark, sf), aggregate.weighted_digraph(edges(spark, sf)))


@query(_rank_sql(_LINKS, _PERSONAL))
def g9_personalised_10(spark, sf):
    links = checkpoint(_links(spark, sf))  # it is read three times
    return _ranked(symbols(spark, sf), links, graph.personal_weights(_seed(spark, sf, 7), links))


# the same by joins, which larger graphs take


@query(_rank_sql(_LINKS, _UNIFORM))
def g7_pagerank_10_by_joins(spark, sf):
    return _ranked(symbols(spark, sf), _links(spark, sf), local_links=0)


@query(_rank_sql(_WEIGHTED_LINKS, _UNIFORM))
def g8_pagerank_weighted_10_by_joins(spark, sf):
    return _ranked(symbols(spark, sf), aggregate.weighted_digraph(edges(spark, sf)), local_links=0)


@query(_rank_sql(_LINKS, _PERSONAL))
def g9_personalised_10_by_joins(spark, sf):
    links = checkpoint(_links(spark, sf))  # it is read three times
    return _ranked(symbols(spark, sf), links, graph.personal_weights(_seed(spark, sf, 7), links), local_links=0)


# ranking and budget


def _scored(spark, sf):
    """A score that needs no iteration: the share of incoming edges, with the boost of entry points."""
    n = lookup.resolved(edges(spark, sf)).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return symbols(spark, sf).join(n, "id", "left").select("id", "name", F.round(C.boosted(F.coalesce("c", F.lit(0)) / 1000, F.col("is_entry_point")), 6).alias("score"), C.token_estimate(F.col("name")).alias("cost"))


_SCORED = "(select sym.id, sym.name, round(coalesce(c, 0) / 1000.0 + case when is_entry_point then 0.1 else 0 end, 6)::double as score, length(name) // 4 as cost from sym left join (select target_id, count(*) as c from edg group by 1) x on x.target_id = sym.id)"


@query(f"select id, score, cast(cost as bigint) as cost, cast(running as bigint) as running from (select *, sum(cost) over (order by score desc, id rows unbounded preceding) as running, row_number() over (order by score desc, id) as place from {_SCORED} where cost > 0) where running <= 1000 or place = 1")
def t1_budget_prefix(spark, sf):
    return graph.budget_prefix(_scored(spark, sf), "cost", 1000, [F.desc("score"), F.col("id")]).select("id", "score", "cost", "running")


@query(f"select id, name, score from {_SCORED} order by score desc, id limit 1500")
def t3_top_nodes(spark, sf):
    return _scored(spark, sf).select("id", "name", "score").orderBy(F.desc("score"), "id").limit(1500)


@query("select name, id, kind from (select *, row_number() over (partition by name order by id) rn from sym) where rn = 1")
def w3_first_seen(spark, sf):
    return lookup.first_seen(symbols(spark, sf).select("name", "id", "kind"), ["name"], ["id"])


@query("select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as last_signup from events", False)
def w7_forward_fill(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("last_signup"))
    return lookup.forward_fill(e, "last_signup", "event_id", ["user_id"])


@query("select distinct target_id as id from edg where edge_type = 'reads' and target_id is not null except select distinct target_id from edg where edge_type = 'writes'")
def u2_difference(spark, sf):
    e = lookup.resolved(edges(spark, sf))
    return e.where("edge_type = 'reads'").select(F.col("target_id").alias("id")).distinct().join(e.where("edge_type = 'writes'").select(F.col("target_id").alias("id")), "id", "left_anti")


@query("select distinct qualified_name as node, kind from sym union select distinct target_name, 'external' from edg where target_id is null and target_name not in (select qualified_name from sym)")
def u4_external_union(spark, sf):
    return aggregate.external_targets(symbols(spark, sf), edges(spark, sf))


# scalar functions


@query("""select id, split_part(qualified_name, '.', 3) as short, split_part(qualified_name, '.', 2) as cls, upper(left(kind, 1)) || lower(substr(kind, 2)) as cap,
  replace(replace(replace(replace(signature, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') as xml, case when length(kind) >= 8 then kind else rpad(kind, 8, ' ') end as padded, array_to_string(list_sort(list_distinct(string_split(lower(replace(name, ' ', '_')), '_'))), ',') as words from sym""")
def sc_strings(spark, sf):
    q = F.col("qualified_name")
    words = F.array_join(F.array_sort(C.name_words(F.replace("name", F.lit(" "), F.lit("_")))), ",")
    return symbols(spark, sf).select("id", C.last_part(q).alias("short"), C.class_part(q).alias("cls"), C.capitalise(F.col("kind")).alias("cap"), C.xml_escape(F.col("signature")).alias("xml"), C.padded(F.col("kind"), 8).alias("padded"), words.alias("words"))


@query("select doc_id, case when length(t) > 120 then regexp_replace(left(t, 120), ' [^ ]*$', '') || ' ...' else t end as line from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents)", False)
def sc6_signature_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.signature_line(F.col("text")).alias("line"))


@query("select page_id, left(sha256(html), 16) as digest, length(html) // 4 as tokens from pages", False)
def sc_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.digest16(F.col("html")).alias("digest"), C.token_estimate(F.col("html")).alias("tokens"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events", False)
def sc_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# streaming and maintenance


@query("""select user_id, min(ts) as started, count(*) as changes, count(distinct event_type) as paths from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as fresh from events)) group by user_id, s""", False)
def st3_debounce(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("path"))
    return feed.debounce(e, "1 hour").select(F.col("key").alias("user_id"), F.col("started"), "changes", "paths")


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) rn from events) where rn = 1", False)
def st5_micro_batch_upsert(spark, sf):
    """`events` replayed as a stream of three batches into a keyed table."""
    ship_package(spark)
    return feed.replay_upsert(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", batches=3).select("user_id", "event_type", "value")


@query()
def snk8_json_records(spark, sf):
    from .render.json_out import symbol_records

    ranks = _ranked(symbols(spark, sf), _links(spark, sf)).select("id", "pagerank")
    return symbol_records(lookup.nodes(symbols(spark, sf), data_models(spark, sf)).join(ranks, "id"))

