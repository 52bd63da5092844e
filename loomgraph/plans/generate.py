"""From a source tree to a ranked selection under a token budget.

Tables are DataFrames from the scan to the ranking; only the selection, bounded by the budget, reaches the
driver for rendering.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregate, graph, lookup, resolve
from ..session import checkpoint
from ..sources.extract import symbol_rows
from ..sources.files import Config, source_files


ID_BUCKETS = 4096


@dataclass
class Graph:
    """Stored tables of one tree."""

    symbols: DataFrame
    edges: DataFrame
    data_models: DataFrame
    imports: DataFrame
    registry: DataFrame

    def views(self) -> None:
        for name in ("symbols", "edges", "data_models", "imports"):
            getattr(self, name).createOrReplaceTempView(name)


@dataclass
class Selection:
    """What a renderer gets: plain rows."""

    nodes: list[dict]
    edges: list[dict]
    narratives: dict[str, str]


def build(files: DataFrame) -> Graph:
    """The graph of (path, mtime, content, route) files, always from scratch."""
    rows = checkpoint(symbol_rows(files))
    imports = rows.where("kind = 'import'").select("file_path", F.explode("imports").alias("i")).select("file_path", "i.module", "i.name")
    return Graph(*build_rows(rows.where("kind <> 'import'"), imports), checkpoint(files.select("path", "mtime")))


def _edges(symbols: DataFrame, models: DataFrame, imports: DataFrame) -> DataFrame:
    listed = lambda column, kind: symbols.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(column)).alias("target_name"), F.lit(kind).alias("edge_type"))
    raw = listed("references", "calls").unionByName(listed("bases", "extends")).unionByName(listed("implements", "implements"))
    first = symbols.groupBy("file_path").agg(F.min("id").alias("source_id"))
    brought = imports.join(first, "file_path").select("source_id", F.concat_ws(".", "module", "name").alias("target_name"), F.lit("imports").alias("edge_type")).distinct()
    number = F.xxhash64("source_id", "edge_type", "target_name").alias("edge_id")
    open_ = raw.unionByName(brought).distinct().select(number, "*")
    resolved = resolve.resolve(open_, symbols)
    access = resolve.infer_access(symbols, models).distinct().select(F.xxhash64("source_id", "edge_type", "target_id").alias("edge_id"), "*")
    return resolved.unionByName(access)


def scan(spark: SparkSession, root: str, config: Config | None = None) -> Graph:
    return build(source_files(spark, root, config))


def refresh(graph_: Graph, files: DataFrame) -> Graph:
    """The graph after changes: rows of unchanged files are kept, changed ones read again, deleted ones
    dropped; derived tables are made anew."""
    changed = checkpoint(lookup.stale(files, graph_.registry))
    gone = lookup.deleted(files, graph_.registry).select("path").unionByName(changed.select("path")).distinct()
    keep = graph_.symbols.join(gone, F.col("file_path") == F.col("path"), "left_anti").drop("id")
    new = symbol_rows(changed)
    imports = graph_.imports.join(gone, F.col("file_path") == F.col("path"), "left_anti").select(F.col("file_path"), "module", "name")
    fresh = build_rows(keep.unionByName(new.where("kind <> 'import'").select(*keep.columns)), imports.unionByName(new.where("kind = 'import'").select("file_path", F.explode("imports").alias("i")).select("file_path", "i.module", "i.name")))
    return Graph(*fresh, checkpoint(files.select("path", "mtime")))


def build_rows(stored: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Numbered symbols, edges, data models and imports from rows without ids."""
    stored, imports = checkpoint(stored), checkpoint(imports)
    # ids follow the place of a symbol, not the order of a run: counted within files, then files within
    # hash buckets, then buckets, so that no window holds more than a bucket's files
    ordinal = F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "qualified_name", "line_end", "kind", "signature"))
    sizes = stored.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(ID_BUCKETS)))
    within = F.sum("n").over(Window.partitionBy("bucket").orderBy("file_path")) - F.col("n")
    totals = sizes.groupBy("bucket").agg(F.sum("n").alias("t"))
    ahead = F.broadcast(totals.select(F.col("bucket").alias("b"), (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("ahead")))
    before = sizes.withColumn("within", within).join(ahead, F.col("bucket") == F.col("b")).select("file_path", (F.col("within") + F.col("ahead")).alias("before"))
    symbols = checkpoint(stored.withColumn("at", ordinal).join(before, "file_path").select((F.col("before") + F.col("at")).alias("id"), *stored.columns))
    models = symbols.select(F.col("id").alias("symbol_id"), C.framework(F.col("language"), F.col("kind"), F.col("bases"), F.col("decorators")).alias("framework"), F.col("fields")).where("framework is not null")
    return symbols, checkpoint(_edges(symbols, models, imports)), models, imports


def ranked_nodes(g: Graph, around: str | None = None, depth: int = 2, hot: bool = False, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with pagerank, framework, fields and hot flag, and the edge view, of all or of what is around
    a symbol."""
    symbols, edges, seed = g.symbols, g.edges, None
    if around:
        seed = lookup.seeds(symbols, around).select("id")
        near = checkpoint(graph.neighbourhood(seed, symbols, edges, depth))
        symbols = symbols.join(near.select("id"), "id", "left_semi")
        edges = lookup.induced(edges, symbols)
    links = aggregate.weighted_digraph(edges) if weighted else lookup.resolved(edges).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    if seed is not None:  # then they are read three times
        links = checkpoint(links)
    personal = graph.personal_weights(seed, links) if seed is not None else None
    rank = graph.pagerank(symbols, links, personal=personal)
    models = g.data_models.select(F.col("symbol_id").alias("id"), "framework", F.col("fields").alias("model_fields"))
    nodes = symbols.join(rank, "id", "left").join(models, "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    if hot:
        flags = graph.hot_paths(symbols, edges).select("id", F.lit(True).alias("hot"))
        nodes = nodes.join(flags, "id", "left").withColumn("is_hot_path", F.coalesce("hot", F.lit(False))).drop("hot")
    else:
        nodes = nodes.withColumn("is_hot_path", F.lit(False))
    return nodes, lookup.edge_view(symbols, edges)


def select(nodes: DataFrame, view: DataFrame, render: Callable[[Selection, int], str], max_tokens: int = 1000, count: Callable[[str], int] = lambda text: len(text) // 4, narratives: DataFrame | None = None) -> tuple[str, Selection, int]:
    """The longest prefix in the order of the boosted rank whose rendering is within the budget, and
    at least one symbol.  Every symbol costs a token at least, so no more than max_tokens rows are
    fetched."""
    total = nodes.count()
    score = C.boosted(F.col("pagerank"), F.col("is_entry_point"))
    top = nodes.withColumn("score", score).orderBy(F.desc("score"), "id").limit(max(1, min(total, max_tokens)))
    rows = [r.asDict(recursive=True) for r in top.select("id", "name", "qualified_name", "kind", "file_path", "line_start", "signature", "language", "is_entry_point", "pagerank", "framework", F.col("model_fields").alias("fields"), "is_hot_path", "score").collect()]
    ids = top.select("id")
    links = [r.asDict() for r in view.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").orderBy("edge_id").collect()]
    notes = {r.module: r.narrative for r in narratives.collect()} if narratives is not None else {}

    def prefix(k: int) -> Selection:
        shown = {r["id"] for r in rows[:k]}
        every = k == total
        return Selection(rows[:k], [e for e in links if e["source_id"] in shown and (every or e["target_id"] is None or e["target_id"] in shown)], notes)

    lo, hi = min(1, len(rows)), len(rows)
    if len(rows) == total and count(render(prefix(total), total)) <= max_tokens:
        lo = total
    else:
        while lo < hi:  # the rendering grows with the prefix
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if count(render(prefix(mid), total)) <= max_tokens else (lo, mid - 1)
    chosen = prefix(lo)
    return render(chosen, total), chosen, total


def generate(spark: SparkSession, root: str, output: str = "markdown", max_tokens: int | None = None, around: str | None = None, depth: int = 2, hot: bool = False, narrate: bool = False, now=None) -> str:
    from ..render import RENDERERS

    config = Config.load(root)
    g = scan(spark, root, config)
    nodes, view = ranked_nodes(g, around, depth, hot)
    notes = aggregate.narratives(nodes, g.edges) if narrate else None
    return select(nodes, view, lambda s, total: RENDERERS[output](s, total, now), max_tokens or config.max_tokens, narratives=notes)[0]
