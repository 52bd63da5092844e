"""Scans, filters, lookups and listings over the two graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Names that a call is never resolved to: builtins, common methods and modules.
BUILTINS = frozenset(
    """AttributeError Exception KeyError NotImplementedError RuntimeError StopIteration TypeError ValueError abs add all any append bool
    classmethod close commit dict dir enumerate extend filter float flush format get getattr hasattr id int isinstance issubclass iter len list map
    max min next object open post print property range repr reversed rollback round set setattr sorted staticmethod str sum super tuple type update
    vars zip""".split()
)
EXTERNALS = frozenset(
    """abc aiohttp asyncio base64 click collections contextlib copy dataclasses datetime django fastapi flask functools hashlib httpx io itertools
    json logging math numpy os pandas pathlib pydantic pytest random re requests shutil sqlalchemy subprocess sys tensorflow threading time torch
    typer typing unittest uuid""".split()
)


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("target_id").isNull())


def resolved(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("target_id").isNotNull())


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def by_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path)


def seeds(symbols: DataFrame, target: str) -> DataFrame:
    """The first symbol of this qualified name, else all of this name."""
    exact = symbols.where(F.col("qualified_name") == target).orderBy("id").limit(1)
    return exact.unionByName(by_name(symbols, target)) if exact.isEmpty() else exact


def without_builtins(edges: DataFrame, builtins: frozenset[str] = BUILTINS, externals: frozenset[str] = EXTERNALS) -> DataFrame:
    """Edges whose target isn't a builtin and doesn't begin with a common external module."""
    return edges.where(~F.col("target_name").isin(*sorted(builtins)) & ~F.substring_index("target_name", ".", 1).isin(*sorted(externals)))


def related(symbols: DataFrame, edges: DataFrame, edge_type: str, target: str = "", limit: int | None = 50) -> DataFrame:
    """Symbols with an edge of a type whose raw target text contains `target`, ignoring case, in the
    order of the edges."""
    e = edges.where((F.col("edge_type") == edge_type) & C.contains_folded(F.col("target_name"), target))
    out = e.join(symbols, e.source_id == symbols.id).select("edge_id", "name", "kind", "file_path", "line_start", C.last_part(F.col("target_name")).alias("target"))
    return out.orderBy("edge_id").limit(limit) if limit else out


def search(symbols: DataFrame, text: str, limit: int | None = 30) -> DataFrame:
    found = symbols.where(C.contains_folded(F.col("name"), text) | C.contains_folded(F.col("qualified_name"), text)).select("id", "name", "kind", "file_path", "line_start")
    return found.orderBy("id").limit(limit) if limit else found


def entry_points(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_entry_point")


def models(symbols: DataFrame, data_models: DataFrame, name: str = "", limit: int | None = None) -> DataFrame:
    """Data models with their symbol."""
    found = data_models.join(symbols, data_models.symbol_id == symbols.id).where(C.contains_folded(F.col("name"), name))
    found = found.select("symbol_id", "framework", "name", "qualified_name", "file_path", "line_start")
    return found.orderBy("symbol_id").limit(limit) if limit else found


def nodes(symbols: DataFrame, data_models: DataFrame) -> DataFrame:
    """Symbols with the framework of their data model, or null."""
    return symbols.join(data_models.withColumnRenamed("symbol_id", "id"), "id", "left")


def edge_view(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both qualified names: '' for an unknown source, the raw text for an unknown target."""
    s = symbols.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source_q"))
    t = symbols.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target_q"))
    e = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    confidence = C.effective_confidence(F.col("confidence"))
    return e.select(
        "edge_id", "source_id", "target_id", F.coalesce("source_q", F.lit("")).alias("source_qualified_name"), F.coalesce("target_q", "target_name").alias("target_qualified_name"),
        "edge_type", confidence.alias("confidence"), C.arrow(confidence).alias("arrow"),
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the nodes whose target is unresolved or also among them."""
    ids = nodes.select(F.col("id").alias("source_id")).distinct()
    inner = edges.join(ids, "source_id", "left_semi")
    targets = ids.select(F.col("source_id").alias("t"), F.lit(True).alias("known"))
    return inner.join(targets, inner.target_id == targets.t, "left").where("target_id is null or known").select(*edges.columns)


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, edges.target_id == ids.id, "left_semi")


def readers_writers(symbols: DataFrame, edges: DataFrame, data_models: DataFrame) -> DataFrame:
    """For each data model the names that read and that write it, in the order of the edges."""
    e = edges.where(F.col("edge_type").isin("reads", "writes")).join(symbols.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    e = e.join(data_models.select(F.col("symbol_id").alias("target_id")).distinct(), "target_id", "left_semi")
    names = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("edge_type") == kind, F.struct("edge_id", "source")))), lambda x: x["source"]), ",")
    grouped = e.groupBy("target_id").agg(names("reads").alias("readers"), names("writes").alias("writers"))
    out = data_models.join(grouped, data_models.symbol_id == grouped.target_id, "left")
    return out.select("symbol_id", "framework", F.coalesce("readers", F.lit("")).alias("readers"), F.coalesce("writers", F.lit("")).alias("writers"))


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose time differs from the registry's."""
    k = known.select(F.col("path").alias("known_path"), F.col("mtime").alias("known_mtime"))
    return files.join(k, files.path == k.known_path, "left").where("known_path is null or not (known_mtime <=> mtime)").select(*files.columns)


def deleted(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(files.select("path"), "path", "left_anti")


def overlapping(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines meet a changed range of their file, one row for each qualified name.

    The join is an equi join on the file and on buckets of lines, so that a file with many symbols and
    hunks doesn't meet all with all."""
    width = 128
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    s = symbols.where("line_end >= line_start").withColumn("bucket", bucket(F.col("line_start"), F.col("line_end")))
    h = hunks.where("rng_end >= rng_start").select(F.col("file_path").alias("h_file"), "rng_start", "rng_end", bucket(F.col("rng_start"), F.col("rng_end")).alias("h_bucket"))
    hit = (s.file_path == h.h_file) & (s.bucket == h.h_bucket) & (s.line_start <= h.rng_end) & (s.line_end >= h.rng_start)
    found = s.join(h, hit, "left_semi").drop("bucket").dropDuplicates(["id"])
    first = F.row_number().over(Window.partitionBy("qualified_name").orderBy("id"))
    return found.withColumn("rn", first).where("rn = 1").drop("rn")


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each (file_path, at) the smallest range of the file that holds it; ties to the smallest id.
    Points meet only ranges of their own bucket of lines."""
    width = 128
    p = points.withColumn("bucket", F.floor(F.col("at") / width))
    r = ranges.where("line_end >= line_start").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width))))
    hit = p.join(r, ["file_path", "bucket"]).where("at between line_start and line_end")
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), F.col("id"), F.col("name")))
    return hit.groupBy("file_path", "at").agg(best.alias("b")).select("file_path", "at", F.col("b.id").alias("owner_id"), F.col("b.name").alias("owner"))


def proximate(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Pairs (id, other_id) of one file whose places differ by less than `distance`: a band join on two
    neighbouring buckets."""
    a = left.select("file_path", "id", "at", F.floor(F.col("at") / distance).alias("b"))
    b = right.select(F.col("file_path").alias("f"), F.col("id").alias("other_id"), F.col("at").alias("other_at"), F.explode(F.array(*(F.floor(F.col("at") / distance) + k for k in (-1, 0, 1)))).alias("ob"))
    return a.join(b, (a.file_path == b.f) & (a.b == b.ob) & (F.abs(F.col("at") - F.col("other_at")) < distance)).select("id", "other_id")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def forward_fill(rows: DataFrame, column: str, order: str, partition: list[str]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
