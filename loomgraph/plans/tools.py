"""Structured questions over a graph, as DataFrames and as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph, lookup
from .generate import Graph

#: Tried in this order; the first whose word is in the question answers it.
ROUTES = (
    ("writers", ("write", "written", "mutate", "create")),
    ("readers", ("read", "use")),
    ("importers", ("import",)),
    ("callers", ("call",)),
    ("entry_points", ("entry", "route", "endpoint")),
    ("data_models", ("model", "schema", "pydantic", "dataclass")),
)
_STOP = frozenset("all are from how in is it me of show that the to what where which who".split())


def route(question: str) -> str:
    low = question.lower()
    return next((name for name, words in ROUTES if any(w in low for w in words)), "search")


def model_name(question: str) -> str:
    """The first word in camel case."""
    found = re.findall(r"\b[A-Z][a-zA-Z0-9]+\b", question)
    return found[0] if found else ""


def target_name(question: str) -> str:
    """What is in backquotes, else the first identifier that is no common word."""
    quoted = re.findall(r"`([^`]+)`", question)
    names = quoted or [w for w in re.findall(r"\b(?:[a-z_][a-z0-9_]+|[A-Z][a-zA-Z0-9]+)\b", question) if w.lower() not in _STOP]
    return names[0] if names else ""


def impact(g: Graph, name: str, depth: int = 2) -> DataFrame:
    """(hop, id, name, kind, file_path, line_start) of what depends on a symbol, nearest first."""
    seeds = lookup.by_name(g.symbols, name).select("id")
    if seeds.isEmpty():
        seeds = g.symbols.where(F.col("qualified_name") == name).orderBy("id").limit(1).select("id")
    return graph.impact(seeds, g.edges, depth).join(g.symbols, "id").select("hop", "id", "name", "kind", "file_path", "line_start").orderBy("hop", "id")


def diff_report(g: Graph, hunks: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Changed symbols, and what is upstream of them, by qualified name."""
    changed = lookup.overlapping(g.symbols, hunks)
    return changed.orderBy("qualified_name"), graph.blast_radius(changed, lookup.edge_view(g.symbols, g.edges), depth).orderBy("qualified_name")


def format_report(changed: DataFrame, affected: DataFrame, symbols: DataFrame) -> str:
    line = F.concat(F.lit("  "), C.padded(F.col("kind"), 10), F.lit(" "), F.col("qualified_name"), F.lit("  "), F.col("file_path"), F.lit(":"), F.col("line_start").cast("string"))
    first = lookup.first_seen(symbols, ["qualified_name"], ["id"])
    show = lambda df: [r[0] for r in df.orderBy("qualified_name").select(line).collect()]
    a, b = show(changed), show(first.join(affected.select("qualified_name"), "qualified_name", "left_semi"))
    return "\n".join([f"Changed symbols: {len(a)}", *a, f"Affected upstream: {len(b)}", *b])


def answer(g: Graph, question: str) -> str:
    """Text for a question in words."""
    kind = route(question)
    if kind == "search":
        return search(g, question)
    if kind == "entry_points":
        return entry_points(g)
    if kind == "data_models":
        return data_models(g, model_name(question))
    return related(g, kind, model_name(question) if kind in ("writers", "readers") else target_name(question))


_RELATED = {
    "writers": ("writes", "Functions that write", "No write relationships found"),
    "readers": ("reads", "Functions that read", "No read relationships found"),
    "importers": ("imports", "Files that import", "No imports found"),
    "callers": ("calls", "Callers of", "No callers found"),
}


def related(g: Graph, kind: str, target: str = "") -> str:
    edge_type, header, nothing = _RELATED[kind]
    rows = lookup.related(g.symbols, g.edges, edge_type, target).collect()
    if not rows:
        return f"{nothing}{' for ' + target if target else ''}."
    shown = [f"  `{r.file_path}` imports {r.target}" if kind == "importers" else f"  `{r['name']}` ({r.kind}) — {r.file_path}:{r.line_start} {edge_type} → {r.target}" for r in rows]
    return "\n".join([f"{header} {target}".rstrip() + ":", *shown])


def entry_points(g: Graph) -> str:
    rows = lookup.entry_points(g.symbols).orderBy("id").collect()
    if not rows:
        return "No entry points detected."
    return "\n".join(["Detected entry points:", *(f"  ★ `{r['name']}` ({r.kind}) — {r.file_path}:{r.line_start}" + (f"\n    {r.signature[:100]}" if r.signature else "") for r in rows)])


def data_models(g: Graph, name: str = "") -> str:
    found = lookup.models(g.symbols, g.data_models, name, 20)
    access = lookup.readers_writers(g.symbols, g.edges, g.data_models).drop("framework")
    rows = found.join(access, "symbol_id", "left").join(g.data_models.select("symbol_id", "fields"), "symbol_id").orderBy("symbol_id").collect()
    if not rows:
        return f"No data models found{' matching ' + name if name else ''}."
    out = []
    for r in rows:
        out += [f"\n### {r['name']} ({r.framework})", f"File: {r.file_path}:{r.line_start}", *(f"  {f['name']}: {f['type']}{'?' if f['optional'] else ''}" for f in r.fields or [])]
        for word, names in (("Read by", r.readers), ("Written by", r.writers)):
            if names:
                out.append(f"{word}: {', '.join(names.split(',')[:10])}")
    return "\n".join(out)


def search(g: Graph, text: str) -> str:
    rows = lookup.search(g.symbols, text).collect()
    if not rows:
        return f"No symbols matching '{text}'."
    return "\n".join([f"Symbols matching '{text}':", *(f"  `{r['name']}` ({r.kind}) — {r.file_path}:{r.line_start}" for r in rows)])


def impact_text(g: Graph, name: str, depth: int = 2) -> str:
    if lookup.seeds(g.symbols, name).isEmpty():
        return f"Symbol '{name}' not found."
    rows = impact(g, name, depth).collect()
    if not rows:
        return f"No callers found for '{name}' within {depth} hops."
    return "\n".join([f"Impact of `{name}` (depth {depth}): {len(rows)} symbols", *(f"  [{'direct caller' if r.hop == 1 else f'{r.hop} hops'}] {r.kind} `{r['name']}` — {r.file_path}:{r.line_start}" for r in rows)])
