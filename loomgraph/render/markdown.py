"""Markdown output."""

from __future__ import annotations

from collections import defaultdict

from ..schemas import EDGE_TYPES
from .json_out import stamp


def _code(names) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _last(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def edge_lines(edges: list[dict], sure: int = 8, unsure: int = 5) -> list[str]:
    """A line for each edge type and arrow, with the last parts of the first targets."""
    out = []
    for kind in EDGE_TYPES:
        for mark, most in (("→", sure), ("?→", unsure)):
            names = [_last(e["target_qualified_name"]) for e in edges if e["edge_type"] == kind and e["arrow"] == mark]
            if names:
                out.append(f"{mark} {kind}: {_code(names[:most])}")
    return out


def render(selection, total: int, now=None) -> str:
    nodes, edges = selection.nodes, selection.edges
    of = f" (of {total})" if total > len(nodes) else ""
    out = ["# Source map", f"> Generated {stamp(now)} | {len({n['file_path'] for n in nodes})} files | {len(nodes)} symbols{of}", ""]
    place = lambda n: f"- `{n['name']}` — `{n['file_path']}:{n['line_start']}`"
    if entries := [n for n in nodes if n["is_entry_point"]]:
        out += ["## Entry Points", *map(place, entries), ""]
    names = {n["id"]: n["name"] for n in nodes}
    access = defaultdict(list)
    for e in edges:
        if e["target_id"] is not None and e["edge_type"] in ("reads", "writes"):
            access[e["target_id"], e["edge_type"]].append(names.get(e["source_id"], "?"))
    if models := [n for n in nodes if n["framework"]]:
        out.append("## Data Models")
        for m in models:
            out += [f"### {m['name']} (`{m['file_path']}:{m['line_start']}`)", f"*{m['framework']}*"]
            if m["fields"]:
                out += ["| Field | Type | Optional |", "|---|---|---|", *(f"| {f['name']} | {f['type']} | {'yes' if f['optional'] else 'no'} |" for f in m["fields"])]
            for kind, word in (("reads", "Read by"), ("writes", "Written by")):
                if access[m["id"], kind]:
                    out.append(f"**{word}:** {_code(access[m['id'], kind])}")
            out.append("")
    if hot := [n for n in nodes if n["is_hot_path"] and not n["is_entry_point"]]:
        out += ["## Hot Path Functions", "> On the way from many entry points.", *map(place, hot[:20]), ""]
    if selection.narratives:
        out += ["## Module Summaries", *(f"- **{m}**: {t}" for m, t in sorted(selection.narratives.items())), ""]
    out.append("## Symbols")
    from_ = defaultdict(list)
    for e in edges:
        from_[e["source_id"]].append(e)
    by_file = defaultdict(list)
    for n in nodes:
        if not n["framework"]:
            by_file[n["file_path"]].append(n)
    for path in sorted(by_file):
        out.append(f"\n### `{path}`")
        for n in sorted(by_file[path], key=lambda n: (n["line_start"], n["id"])):
            out.append(f"```\n{n['signature']}\n```" if n["signature"] else f"- `{n['name']}` ({n['kind']})")
            out += edge_lines(from_[n["id"]])
    if total > len(nodes):
        out.append(f"\n---\n{len(nodes)} of {total} symbols, by importance. `--around <symbol>` shows a part of the graph.")
    return "\n".join(out)
