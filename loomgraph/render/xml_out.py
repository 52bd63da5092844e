"""XML output, and its wrapping for a prompt."""

from __future__ import annotations

from collections import defaultdict
from xml.sax.saxutils import escape

from .json_out import stamp


def _esc(text) -> str:
    return escape(str(text), {'"': "&quot;"})


def _attrs(**values) -> str:
    return "".join(f' {k}="{_esc(v)}"' for k, v in values.items() if v)


def render(selection, total: int, now=None) -> str:
    nodes, edges = selection.nodes, selection.edges
    names = {n["id"]: n["name"] for n in nodes}
    targets, access = defaultdict(list), defaultdict(list)
    for e in edges:
        targets[e["source_id"], e["edge_type"]].append(e["target_qualified_name"].rsplit(".", 1)[-1])
        if e["target_id"] is not None:
            access[e["target_id"], e["edge_type"]].append(names.get(e["source_id"], ""))
    at = lambda n: f"{n['file_path']}:{n['line_start']}"
    out = [f"<repo_context{_attrs(generated=stamp(now), files=len({n['file_path'] for n in nodes}), symbols=len(nodes), total=total)}>"]

    def section(tag: str, lines: list[str]) -> None:
        if lines:
            out.extend([f"  <{tag}>", *(f"    {x}" for x in lines), f"  </{tag}>"])

    section("module_summaries", [f"<summary{_attrs(module=m)}>{_esc(t)}</summary>" for m, t in sorted(selection.narratives.items())])
    section("entry_points", [f"<entry{_attrs(name=n['name'], file=at(n), sig=n['signature'])}/>" for n in nodes if n["is_entry_point"]])
    field = lambda f: f"{f['name']}:{f['type']}{'?' if f['optional'] else ''}"
    section("data_models", [
        f"<model{_attrs(name=n['name'], framework=n['framework'], file=at(n), fields=','.join(map(field, n['fields'] or [])), read_by=','.join(access[n['id'], 'reads']), written_by=','.join(access[n['id'], 'writes']))}/>"
        for n in nodes if n["framework"]
    ])
    modules: dict = defaultdict(lambda: defaultdict(list))
    for n in nodes:
        if not n["framework"]:
            parts = n["qualified_name"].split(".")
            module = n["file_path"].split("/", 1)[0] if n["file_path"] else "root"
            modules[module][parts[-2] if len(parts) >= 3 and n["kind"] == "method" else ""].append(n)
    for module, classes in sorted(modules.items()):
        out.append(f"  <module{_attrs(path=module)}>")
        for owner, own in sorted(classes.items()):
            pad = "      " if owner else "    "
            if owner:
                out.append(f"    <class{_attrs(name=owner)}>")
            for n in sorted(own, key=lambda n: (n["line_start"], n["id"])):
                tag = {"method": "method", "class": "class_def"}.get(n["kind"], "function")
                lists = {k: ",".join(targets[n["id"], k][: 10 if k == "calls" else None]) for k in ("calls", "reads", "writes", "extends", "implements")}
                out.append(f"{pad}<{tag}{_attrs(name=n['name'], sig=n['signature'], file=at(n), **lists, hot_path='true' if n['is_hot_path'] else '')}/>")
            if owner:
                out.append("    </class>")
        out.append("  </module>")
    if total > len(nodes):
        out.append(f"  <footer{_attrs(showing=len(nodes), total=total)}/>")
    return "\n".join([*out, "</repo_context>"])


def wrapped(text: str, name: str = "") -> str:
    """A rendering (within its budget) in a tag for a system prompt."""
    return f"<repository_context{_attrs(name=name)}>\n{text}\n</repository_context>"
