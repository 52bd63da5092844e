"""A self-contained page with the most important nodes and the edges between them."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.lookup import closed

MAX_NODES, MAX_EDGES = 1500, 8000

_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .6em;text-align:left}}</style>
<h1>{title}</h1><input id="q" placeholder="filter"><table><thead><tr><th>symbol<th>kind<th>file<th>rank<th>to</thead><tbody id="t"></tbody></table>
<script>const g={data};const out={{}};g.edges.forEach(e=>(out[e.source]=out[e.source]||[]).push(e.target));const names=Object.fromEntries(g.nodes.map(n=>[n.id,n.name]));
const t=document.getElementById("t"),q=document.getElementById("q");function cell(r,x){{const c=r.insertCell();c.textContent=x}}
function show(){{t.textContent="";g.nodes.filter(n=>n.qualified_name.toLowerCase().includes(q.value.toLowerCase())).forEach(n=>{{const r=t.insertRow();cell(r,n.name);cell(r,n.kind);cell(r,n.file);cell(r,n.pagerank);cell(r,(out[n.id]||[]).map(i=>names[i]).join(", "))}})}}q.oninput=show;show()</script>
"""


def selection(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> dict:
    top = nodes.orderBy(F.desc("pagerank"), "id").limit(max_nodes)
    rows = top.select("id", "name", "qualified_name", "kind", F.col("file_path").alias("file"), C.module_key(F.col("file_path")).alias("group"), F.bround("pagerank", 8).alias("pagerank")).collect()
    links = closed(edges, top.select("id")).orderBy("edge_id").limit(max_edges).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "edge_type", F.bround("confidence", 2).alias("confidence")).collect()
    return {"nodes": [r.asDict() for r in rows], "edges": [r.asDict() for r in links]}


def page(nodes: DataFrame, edges: DataFrame, title: str = "Source map", max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> str:
    data = json.dumps(selection(nodes, edges, max_nodes, max_edges)).replace("<", "\\u003c")
    return _PAGE.format(title=html.escape(title), data=data)
