"""The page: the view-model of ``export.page_nodes`` and ``page_edges`` in one HTML file, and the focus on one community."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.operators.graph import Graph
from kgweave.sinks.export import PALETTE, page_edges, page_nodes

#: Nodes and edges that a page holds; larger graphs are drawn by community instead.
MAX_PAGE_NODES, MAX_PAGE_EDGES = 20_000, 100_000

_PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>Graph</title>
<style>body{margin:0;font:14px sans-serif;display:flex;height:100vh}#side{width:300px;overflow:auto;padding:8px;border-right:1px solid #ccc}canvas{flex:1}li{cursor:pointer}</style></head>
<body><div id="side"><input id="find" placeholder="search" size="28"><select id="group"></select><ul id="hits"></ul><pre id="detail"></pre></div><canvas id="view"></canvas>
<script>
const data = __DATA__, colours = __COLOURS__;
const byId = new Map(data.nodes.map((n, i) => [n.id, Object.assign(n, {x: Math.cos(i * 2.4) * Math.sqrt(i + 1), y: Math.sin(i * 2.4) * Math.sqrt(i + 1)})]));
const el = k => document.getElementById(k), view = el('view');
let focus = null, picked = null;
const groups = [...new Set(data.nodes.map(n => n.group))].sort((a, b) => a - b);
el('group').innerHTML = '<option value="">all</option>' + groups.map(g => `<option>${g}</option>`).join('');
function shown(n) { return focus === null || n.group === focus; }
function draw() {
  view.width = view.clientWidth; view.height = view.clientHeight;
  const c = view.getContext('2d'), s = Math.min(view.width, view.height) / (2.2 * Math.sqrt(data.nodes.length + 1));
  const at = n => [view.width / 2 + n.x * s, view.height / 2 + n.y * s];
  c.strokeStyle = '#ddd';
  for (const e of data.edges) { const a = byId.get(e.source), b = byId.get(e.target); if (shown(a) && shown(b)) { c.beginPath(); c.moveTo(...at(a)); c.lineTo(...at(b)); c.stroke(); } }
  for (const n of data.nodes) if (shown(n)) { c.fillStyle = n.id === picked ? '#000' : colours[Math.max(0, n.group) % colours.length]; c.beginPath(); c.arc(...at(n), n.bridge ? 5 : 3, 0, 7); c.fill(); }
}
function pick(id) {
  picked = id; const n = byId.get(id), near = data.edges.filter(e => e.source === id || e.target === id);
  el('detail').textContent = `${n.label}\\n${n.file}\\ncommunity ${n.group}, degree ${n.degree}\\n` + near.slice(0, 50).map(e => `${e.source} ${e.relation} ${e.target}`).join('\\n'); draw();
}
el('find').oninput = ev => {
  const q = ev.target.value.toLowerCase();
  const hits = q.length < 2 ? [] : data.nodes.filter(n => n.label.toLowerCase().includes(q) || n.file.toLowerCase().includes(q)).slice(0, 50);
  el('hits').innerHTML = ''; for (const n of hits) { const li = document.createElement('li'); li.textContent = n.label; li.onclick = () => pick(n.id); el('hits').append(li); }
};
el('group').onchange = ev => { focus = ev.target.value === '' ? null : Number(ev.target.value); draw(); };
addEventListener('resize', draw); draw();
</script></body></html>
"""


def community_focus(graph: Graph, communities: DataFrame, community: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the page that lie in one community."""
    nodes = page_nodes(graph, communities).where(F.col("group") == community)
    ids = nodes.select("id")
    edges = page_edges(graph).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges.select("source", "target", "relation", "confidence")


def html_page(graph: Graph, communities: DataFrame, bridges: DataFrame | None = None) -> str:
    """The page as text; a graph beyond the page's bounds raises."""
    nodes = page_nodes(graph, communities, bridges).orderBy("id").limit(MAX_PAGE_NODES + 1).collect()
    edges = page_edges(graph).orderBy("source", "target").limit(MAX_PAGE_EDGES + 1).collect()
    if len(nodes) > MAX_PAGE_NODES or len(edges) > MAX_PAGE_EDGES:
        raise ValueError(f"more than {MAX_PAGE_NODES} nodes or {MAX_PAGE_EDGES} edges: use super_nodes and super_edges")
    data = json.dumps({"nodes": [r.asDict() for r in nodes], "edges": [r.asDict() for r in edges]}).replace("</", "<\\/")
    return _PAGE.replace("__DATA__", data).replace("__COLOURS__", json.dumps(PALETTE))
