"""The tool registry: named graph tools over JSON arguments, and a line-oriented request loop."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.text import token_estimate
from kgweave.operators import context as C
from kgweave.operators.graph import Graph, adjacency, assigned, degrees, god_nodes, graph_stats, verbose_nodes
from kgweave.operators.kernels import articulation_points
from kgweave.operators.traverse import query_graph


class ToolError(Exception):
    """A tool cannot answer; becomes an error of the request."""


class Workspace:
    """A loaded graph with its communities and conversations; degrees and bridges are computed once."""

    def __init__(self, graph: Graph, communities: DataFrame, conversations: DataFrame | None = None, root: str | None = None):
        self.graph, self.communities, self.conversations = graph, communities, conversations
        self.root = root  # where conversations are kept
        self._bridges: DataFrame | None = None

    @property
    def bridges(self) -> DataFrame:
        if self._bridges is None:
            self._bridges = articulation_points(self.graph)
        return self._bridges


TOOLS: dict[str, Callable[[Workspace, dict], Any]] = {}


def tool(f: Callable[[Workspace, dict], Any]) -> Callable[[Workspace, dict], Any]:
    TOOLS[f.__name__] = f
    return f


def _rows(df: DataFrame, top: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(top).collect()]


def _need(args: dict, name: str) -> Any:
    if args.get(name) in (None, ""):
        raise ToolError(f"missing argument: {name}")
    return args[name]


@tool
def get_node(w: Workspace, args: dict) -> dict:
    found = _rows(w.graph.nodes.where(F.col("id") == _need(args, "id")), 1)
    if not found:
        raise ToolError(f"no such node: {args['id']}")
    return found[0]


@tool
def describe_nodes(w: Workspace, args: dict) -> list[dict]:
    ids = args.get("ids") or [_need(args, "id")]
    rows = verbose_nodes(w.graph, w.communities, w.bridges).where(F.col("id").isin(list(ids)))
    return _rows(rows.orderBy("id"), len(ids))


@tool
def get_neighbors(w: Workspace, args: dict) -> list[dict]:
    near = adjacency(w.graph).where(F.col("node") == _need(args, "id")).select(F.col("neighbour").alias("id"))
    return _rows(w.graph.nodes.join(near, "id", "left_semi").select("id", "label").orderBy("id"), int(args.get("limit", 200)))


@tool
def get_community(w: Workspace, args: dict) -> dict:
    c = int(_need(args, "community_id"))
    of = assigned(w.communities).where(F.col("community_id") == c)
    members = _rows(of.select(F.col("node_id").alias("id")).join(w.bridges.select("id", F.lit(True).alias("is_bridge")), "id", "left").select("id", F.coalesce("is_bridge", F.lit(False)).alias("is_bridge")).orderBy("id"), 20)
    return {"community_id": c, "size": of.count(), "members": members}


@tool
def graph_statistics(w: Workspace, args: dict) -> dict:
    return _rows(graph_stats(w.graph), 1)[0]


@tool
def hubs(w: Workspace, args: dict) -> list[dict]:
    return _rows(god_nodes(w.graph, int(args.get("top", 10))), int(args.get("top", 10)))


@tool
def bridges(w: Workspace, args: dict) -> dict:
    return {"count": w.bridges.count(), "nodes": [r["id"] for r in _rows(w.bridges.select("id").orderBy("id"), 50)]}


@tool
def query(w: Workspace, args: dict) -> dict:
    seeds = C.seeds(w.graph.nodes, _need(args, "question"))
    sub = query_graph(w.graph, seeds, args.get("max_depth"), args.get("direction", "out"))
    top = int(args.get("limit", 30))
    return {"nodes": _rows(sub.nodes.select("id", "label").orderBy("id"), top), "edges": _rows(sub.edges.select("source", "target", "relation", "confidence").orderBy("source", "target"), top)}


@tool
def path(w: Workspace, args: dict) -> dict:
    found = C.path_query(w.graph, _need(args, "start"), _need(args, "end"))
    if found is None:
        raise ToolError("no path")
    return {"path": found, "hops": len(found) - 1}


@tool
def explain(w: Workspace, args: dict) -> list[dict]:
    found = _rows(C.explain(w.graph, w.communities, _need(args, "node")).orderBy("neighbour"), int(args.get("limit", 100)))
    if not found:
        raise ToolError("no matching node")
    return found


@tool
def select_context(w: Workspace, args: dict) -> dict:
    question = _need(args, "question")
    kind = C.classify_complexity(w.graph.nodes, question)
    sub = C.select_context(w.graph, w.communities, question, bool(args.get("history")), kind)
    text = C.format_context(sub, w.communities, question)
    tokens = w.graph.nodes.sparkSession.range(1).select(token_estimate(F.lit(text)).alias("t")).first()[0]
    return {"complexity": kind, "text": text, "characters": len(text), "token_estimate": tokens}


@tool
def conversation_history(w: Workspace, args: dict) -> list[dict]:
    if w.conversations is None:
        return []
    found = C.search_conversations(w.conversations, _need(args, "question"), int(args.get("limit", 10)))
    return _rows(C.related_nodes(w.conversations, found).orderBy(F.col("score").desc(), "id"), int(args.get("limit", 10)))


@tool
def add_conversation(w: Workspace, args: dict) -> dict:
    stamp = args.get("timestamp") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    row = (("conv_" + "".join(ch for ch in stamp if ch not in "-:")), _need(args, "question"), args.get("summary", ""), stamp, list(args.get("relevant_nodes", [])), int(args.get("tokens_used", 0)))
    from kgweave.schema import CONVERSATION

    new = w.graph.nodes.sparkSession.createDataFrame([row], CONVERSATION)
    if w.root is not None:
        from kgweave.sinks.stores import save_conversations

        save_conversations(new, w.root)
    w.conversations = new if w.conversations is None else w.conversations.unionByName(new)
    return {"id": row[0]}


def handle(w: Workspace, line: str) -> dict:
    """One JSON-RPC request to its response; errors: -32700 not JSON, -32601 no such method, -32602 the tool's own."""
    try:
        request = json.loads(line)
        id_, method = request["id"], request["method"]
    except (ValueError, KeyError, TypeError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if method == "tools/list":
        return {"jsonrpc": "2.0", "id": id_, "result": {"tools": sorted(TOOLS)}}
    params = request.get("params") or {}
    name = params.get("name") if method == "tools/call" else method
    if name not in TOOLS:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"method not found: {name}"}}
    try:
        return {"jsonrpc": "2.0", "id": id_, "result": TOOLS[name](w, params.get("arguments", params if method != "tools/call" else {}))}
    except (ToolError, ValueError) as e:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32602, "message": str(e)}}


def serve(w: Workspace, lines: Iterable[str] = sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            print(json.dumps(handle(w, line), default=str), file=out, flush=True)
